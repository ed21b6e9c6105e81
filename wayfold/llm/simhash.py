"""SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints form one class (a grouping that combines before its shuffle). A
fingerprint of 64 bits is cut into ``blocks`` blocks; two that differ in at most 3 bits agree
in all but 3 blocks, so each class is dealt once under every choice of ``blocks - 3`` blocks
and meets every partner in at least one bucket, where the Hamming distance is verified.

A bucket doesn't list its pairs. It gives the links of a spanning forest, at most one per
member, which keeps the components exact; a large bucket is cut again by blocks of the bits
in which its members still differ. Components are found on these links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size, gather, kept, partitions, worker_state
from wayfold.llm.components import components
from wayfold.llm.repeats import mix, words

SEED = 42
BATCH_BYTES = 2_000_000
#: Fixed table: A-Z to a-z, nothing else.
LOWER = {c: c + 32 for c in range(65, 91)}
WHOLE_BUCKET = 512
MASK64 = (1 << 64) - 1


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; no words: 0."""
    if not text:
        return 0
    found = words(text.lower() if text.isascii() else text.translate(LOWER))
    if not found:
        return 0
    n = max(1, len(found) - size + 1)
    votes = sum(bit_votes(h) for h in shingle_hashes(found, size))
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def shingle_hashes(found: list[str], size: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, repeats included; fewer words than ``size``: of the whole sequence."""
    digest = xxhash.xxh64_intdigest
    if len(found) <= size:
        yield np.array([digest(" ".join(found).encode("utf-8", "surrogatepass"), SEED)], np.uint64)
        return
    for at in range(0, len(found) - size + 1, 20_400):
        part = found[at : at + 20_400 + size - 1]
        shingles = map(" ".join, zip(*(part[k:] for k in range(size))))
        yield np.fromiter((digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles), np.uint64, len(part) - size + 1)


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; sums of 255 rows fit a byte."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    votes = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        votes = votes + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return votes


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f): the fingerprint of each whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, f long")


def masks(bits: int, blocks: int, distance: int) -> list[int]:
    """Masks of the bits kept by each choice of all but ``distance`` blocks."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(each, blocks - distance)]


def forest(members: np.ndarray, distance: int, depth: int = 0) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct numbers that are within ``distance`` of each other."""
    if len(members) < 2:
        return []
    if len(members) > WHOLE_BUCKET and depth < 3:
        differing = int(np.bitwise_or.reduce(members ^ members[0]))
        places = [b for b in range(64) if differing >> b & 1]
        if len(places) > 2 * distance + 2:
            blocks = min(2 * distance, len(places))
            edges = [len(places) * k // blocks for k in range(blocks + 1)]
            parts = [sum(1 << b for b in places[a:z]) for a, z in zip(edges, edges[1:])]
            links: set[tuple[int, int]] = set()
            for some in combinations(parts, blocks - distance):
                keys = members & np.uint64(sum(some))
                order = np.argsort(keys, kind="stable")
                cuts = np.flatnonzero(np.diff(keys[order])) + 1
                for group in np.split(members[order], cuts):
                    links.update(forest(group, distance, depth + 1))
            return spanning(links)
    links, reached = [], np.zeros(len(members), bool)
    left = np.arange(len(members))
    # Breadth first over members not yet reached: each becomes a centre once.
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            centre = queue.pop()
            near = np.bitwise_count(members[left] ^ members[centre]) <= distance
            for k in left[near]:
                links.append((int(members[centre]), int(members[k])))
                queue.append(k)
            left = left[~near]
    return links


def spanning(links: set[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in sorted(links):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The other columns of each bucket of two rows or more; rows come sorted by (choice, key)."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        choice, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rest = [c.to_numpy() for c in batch.columns[2:]]
        starts = np.concatenate([[0], np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1, [len(key)]])
        if last != (int(choice[0]), int(key[0])):
            yield from closed(held)
            held = []
        last = (int(choice[-1]), int(key[-1]))
        held.append([c[: starts[1]] for c in rest])
        if len(starts) > 2:
            yield from closed(held)
            for g in np.flatnonzero(np.diff(starts[1:-1]) > 1) + 1:
                yield [c[starts[g] : starts[g + 1]] for c in rest]
            held = [[c[starts[-2] :] for c in rest]]
    yield from closed(held)


def closed(held: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    columns = [np.concatenate(c) for c in zip(*held)]
    if columns and len(columns[0]) > 1:
        yield columns


def links(classes: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(u, v): links between distinct fingerprints ``f`` that give the same components as all links."""
    choices = masks(64, blocks, distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            for k, mask in enumerate(choices):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), k, np.int8)), pa.array((found & np.uint64(mask)).view(np.int64)), batch.column(0)],
                    names=["choice", "key", "f"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (found,) in buckets(batches):
            if pairs := forest(found.view(np.uint64), distance):
                yield pairs_batch(pairs)

    dealt = classes.select("f").mapInArrow(deal, "choice byte, key long, f long")
    ordered = dealt.repartition(partitions(classes.sparkSession), "choice", "key").sortWithinPartitions("choice", "key")
    return ordered.mapInArrow(verify, "u long, v long").distinct()


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["u", "v"])


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f, component_id): component_id is the smallest doc_id reachable over links, the own one included.

    Documents without words (null, empty or blank texts) have fingerprint 0 and are linked like
    any other. Rows without an id keep their fingerprint and get the class's component; if no
    row of a component has an id, it is null. Repeated rows are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    found = kept(fingerprints(docs, size, id_col, text_col), spark)
    classes = kept(found.groupBy("f").agg(F.min("doc_id").alias("least")), spark)
    groups = components(links(classes, distance, blocks))
    # Components of fingerprints are named by a fingerprint; documents by their smallest id.
    linked = groups.join(classes, groups["node"] == classes["f"]).select("f", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("joined"))
    named = linked.join(least, "component").select(F.col("f").alias("node"), "joined")
    by_class = classes.join(named, classes["f"] == named["node"], "left").select(
        F.col("f").alias("of"), F.least("least", "joined").alias("component_id")
    )
    return found.join(by_class, found["f"] == by_class["of"]).select("doc_id", "f", "component_id")


#: Fixed width of the fingerprints for whole similarities, in 64-bit words.
WIDE = 4
#: Bytes of the shingle sets that are compared at once; larger groups meet in pairs of pieces.
SET_BYTES = 8_000_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; no words: empty."""
    if not text:
        return np.zeros(0, np.uint64)
    found = words(text.lower() if text.isascii() else text.translate(LOWER))
    return np.unique(np.concatenate(list(shingle_hashes(found, size)))) if found else np.zeros(0, np.uint64)


def set_digest(hashes: np.ndarray) -> int:
    """64-bit digest of a set of hashes, as a signed number."""
    return int(mix(hashes).sum(dtype=np.uint64).view(np.int64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of 256 min-hashes: two sets of Jaccard similarity J differ in a bit with probability (1-J)/2, of any size."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, 64 * WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(64 * WIDE, MASK64, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (factors[:, None] * hashes[None, at : at + 512]).min(axis=1), out=least)
    return np.packbits((mix(least) >> np.uint64(40) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")


def most_bits(similarity: float, slack: float = 4.0) -> int:
    """Bits that may differ at a Jaccard similarity: the expected number and ``slack`` standard deviations."""
    p = (1 - similarity) / 2
    return math.ceil(64 * WIDE * p + slack * math.sqrt(64 * WIDE * p * (1 - p)))


def block_bits(rows: int, similarity: float, recall: float = 0.999) -> list[np.ndarray]:
    """Bits of each block. A block has about log2(rows) bits, so a random bucket has about one row.

    The bits are permuted and cut into blocks, again and again, until a pair at the given
    similarity shares a block with probability ``recall``. Pairs that differ in fewer bits than a
    permutation has blocks share one for certain.
    """
    width = max(8, math.ceil(math.log2(max(rows, 2))))
    wanted = math.ceil(math.log(1 - recall) / math.log(1 - ((1 + similarity) / 2) ** width))
    rng, out = np.random.default_rng(SEED), []
    while len(out) < wanted:
        order = rng.permutation(64 * WIDE)
        out += [np.sort(order[k : k + width]) for k in range(0, 64 * WIDE - width + 1, width)]
    return out[:wanted]


def wide_forest(rows: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions linked by a spanning forest of the rows within ``distance`` of each other, first row first."""
    found, left = [], np.arange(len(rows))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            centre = queue.pop(0)
            near = np.bitwise_count(rows[left] ^ rows[centre]).sum(axis=1) <= distance
            found += [(centre, k) for k in left[near]]
            queue += list(left[near])
            left = left[~near]
    return found


def exact_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions linked by a spanning forest of the sets whose Jaccard similarity is ``similarity`` or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    marks = np.zeros(int(codes.max()) + 1, bool)
    found, left, flat = [], np.arange(len(sets)), codes
    while len(left) > 1:
        queue = [left[0]]
        flat, left = flat[sizes[left[0]] :], left[1:]
        while queue and len(left):
            centre = queue.pop()
            own = codes[starts[centre] : starts[centre] + sizes[centre]]
            marks[own] = True
            shared = np.add.reduceat(marks[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            marks[own] = False
            near = shared / (sizes[left] + sizes[centre] - shared) >= similarity
            if near.any():
                found += [(centre, k) for k in left[near]]
                queue += list(left[near])
                left = left[~near]
                flat = gather(codes, starts[left], sizes[left])
    return found


def exact_links(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links inside the ``groups`` (node, component) between ``sets`` (node, shingles) of the wanted similarity.

    They give the same components as all such links inside the groups. The sets of a group are dealt into
    pieces by a hash, every two pieces meet in a task, which gives one link per set at most.
    """
    spark = sets.sparkSession
    rows = kept(sets.join(groups, "node"), spark)
    sizes = rows.groupBy("component").agg(F.ceil(F.sum(F.length("shingles")) / SET_BYTES).cast("int").alias("n"))
    placed = rows.join(sizes, "component").withColumn("p", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    # A group of one piece meets itself; of more, each piece meets every other and so itself too.
    others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda q: (q != F.col("p")) | (F.col("n") == 1))
    met = placed.withColumn("q", F.explode(others)).select(
        "component", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "node", "shingles"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(some: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(some) > 1 and (pairs := exact_forest([np.frombuffer(r[4], "<u8") for r in some], similarity)):
                both = np.array([r[3] for r in some], np.int64)[np.array(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["u", "v"])

        some, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != last:
                    yield from close(some)
                    some, last = [], row[:3]
                some.append(row)
        yield from close(some)

    keys = ["component", "a", "b"]
    ordered = met.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "node")
    return ordered.mapInArrow(verify, "u long, v long").distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents whose sets of word shingles have the wanted Jaccard similarity.

    Fingerprints of 256 bits only choose candidates: a pair at the threshold shares a block with
    probability 0.999 and is within four standard deviations of the expected distance. All sets
    of a group of candidates are compared exactly. Equal sets are one class. Texts without words
    and rows without an id have no row here.
    """
    spark = docs.sparkSession
    names = [f"f{k}" for k in range(WIDE)]
    schema = "doc_id long, node long, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("simhash",), dict)
        for batch in by_size(batches, "text", BATCH_BYTES):
            ids, nodes, rows = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(found := shingle_set(text, size)):
                    ids.append(doc_id)
                    nodes.append(set_digest(found))
                    rows.append(wide_fingerprint(found))
            if ids:
                table = np.array(rows, np.uint64).view(np.int64)
                columns = [pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), *(pa.array(c) for c in table.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", *names])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = kept(texts.mapInArrow(run, schema), spark)
    classes = kept(found.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(n).alias(n) for n in names)), spark)
    choices = block_bits(classes.count(), similarity)
    distance = most_bits(similarity)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
            bits = np.unpackbits(table.view(np.uint8), axis=1, bitorder="little")
            for k, places in enumerate(choices):
                key = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), k, np.int16)), pa.array(key), *(batch.column(n) for n in ["node", *names])],
                    names=["choice", "key", "node", *names],
                )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, *columns in buckets(batches):
            rank = np.argsort(node, kind="stable")
            if pairs := wide_forest(np.stack(columns, axis=1).view(np.uint64)[rank], distance):
                both = node[rank][np.array(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            sets = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"]
            )

    dealt = classes.select("node", *names).mapInArrow(deal, "choice short, key long, node long, " + ", ".join(f"{n} long" for n in names))
    ordered = dealt.repartition(partitions(spark), "choice", "key").sortWithinPartitions("choice", "key")
    groups = kept(components(ordered.mapInArrow(close, "u long, v long").distinct()), spark)
    # One text of each class that has candidates; an id may come with several texts.
    wanted = classes.join(groups, "node").select(F.col("least").alias("doc_id")).distinct()
    sets = texts.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(shingles, "node long, shingles binary")
    linked = components(exact_links(groups, sets.dropDuplicates(["node"]), similarity))
    joined = linked.join(classes.select("node", "least"), "node")
    least = joined.groupBy("component").agg(F.min("least").alias("first"))
    named = joined.join(least, "component").select(F.col("node").alias("_node"), "first")
    by_class = classes.select("node", "least").join(named, F.col("node") == F.col("_node"), "left").select(
        F.col("node").alias("_of"), F.coalesce("first", "least").alias("component_id")
    )
    return found.join(by_class, F.col("node") == F.col("_of")).select("doc_id", "component_id")


def representatives(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest id.

    Of rows that repeat an id and text one stays. Rows without an id or without words are kept.
    """
    rows = similar_documents(docs, similarity, size, id_col, text_col)
    gone = rows.groupBy(F.col("doc_id").alias("_gone")).agg(F.min("component_id").alias("_to")).filter("_gone <> _to")
    left = docs.join(gone.select("_gone"), docs[id_col].cast("long") == F.col("_gone"), "left_anti")
    once = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return once.unionByName(left.filter(F.col(id_col).isNull()))
