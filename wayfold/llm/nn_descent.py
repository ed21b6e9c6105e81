"""Near-duplicate vectors of one label by NN-descent.

Equal vectors of a label are one node. Each node keeps a list of its nearest nodes. Lists start
from buckets of random hyperplanes; in a round all nodes that share a neighbour meet at it and are
compared (neighbours of neighbours), and each node keeps the best of old and new. Where lists are
*saturated*, that is full of links, all lists are enlarged and refined again, up to ``LONGEST``.

The number of hyperplanes of a bucket follows from the rows of its label, the number of tables
from that width and the threshold, so that a pair at the threshold shares a bucket with probability
``RECALL``. Lists hold neighbours from a cosine of ``FLOOR`` on, far below the threshold, so rounds
can find links that the buckets missed; the threshold decides on the final links only.

A bucket also gives a spanning forest of its links at the threshold, whatever the lists have room
for, so crowded groups that are nearer to themselves than to each other stay tied. A bucket of more
than ``WHOLE`` rows is dealt into pieces, every two of which meet in a task. The links of lists
and forests give the components. A node's links all lie inside its component, whose nodes
are compared exactly in pieces of bounded size to count them, so crowded clusters lose no link to
the length of a list and their pairs are never listed. An audit compares a sample of nodes with
all others; while less than ``WANTED`` of the sampled nodes that have links have all of them, more
tables are added, and after ``REPAIRS`` attempts the job stops with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import kept, partitions
from wayfold.llm.components import components
from wayfold.llm.vectors import matrix, pack, usable

START = 12
LONGEST = 48
ROUNDS = 6
TABLES = 8
PER_BUCKET = 512
RECALL = 0.999
FLOOR = 0.5
PIECE = 1_024
WHOLE = 2_048
OVERLAP = 64
AUDIT = 2_000
WANTED = 0.98
REPAIRS = 3
PAIRS = "u long, v long, sim double"


def unit(table: np.ndarray) -> np.ndarray:
    """Rows of length one; a row is scaled by its largest component first, so no square overflows."""
    if not len(table):
        return table
    table = table / np.abs(table).max(axis=1, keepdims=True)
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def pieces(batches: Iterator[pa.RecordBatch], keys: int, overlap: int = 0, limit: float = PIECE) -> Iterator[list]:
    """Rows of one key in pieces of at most ``limit``; a next piece begins with the last ``overlap`` rows."""
    rows: list[tuple] = []
    last, fresh = None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != last or len(rows) == limit:
                if fresh and len(rows) > 1:
                    yield rows
                rows, fresh = (rows[-overlap:] if row[:keys] == last and overlap else []), 0
                last = row[:keys]
            rows.append(row)
            fresh += 1
    if fresh and len(rows) > 1:
        yield rows


def nearest(ids: np.ndarray, table: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, similarity): up to ``k`` nearest others of each row at ``floor`` or more."""
    sim = table @ table.T
    np.fill_diagonal(sim, -2.0)
    if len(ids) > k + 1:
        best = np.argpartition(-sim, k, axis=1)[:, :k]
    else:
        best = np.tile(np.arange(len(ids)), (len(ids), 1))
    value = np.take_along_axis(sim, best, axis=1)
    i, j = np.nonzero(value >= floor)
    return ids[i], ids[best[i, j]], value[i, j]


def forest(sim: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) linked by a spanning forest of the pairs at the threshold or more."""
    linked = sim >= threshold
    np.fill_diagonal(linked, False)
    left, found = np.flatnonzero(linked.any(axis=1)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            centre = queue.pop()
            near = linked[centre, left]
            if near.any():
                found.append((np.full(int(near.sum()), centre), left[near]))
                queue += list(left[near])
                left = left[~near]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def pair_batch(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], names=["u", "v", "sim"])


def shape(rows: int, threshold: float, least: int = TABLES) -> tuple[int, int]:
    """(hyperplanes of a bucket, tables) for a label of so many rows: a pair at the threshold is missed by all tables with 1 - ``RECALL``."""
    width = min(40, max(1, math.ceil(math.log2(max(2.0, rows / PER_BUCKET)))))
    same = min(1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi, 1 - 1e-9) ** width
    return width, max(least, math.ceil(math.log(1 - RECALL) / math.log1p(-same)))


def start(nodes: DataFrame, dim: int, k: int, floor: float, threshold: float, tables: int, attempt: int, seed: int) -> DataFrame:
    """Neighbours found in buckets of random hyperplanes, and a spanning forest of each bucket's links.

    ``nodes`` has the rows of each node's label as ``size``. Another attempt has other hyperplanes.
    """

    def deal(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.array([shape(x, threshold, tables) for x in batch.column(3).to_pylist()]).reshape(-1, 2)
            for width, count in np.unique(shapes, axis=0).tolist():
                some = batch.filter(pa.array(shapes[:, 0] == width))
                vectors = unit(matrix(some.column(2)))
                for t in range(attempt * count, (attempt + 1) * count):
                    planes = np.random.default_rng((seed, t)).standard_normal((dim, width))
                    key = (vectors @ planes > 0).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                    columns = {"t": pa.array(np.full(len(key), t, np.int32)), "label": some.column(1), "key": pa.array(key)}
                    if whole:
                        columns |= {"node": some.column(0), "vector": some.column(2)}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, 5, limit=math.inf):
            ids = np.array([r[5] for r in rows], np.int64)
            table = unit(np.frombuffer(b"".join(r[6] for r in rows), "<f8").reshape(len(rows), -1))
            u, v, sim = nearest(ids, table, k, floor)
            if len(u):
                # Without lists there are no links, as the floor isn't above the threshold.
                whole = table @ table.T
                i, j = forest(whole, threshold)
                yield pair_batch(np.concatenate([u, ids[i]]), np.concatenate([v, ids[j]]), np.concatenate([sim, whole[i, j]]))

    kind, keys = dict(nodes.dtypes)["label"], ["t", "label", "key"]
    rows = nodes.select("node", "label", "vector", "size")
    counts = rows.mapInArrow(lambda b: deal(b, False), f"t int, label {kind}, key long").groupBy(*keys).count()
    crowded = kept(counts.filter(F.col("count") > WHOLE).withColumn("n", F.ceil(F.col("count") / PIECE).cast("int")).drop("count"), nodes.sparkSession)
    dealt = rows.mapInArrow(lambda b: deal(b, True), f"t int, label {kind}, key long, node long, vector binary")
    # A bucket of one piece meets itself; of more, each piece meets every other and so itself too.
    placed = dealt.join(crowded, keys, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda q: (q != F.col("p")) | (F.col("n") == 1))
    met = placed.withColumn("q", F.explode(others)).select(*keys, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "node", "vector")
    keys = [*keys, "a", "b"]
    ordered = met.repartition(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys, "node")
    return ordered.mapInArrow(compare, PAIRS)


def shorten(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each list."""
    one = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return one.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def refine(lists: DataFrame, nodes: DataFrame, k: int, floor: float) -> DataFrame:
    """One local join: all nodes that list a node, or are listed by it, meet there."""
    meet = lists.select(F.col("u").alias("centre"), F.col("v").alias("member")).union(
        lists.select(F.col("v").alias("centre"), F.col("u").alias("member"))
    )
    met = meet.union(meet.select("centre", F.col("centre").alias("member"))).distinct()
    rows = met.join(nodes.select(F.col("node").alias("member"), "vector"), "member").select("centre", "member", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches, 1, OVERLAP, 512):
            ids = np.array([r[1] for r in some], np.int64)
            table = unit(np.frombuffer(b"".join(r[2] for r in some), "<f8").reshape(len(some), -1))
            u, v, sim = nearest(ids, table, k, floor)
            if len(u):
                yield pair_batch(u, v, sim)

    ordered = rows.repartition(partitions(nodes.sparkSession), "centre").sortWithinPartitions("centre", F.xxhash64("member"))
    return shorten(lists.union(ordered.mapInArrow(compare, PAIRS)), k)


def descend(nodes: DataFrame, lists: DataFrame, k: int, floor: float, threshold: float) -> tuple[DataFrame, int]:
    """Lists refined until a round changes less than a hundredth of them, enlarged while some are saturated."""
    spark = nodes.sparkSession
    while True:
        lists = kept(shorten(lists, k), spark)
        held = lists.count()
        for _ in range(ROUNDS):
            if not held:
                break
            better = kept(refine(lists, nodes, k, floor), spark)
            new = better.join(lists, ["u", "v"], "left_anti").count()
            lists, held = better, better.count()
            if new <= held / 100:
                break
        full = lists.filter(F.col("sim") >= threshold).groupBy("u").count().filter(F.col("count") >= k).limit(1).count()
        if not full or k >= LONGEST:
            return lists, k
        k *= 2


def count_links(grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, others): the rows linked to each node of rows (component, node, mult, vector), without its own.

    The nodes of a component are dealt into pieces by a hash; every two pieces meet in a task.
    """
    sizes = grouped.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("n"))
    placed = grouped.join(sizes, "component").withColumn("p", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q")
    left = placed.select("component", "p", other, F.lit(0).alias("side"), "node", "mult", "vector")
    right = placed.select("component", F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"), F.lit(1).alias("side"), "node", "mult", "vector")
    rows = left.unionByName(right)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(some: list[tuple]) -> pa.RecordBatch:
            sides = [[r for r in some if r[3] == s] for s in (0, 1)]
            a, b = (unit(np.frombuffer(b"".join(r[6] for r in s), "<f8").reshape(len(s), -1)) if s else np.zeros((0, 1)) for s in sides)
            ids = np.array([r[4] for r in sides[0]], np.int64)
            if not len(a) or not len(b):
                return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(len(ids), np.int64))], names=["node", "others"])
            linked = a @ b.T >= threshold
            linked &= ids[:, None] != np.array([r[4] for r in sides[1]], np.int64)[None, :]
            total = linked.astype(np.int64) @ np.array([r[5] for r in sides[1]], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "others"])

        some, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != last:
                    if some:
                        yield close(some)
                    some, last = [], row[:3]
                some.append(row)
        if some:
            yield close(some)

    keys = ["component", "p", "q"]
    ordered = rows.select(*keys, "side", "node", "mult", "vector").repartition(partitions(grouped.sparkSession), *keys).sortWithinPartitions(*keys, "side")
    return ordered.mapInArrow(count, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, size: int = AUDIT, seed: int = 3) -> list[tuple[int, int]]:
    """(nodes with all their links found, nodes with links) of two samples, each node compared with every other.

    One sample is drawn from all nodes, so also from those whose only link is missed; the other
    from nodes with found links. A node counts once, however many links or copies it has.
    """
    spark = nodes.sparkSession
    order = F.xxhash64(F.lit(seed), "node")
    linked = nodes.join(counted.filter("others > 0").select("node"), "node").orderBy(order, "node").limit(size // 4)
    drawn = nodes.orderBy(order, "node").limit(size - size // 4)
    both = linked.withColumn("drawn", F.lit(0)).unionByName(drawn.withColumn("drawn", F.lit(1)))
    sample = both.select("node", "label", "vector", "drawn").collect()
    if not sample:
        return [(0, 0), (0, 0)]
    unique = list({r["node"]: r for r in sample}.values())
    ids = np.array([r["node"] for r in unique], np.int64)
    groups = np.array([r["label"] for r in unique])
    table = unit(np.frombuffer(b"".join(bytes(r["vector"]) for r in unique), "<f8").reshape(len(unique), -1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                same = groups[:, None] == np.array(batch.column(1).to_pylist())[None, :]
                found = (table @ unit(matrix(batch.column(2))).T >= threshold) & same & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                total += found.astype(np.int64) @ batch.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "others"])

    true = nodes.select("node", "label", "vector", "mult").mapInArrow(compare, "node long, others long")
    true = true.groupBy("node").agg(F.sum("others").alias("true_others")).filter("true_others > 0")
    marks = spark.createDataFrame([(r["node"], r["drawn"]) for r in sample], "node long, drawn int")
    got = true.join(marks, "node").join(counted, "node", "left").groupBy("drawn").agg(
        F.sum((F.coalesce("others", F.lit(0)) == F.col("true_others")).cast("int")), F.count(F.lit(1))
    ).collect()
    by_sample = {r[0]: (int(r[1]), int(r[2])) for r in got}
    return [by_sample.get(d, (0, 0)) for d in (0, 1)]


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tables: int = TABLES, seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are compared if their labels are equal and not null. Null, empty, zero and non-finite
    vectors, rows without a label or id and vectors of another length than most link with
    nothing: 0 links, their own component, kept. Repeated rows (id, label and vector equal)
    count once and come back once. kept: the id is the smallest of its component.
    """
    spark = df.sparkSession
    able = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).alias("label"), F.col(vector_col).alias("_v"))
    packed = pack(df.filter(able).withColumnRenamed(label_col, "label"), id_col, vector_col, "label").distinct()
    packed = kept(packed, spark)
    lengths = packed.groupBy(F.length("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rest_of = rows.join(packed.select(F.col("id").alias("_id")).distinct(), rows[id_col] == F.col("_id"), "left_anti") if lengths else rows
    rest = rest_of.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id")).distinct()
    if lengths is None:
        return rest.withColumn("kept", F.lit(True))
    length = lengths["n"]
    odd = packed.filter(F.length("vector") != length).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    nodes = packed.filter(F.length("vector") == length).groupBy("label", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("mult"))
    nodes = kept(nodes.select("node", "label", "vector", "mult"), spark)
    sizes = nodes.groupBy(F.col("label").alias("_of")).agg(F.count(F.lit(1)).alias("size"))
    sized, floor = kept(nodes.join(sizes, F.col("label") == F.col("_of")).drop("_of", "mult"), spark), min(threshold, FLOOR)

    lists, k, attempt = None, START, 0
    while True:
        found = start(sized, length // 8, k, floor, threshold, tables, attempt, seed)
        found = kept(found if lists is None else found.union(lists), spark)
        lists, k = descend(nodes, found, k, floor, threshold)
        # What the buckets linked counts too, also where a list had no room for it.
        edges = lists.union(found).filter(F.col("sim") >= threshold).select("u", "v").distinct()
        groups = kept(components(edges), spark)
        grouped = groups.join(nodes, "node").select("component", "node", "mult", "vector")
        counted = kept(count_links(grouped, threshold), spark)
        shares = audit(nodes, counted, threshold)
        if all(whole >= WANTED * linked for whole, linked in shares):
            break
        attempt += 1
        if attempt == REPAIRS:
            raise RuntimeError(f"links are missing after {attempt} attempts: (whole, linked) sampled nodes are {shares}")
        lists = found
    # Every node's smallest id is its own number; a component of nodes is named by the smallest.
    named = nodes.join(groups, "node", "left").join(counted, "node", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), "mult",
        F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("component_id"),
    )
    match = (packed["label"] == named["_label"]) & (packed["vector"] == named["_vector"])
    linked = packed.join(named, match).select(
        F.col("id").alias(id_col), (F.col("others") + F.col("mult") - 1).alias("n_links"), "component_id"
    )
    return linked.unionByName(odd).unionByName(rest).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
