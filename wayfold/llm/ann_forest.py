"""Nearest neighbours with a forest of random-projection trees.

Equal vectors are one *point*. The splits of the trees are fitted on a sample of at most
``SAMPLE`` points; then every point is routed to its leaf in every tree. A query walks all trees
through one priority queue, always taking the branch with the largest margin next (the smallest
distance to the split planes passed on the wrong side), until the leaves it has opened hold enough
points. How many are enough is measured: some queries are compared with every row, and the number
is the one with which the walk finds ``RECALL`` of their neighbours; other queries, which had no part
in that, must find ``LEAST`` of theirs with it.

Candidates are ranked by exact distance in two passes. First the home leaves, the first that a query opens in
each tree: the k-th distance found there bounds what can be among the nearest. Then the other leaves return
only the points within the bound, and no point of a home leaf again. So both passes
return rows in proportion to the queries, not to the leaves opened.

Leaves are dealt in pieces of at most ``PIECE`` points, each with the queries that opened the
leaf, so a crowded leaf is many tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import kept, partitions
from wayfold.llm.vectors import matrix, pack

#: Bound of the sample that fits the splits.
SAMPLE = 50_000
TREES = 16
LEAF = 128
#: Share of true neighbours wanted of the queries that set the width, and least share of as many others.
RECALL, LEAST = 0.94, 0.9
#: Queries of one audit, and how often the width may be set anew with those that failed.
AUDIT, AUDITS = 48, 3
PIECE = 4_096


class Tree(NamedTuple):
    """Nodes in arrays: a split has a plane (normal, offset) and two children, a leaf none (child -1, its number)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaf: np.ndarray


def grow(points: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    """Splits by the plane midway between two random points; where that leaves a side empty, at the median."""
    normals, offsets, children, leaf = [], [], [], []
    leaves = 0

    def add(rows: np.ndarray) -> int:
        nonlocal leaves
        node = len(normals)
        normals.append(np.zeros(points.shape[1]))
        offsets.append(0.0)
        children.append((-1, -1))
        leaf.append(-1)
        if len(rows) <= leaf_size:
            leaf[node], leaves = leaves, leaves + 1
            return node
        a, b = points[rng.choice(rows, 2, replace=False)]
        normal = a - b
        size = np.linalg.norm(normal)
        normal = normal / size if size else rng.standard_normal(points.shape[1])
        side = points[rows] @ normal
        offset = float((a + b) @ normal / 2)
        right = side > offset
        if not 0 < right.sum() < len(rows):
            offset = float(np.median(side))
            right = side > offset
        if not 0 < right.sum() < len(rows):
            leaf[node], leaves = leaves, leaves + 1
            return node
        normals[node], offsets[node] = normal, offset
        stack.append((node, rows[~right], rows[right]))
        return node

    stack: list[tuple] = []
    add(np.arange(len(points)))
    while stack:
        node, low, high = stack.pop()
        children[node] = (add(low), add(high))
    return Tree(np.array(normals), np.array(offsets), np.array(children), np.array(leaf))


def route(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Leaf number of each point."""
    at = np.zeros(len(points), np.int64)
    while True:
        inner = np.flatnonzero(tree.children[at, 0] >= 0)
        if not len(inner):
            return tree.leaf[at]
        node = at[inner]
        right = np.einsum("ij,ij->i", points[inner], tree.normals[node]) > tree.offsets[node]
        at[inner] = tree.children[node, right.astype(int)]


def opened(trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray, search: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves a query opens, best first, until they hold ``search`` points."""
    margins = [t.normals @ query - t.offsets for t in trees]
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    found, held = [], 0
    while queue and held < search:
        bound, t, node = heapq.heappop(queue)
        tree = trees[t]
        while tree.children[node, 0] >= 0:
            margin = margins[t][node]
            far = tree.children[node, 0 if margin > 0 else 1]
            heapq.heappush(queue, (max(bound, abs(margin)), t, int(far)))
            node = tree.children[node, 1 if margin > 0 else 0]
        found.append((t, int(tree.leaf[node])))
        held += int(sizes[t][tree.leaf[node]])
    return found


def fit(points: DataFrame, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> list[Tree]:
    """Trees over a sample of points in the order of a hash, at most ``sample`` rows on the driver."""
    rows = points.select("vector").orderBy(F.xxhash64(F.lit(seed), "vector")).limit(sample).collect()
    table = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), "<f8").reshape(len(rows), -1)
    return [grow(table, leaf, np.random.default_rng(seed + k)) for k in range(trees)]


def points_opened(trees: list[Tree], sizes: list[np.ndarray], queries: np.ndarray, near: list[np.ndarray]) -> list[int]:
    """How many points a query has to open until it meets a neighbour, for all true neighbours ``near`` of the queries."""
    needed: list[int] = []
    for query, found in zip(queries, near):
        if not len(found):
            continue
        homes = [set(zip([t] * len(found), route(tree, found).tolist())) for t, tree in enumerate(trees)]
        lists = [[(t, int(leaf)) for t, leaf in zip(range(len(trees)), where)] for where in zip(*(route(tree, found) for tree in trees))]
        wanted, seen, held = set().union(*homes), {}, 0
        for t, leaf in opened(trees, sizes, query, int(sum(s.sum() for s in sizes))):
            held += int(sizes[t][leaf])
            if (t, leaf) in wanted:
                seen[t, leaf] = held
                if len(seen) == len(wanted):
                    break
        needed += [min(seen.get(place, held) for place in places) for places in lists]
    return needed


def search_width(trees: list[Tree], sizes: list[np.ndarray], points: DataFrame, probes: np.ndarray, k: int, recall: float) -> int:
    """Points to open for the wanted recall, from one set of queries and confirmed by the next, which took no part.

    Where the next set finds less than ``LEAST`` of its neighbours, it joins the first and another set confirms; the last
    failure raises. With fewer queries than two sets all set the width and none confirms.
    """
    sets = [probes[at : at + AUDIT] for at in range(0, len(probes), AUDIT)]
    needed: list[int] = []
    width = 0
    for k_set, some in enumerate(sets):
        more = points_opened(trees, sizes, some, true_neighbours(points, some, k))
        found = sum(n <= width for n in more) / len(more) if more else 1.0
        if k_set and found >= min(recall, LEAST):
            return width
        needed = sorted(needed + more)
        width = needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1
    if len(sets) > 1:
        raise RuntimeError(f"the search width found {found:.2f} of the neighbours of queries that had no part in setting it")
    return width


def true_neighbours(points: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` nearest points of each of a few queries, equal vectors left out, by comparing with all points."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in queries]
        for batch in batches:
            raw = batch.column(0).to_pylist()
            if not raw:
                continue
            table = matrix(batch.column(0))
            for i, query in enumerate(queries):
                d = ((table - query) ** 2).sum(axis=1)
                near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                best[i] = sorted(best[i] + [(float(d[j]), raw[j]) for j in near if d[j] > 0])[:k]
        rows = [(i, d, v) for i, b in enumerate(best) for d, v in b]
        columns = list(zip(*rows)) if rows else [[]] * 3
        kinds = [pa.int32(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["i", "d", "vector"])

    order = Window.partitionBy("i").orderBy("d", "vector")
    found = points.select("vector").mapInArrow(compare, "i int, d double, vector binary")
    rows = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()  # AUDIT * k rows
    out: list[list[bytes]] = [[] for _ in queries]
    for r in rows:
        out[r["i"]].append(bytes(r["vector"]))
    return [np.frombuffer(b"".join(v), "<f8").reshape(len(v), -1) for v in out]


def search(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, id, score): the nearest ``k`` rows found for each query but its own id.

    Score: Euclidean distance in double precision on the original vectors; ties go to the smaller
    id. Null, zero and non-finite vectors, null ids and vectors of another length than most take no
    part; a query with fewer candidates gets them all. Every row is indexed. Of rows with one id and
    vector one counts. Of a point's rows the k + 1 smallest ids can be among the results, so no more
    are carried; that is exact.
    """
    spark = df.sparkSession
    rows = pack(df.filter(F.col(id_col).isNotNull()), id_col, vector_col)
    lengths = rows.groupBy(F.length("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if lengths is None:
        return empty
    length = lengths["n"]
    rows = kept(rows.filter(F.length("vector") == length).distinct(), spark)
    smallest = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
    points = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = kept(points.withColumn("point", F.element_at("ids", 1)), spark)
    asked = pack(queries.filter(F.col(id_col).isNotNull()), id_col, vector_col).filter(F.length("vector") == length).distinct()

    forest = fit(points, sample, trees, leaf)
    # At most trees * 2 * sample / leaf nodes, as plain arrays: executors need not have this package.
    shared = spark.sparkContext.broadcast([tuple(tree) for tree in forest])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_here = [Tree(*arrays) for arrays in shared.value]
        for batch in batches:
            table = matrix(batch.column(1))
            homes = np.stack([route(tree, table) for tree in trees_here], axis=1).astype("<i4")
            packed = pa.array([row.tobytes() for row in homes], pa.binary())
            for t in range(len(trees_here)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(homes), t, np.int32)), pa.array(np.ascontiguousarray(homes[:, t])), *batch.columns, packed],
                    names=["tree", "leaf", "point", "vector", "homes"],
                )

    located = "tree int, leaf int, point long, vector binary, homes binary"
    placed = kept(points.select("point", "vector").mapInArrow(place, located), spark)
    counted = placed.groupBy("tree", "leaf").count().collect()  # one row per leaf of the forest
    sizes = [np.zeros(len(t.leaf), np.int64) for t in forest]
    for r in counted:
        sizes[r["tree"]][r["leaf"]] = r["count"]
    probe = asked.select("vector").distinct().orderBy(F.xxhash64(F.lit(5), "vector")).limit(AUDIT * AUDITS).collect()
    if not probe:
        return empty
    probes = np.frombuffer(b"".join(bytes(r["vector"]) for r in probe), "<f8").reshape(len(probe), -1)
    candidates = max(search_width(forest, sizes, points, probes, k, recall), 4 * k)
    pieces = [np.maximum(-(-s // PIECE), 1) for s in sizes]
    keys = ["tree", "leaf", "piece"]
    visits = "tree int, leaf int, piece int, q long, query binary, homes binary, bound double"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = np.array([pieces[a][b] for a, b in zip(t, x)], np.int64)
            piece = (batch.column(2).to_numpy() % np.maximum(n, 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], names=[*batch.schema.names, "piece"])

    def visit(homely: bool):
        """Rows (tree, leaf, piece, query): the home leaves of a query, or the others that it opens."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees_here = [Tree(*arrays) for arrays in shared.value]
            for batch in batches:
                columns = batch.to_pydict()
                for i, query in enumerate(matrix(batch.column(1))):
                    homes = np.array([int(route(tree, query[None])[0]) for tree in trees_here], "<i4")
                    own = set(enumerate(homes.tolist()))
                    found = sorted(own) if homely else [v for v in opened(trees_here, sizes, query, candidates) if v not in own]
                    out = [(t, x, p) for t, x in found for p in range(pieces[t][x])]
                    if not out:
                        continue
                    same = [columns["q"][i], columns["vector"][i], homes.tobytes(), columns["bound"][i]]
                    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(list(c), pa.int32()) for c in zip(*out)), *(pa.array([v] * len(out), x) for v, x in zip(same, kinds))],
                        names=[*keys, "q", "query", "homes", "bound"],
                    )

        return walk

    def rank(homely: bool):
        """Home leaves: the nearest k + 1 points to each query. Others: the points within its bound that lie in no home leaf of it."""

        def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
            names, kinds = ["q", "point", "score"], [pa.int64(), pa.int64(), pa.float64()]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], x) for x in kinds], names=names)
            base, points_of = matrix(left.column("vector").combine_chunks()), left.column("point").to_numpy()
            asks, ids = matrix(right.column("query").combine_chunks()), right.column("q").to_numpy()
            homes_of, homes = (
                np.frombuffer(b"".join(c.column("homes").to_pylist()), "<i4").reshape(c.num_rows, -1) for c in (left, right)
            )
            bounds = right.column("bound").to_numpy()
            found: list[tuple] = []
            most, tree = min(k, len(base) - 1), key[0].as_py()
            for at in range(0, len(asks), 16):
                d = np.sqrt(((asks[at : at + 16, None, :] - base[None, :, :]) ** 2).sum(axis=2))
                shared_homes = homes_of[None, :, :] == homes[at : at + 16, None, :]
                if homely:
                    # All points up to the (k + 1)-th distance, ties included; one that an earlier tree's home leaf holds too is given there.
                    good = (d <= np.partition(d, most, axis=1)[:, most : most + 1]) & ~shared_homes[:, :, :tree].any(axis=2)
                else:
                    good = (d <= bounds[at : at + 16, None]) & ~shared_homes.any(axis=2)
                i, j = np.nonzero(good)
                found.append((ids[at + i], points_of[j], d[i, j]))
            return pa.table([pa.array(np.concatenate(c), x) for c, x in zip(zip(*found), kinds)], names=names)

        return compare

    named = kept(asked.withColumn("q", F.min("id").over(Window.partitionBy("vector"))), spark)
    one = named.filter("id = q").select("q", "vector")
    spread = placed.mapInArrow(cut, located + ", piece int").groupBy(*keys)
    scored = "q long, point long, score double"
    first = one.withColumn("bound", F.lit(None).cast("double")).mapInArrow(visit(True), visits)
    near = kept(spread.cogroup(first.groupBy(*keys)).applyInArrow(rank(True), scored), spark)
    order = Window.partitionBy("q").orderBy("score", "point")
    # The (k + 1)-th point bounds the k-th other row; with fewer points nothing is bounded.
    bound = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k + 1).select("q", F.col("score").alias("bound"))
    second = one.join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).mapInArrow(visit(False), visits)
    far = spread.cogroup(second.groupBy(*keys)).applyInArrow(rank(False), scored)
    pairs = near.unionByName(far.distinct())
    # An id among the first k belongs to one of the first k + 1 points by (score, smallest id).
    best = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    rows_of = best.join(points.select("point", "ids"), "point").select("q", F.explode("ids").alias("id"), "score")
    found = named.select(F.col("id").alias("query_id"), "q").join(rows_of, "q").filter("id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.select("query_id", "id", "score").withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
