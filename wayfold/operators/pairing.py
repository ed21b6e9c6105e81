"""Pairing of two bags of rows whose numeric cells may differ within a tolerance.

Rows are counted per distinct value first. ``candidates`` joins both sides through a grid: every numeric
cell has a place on a scale on which close values are at most ``REACH`` apart (linear up to 1,
logarithmic beyond), the scale is cut into cells of ``WIDTH``, and a left row also enters the next
cell where it lies within reach of the border, so each close pair meets exactly once. ``most_pairs``
then gives the size of a largest pairing per group: mostly all rows are each other's nearest
and nothing is left; groups where they aren't are solved exactly, component by component,
with augmenting paths.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import cut_lineage

# Fixed value: tolerance of the published protocol.
TOLERANCE = 1e-6
#: On the scale close values are at most so far apart; the excess covers rounding.
REACH = TOLERANCE * 1.001
WIDTH = 16 * REACH
#: Keeps zero and short decimals off the borders of cells.
SHIFT = 0.3819660112501051
#: More numeric columns are tested but take no part in the grid, as a row near the borders of all would be copied too often.
GRID_COLUMNS = 6
NO_NUMBER = -(2**62)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def close(left: Column, right: Column) -> Column:
    """Equal, or finite numbers within the larger of the absolute and the relative tolerance; null equals only null."""
    gap = F.abs(left - right)
    scale = F.greatest(F.abs(left), F.abs(right)) * TOLERANCE
    near = finite(left) & finite(right) & (gap <= F.greatest(F.lit(TOLERANCE), scale))
    return left.eqNullSafe(right) | F.coalesce(near, F.lit(False))


def _place(value: Column) -> Column:
    """Position in units of a cell's width."""
    scale = F.when(F.abs(value) <= 1, value).otherwise(F.signum(value) * (F.ln(F.abs(value)) + 1))
    return scale / WIDTH + SHIFT


def _odd(value: Column) -> Column:
    """Cell of a value that is no finite number; null for finite ones."""
    return (
        F.when(value.isNull(), F.lit(NO_NUMBER)).when(F.isnan(value), F.lit(NO_NUMBER + 1))
        .when(value == float("inf"), F.lit(NO_NUMBER + 2)).when(value == float("-inf"), F.lit(NO_NUMBER + 3))
    )


def cell(value: Column) -> Column:
    return F.coalesce(_odd(value), F.floor(_place(value)).cast("long"))


def cells_in_reach(value: Column) -> Column:
    """The cells that can hold a close value: the own one, and the next where the border is near."""
    place, own = _place(value), cell(value)
    past = place - F.floor(place)
    near = REACH / WIDTH
    return (
        F.when(_odd(value).isNotNull(), F.array(own)).when(past <= near, F.array(own, own - 1))
        .when(past >= 1 - near, F.array(own, own + 1)).otherwise(F.array(own))
    )


def _id(side: str, by: Sequence[str], names: Sequence[str], of: Sequence[str]) -> Column:
    return F.md5(F.to_json(F.struct(F.lit(side).alias("side"), *by, "_key", *[F.col(c).alias(n) for c, n in zip(of, names)])))


def candidates(left: DataFrame, right: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, lid, rid, ln, rn, gap) of all close pairs of distinct rows.

    ``left``: by, _key, names, n (distinct rows and how often); ``right`` the same without ``by``,
    whose rows belong to every group of ``by``.
    """
    grid, there = list(names[:GRID_COLUMNS]), [f"_r{n}" for n in names]
    moved = right.select("_key", *[F.col(n).alias(t) for n, t in zip(names, there)], F.col("n").alias("rn"))
    wide = left.withColumnRenamed("n", "ln")
    for k, name in enumerate(grid):
        wide = wide.withColumn(f"_c{k}", F.explode(cells_in_reach(F.col(name))))
        moved = moved.withColumn(f"_c{k}", cell(F.col(f"_r{name}")))
    met = wide.join(moved, ["_key", *[f"_c{k}" for k in range(len(grid))]])
    gap = F.lit(0.0)
    for name, other in zip(names, there):
        met = met.filter(close(F.col(name), F.col(other)))
        size = F.greatest(F.lit(1.0), F.abs(F.col(name)), F.abs(F.col(other)))
        gap = gap + F.when(F.col(name).eqNullSafe(F.col(other)), 0.0).otherwise(F.abs(F.col(name) - F.col(other)) / size)
    return met.select(*by, _id("l", by, names, names).alias("lid"), _id("r", by, names, there).alias("rid"), "ln", "rn", gap.alias("gap"))


def largest_pairing(edges: Sequence[tuple[str, str]], ln: dict[str, int], rn: dict[str, int]) -> int:
    """How many rows can be paired along the edges when each end takes part as often as it occurs; augmenting paths."""
    ways = defaultdict(list)
    for a, b in edges:
        ways[a].append(b)
    need, free = dict(ln), dict(rn)
    used: dict[str, dict[str, int]] = defaultdict(dict)  # right end -> rows of each left end paired with it
    paired = 0
    for start in need:
        while need[start]:
            came: dict[str, str] = {}  # right end -> left end it was reached from
            via: dict[str, str] = {}  # left end -> right end that could let it go
            waiting, end = deque([start]), None
            while waiting and end is None:
                a = waiting.popleft()
                for b in ways[a]:
                    if b in came:
                        continue
                    came[b] = a
                    if free[b]:
                        end = b
                        break
                    for other, n in used[b].items():
                        if n and other != start and other not in via:
                            via[other] = b
                            waiting.append(other)
            if end is None:
                break
            steps, b = [], end
            while True:
                a = came[b]
                steps.append((a, b))
                if a == start:
                    break
                b = via[a]
            amount = min([need[start], free[end], *[used[via[a]][a] for a, _ in steps[:-1]]])
            for a, b in steps:
                used[b][a] = used[b].get(a, 0) + amount
                if a != start:
                    used[via[a]][a] -= amount
            need[start] -= amount
            free[end] -= amount
            paired += amount
    return paired


def clusters(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(lid, cluster) of every left end: the smallest left end of its connected component.

    Every round takes the smallest label among left ends that share a right end, then that label's own
    label, so labels travel twice as far each time. Rounds are checkpointed.
    """
    ends = cut_lineage(edges.select("lid", "rid").distinct())
    labels = cut_lineage(ends.select("lid").distinct().withColumn("cluster", F.col("lid")))
    for _ in range(rounds):
        at_right = ends.join(labels, "lid").groupBy("rid").agg(F.min("cluster").alias("cluster"))
        seen = ends.join(at_right, "rid").groupBy("lid").agg(F.min("cluster").alias("cluster"))
        onward = seen.select(F.col("lid").alias("_of"), F.col("cluster").alias("_next"))
        nxt = cut_lineage(
            seen.join(onward, F.col("cluster") == F.col("_of"), "left").select("lid", F.least("cluster", F.coalesce("_next", "cluster")).alias("cluster"))
        )
        moved = nxt.join(labels.withColumnRenamed("cluster", "_old"), "lid").filter("cluster <> _old").isEmpty()
        labels = nxt
        if moved:
            return labels
    raise RuntimeError("the clusters did not settle")


def exact_pairs(edges: DataFrame, by: Sequence[str], largest: int) -> DataFrame:
    """(by, hits) by augmenting paths inside every connected component of the edges."""
    edges = edges.join(clusters(edges), "lid")
    sizes = edges.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > largest:
        raise ValueError(f"{sizes} close pairs hang together; more than max_cluster={largest} are not solved in one task")

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = largest_pairing(
            list(zip(group["lid"], group["rid"])), dict(zip(group["lid"], group["ln"])), dict(zip(group["rid"], group["rn"]))
        )
        return pd.DataFrame({**{name: [value] for name, value in zip(by, key)}, "hits": [int(found)]})

    kinds = dict(edges.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "hits long"])
    solved = edges.groupBy(*by, "cluster").applyInPandas(solve, schema)
    return solved.groupBy(*by).agg(F.sum("hits").alias("hits"))


def most_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], names: Sequence[str], max_cluster: int) -> DataFrame:
    """(by, hits): rows of the left side that a largest pairing covers, per group of ``by`` (one row without ``by``).

    Groups that some row of has no close partner at all get the rows that have one; they can't be covered anyway.
    """
    by = list(by)
    edges = cut_lineage(candidates(left, right, by, names))
    ahead = edges.groupBy(*by, "lid").agg(F.first("ln").alias("ln"), F.min_by("rid", F.struct("gap", "rid")).alias("rid"))
    back = edges.groupBy("rid").agg(F.first("rn").alias("rn"), F.min_by("lid", F.struct("gap", "lid")).alias("_best"))
    both = ahead.join(back, "rid", "left")
    same = (F.col("_best") == F.col("lid")) & (F.col("ln") == F.col("rn"))
    total = left.groupBy(*by).agg(F.sum("n").alias("rows"))
    quick = both.groupBy(*by).agg(F.sum("ln").alias("covered"), F.sum(F.when(same, F.col("ln")).otherwise(0)).alias("hits"))
    state = cut_lineage(
        total.join(quick, by, "left") if by else total.join(F.broadcast(quick))  # one row each
    )
    open_groups = state.filter((F.col("covered") == F.col("rows")) & (F.col("hits") < F.col("rows")))
    settled = state.select(*by, F.least(F.coalesce("hits", F.lit(0)), F.coalesce("covered", F.lit(0))).alias("hits"))
    if open_groups.isEmpty():
        return settled
    if not by:
        return exact_pairs(edges, by, max_cluster)
    exact = exact_pairs(edges.join(open_groups.select(*by), by, "left_semi"), by, max_cluster)
    return settled.join(open_groups.select(*by), by, "left_anti").unionByName(exact)
