"""Evenly spaced sample of histories, trimmed to a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.anchors import is_anchor
from wayfold.operators.ordering import positions

# Sample size and budget.
SAMPLE, BUDGET, KEPT_ALWAYS = 16, 34_000, 2


def sample(histories: DataFrame, order: str, projection: Column, *, count: int = SAMPLE, budget: int = BUDGET) -> DataFrame:
    """(order, pos, projected): at most ``count`` rows over the whole table.

    The last rows are dropped while the texts together exceed the budget; two
    always stay. Only the order column is numbered; the texts are fetched for the
    sampled rows.
    """
    placed = positions(histories.select(order), [], order)
    chosen = placed.filter(is_anchor(F.col("pos"), F.col("group_rows"), count)).select(order, "pos")
    rows = histories.join(F.broadcast(chosen), order).select(order, "pos", projection.alias("projected"))
    # At most ``count`` rows remain, so one running sum is enough.
    running = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("_size", F.sum(F.length("projected")).over(running)).withColumn(
        "_n", F.row_number().over(Window.orderBy("pos"))
    )
    return sized.filter((F.col("_size") <= budget) | (F.col("_n") <= KEPT_ALWAYS)).drop("_size", "_n")
