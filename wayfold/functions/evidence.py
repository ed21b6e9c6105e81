"""Evidence algebra: tiers, effective labels and joint labels.

A label never moves up a tier: a model's label stays a proxy, even when audited,
and an unaudited measurement stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("supported", "contradicted", "unknown")
METHODS = ("execution", "programmatic", "human", "llm", "synthetic")
MODES = ("grounded", "proxy", "synthetic")


def tier(label: Column, method: Column, independent: Column, audited: Column) -> Column:
    return (
        F.when(~independent | (label == "unknown"), "unknown")
        .when(method == "synthetic", "synthetic")
        .when(method == "llm", "proxy")
        .when(audited, "grounded")
        .otherwise("unknown")
    )


def effective(label: Column, tier_col: Column, mode: Column | str) -> Column:
    """The label if its tier is grounded or the mode itself, else unknown."""
    if isinstance(mode, str):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        mode = F.lit(mode)
    return F.when((tier_col == "grounded") | (tier_col == mode), label).otherwise("unknown")


def joint(first: Column, second: Column) -> Column:
    """Contradicted if either is, supported if both are, else unknown."""
    return (
        F.when((first == "contradicted") | (second == "contradicted"), "contradicted")
        .when((first == "supported") & (second == "supported"), "supported")
        .otherwise("unknown")
    )


def valid_evidence(label: Column, method: Column, source_ref: Column) -> Column:
    return label.isin(*LABELS) & method.isin(*METHODS) & (F.coalesce(source_ref, F.lit("")) != "")
