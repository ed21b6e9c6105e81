"""A probe whose end has no assignment stops the scoring; states may still be missing."""

import pytest
from wayfold.operators import probes

PROBE = "left_id string, right_id string"


def test_absent_end_stops(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "z")], PROBE)
    states = spark.createDataFrame([("a", "s"), ("b", "s")], "history_id string, state_id string")
    with pytest.raises(Exception, match="no assignment"):
        probes.offered_pairs(rows, states).collect()


def test_missing_state_is_no_match(spark):
    rows = spark.createDataFrame([("a", "b")], PROBE)
    states = spark.createDataFrame([("k", "a", None), ("k", "b", None)], "candidate_id string, history_id string, state_id string")
    assert [r["offered"] for r in probes.offered_pairs(rows, states).collect()] == [False]
