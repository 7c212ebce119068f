"""Thresholds by group on the whole grid."""

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evaluate as ev


@pytest.mark.parametrize("floor, want", [(0.9, {"x": 0.33, "y": 0.05}), (2.0, {"x": 0.33, "y": 0.05})])
def test_a_threshold_for_each_group_between_the_tens(spark, floor, want):
    """Of group x the best threshold is 0.33, of group y, with false scores above all true ones, the highest of full recall."""
    rows = [("x", 0.33, 1), ("x", 0.32, 0), ("x", 0.9, 1), ("y", 0.05, 1), ("y", 0.5, 0)]
    counts = ev.score_counts(spark.createDataFrame(rows, "g string, score double, label int"), ["g"])
    got = ev.select_threshold(ev.threshold_sweep(counts, ["g"], range(1, 100)), floor, ["g"])
    assert {r.g: round(r.threshold, 2) for r in got.select("g", F.col("threshold")).collect()} == want
