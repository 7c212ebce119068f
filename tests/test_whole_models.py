"""Grids and rounds of models are whole."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowspark.operators import ml
from flowspark.plans import learning


def test_every_weight_of_the_grid_is_fitted(spark):
    """Each of the five weights of the reference, and 4; what a weight gives does not depend on the others."""
    got = {r.weight: r for r in learning.weight_sweep(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == [1.0, 1.25, 1.5, 2.0, 3.0, 4.0]
    later = learning.split(spark, "/root/testdata/sf0.001")[1].count()
    assert {r.tn + r.fp + r.fn + r.tp for r in got.values()} == {later}
    recalls = [got[w].tp / (got[w].tp + got[w].fn) for w in sorted(got)]
    assert recalls == sorted(recalls) and recalls[0] < recalls[-1]
    alone = pytest.MonkeyPatch()
    alone.setattr(learning, "WEIGHTS", (1.5,))
    try:
        assert learning.weight_sweep(spark, "/root/testdata/sf0.001").first() == got[1.5]
    finally:
        alone.undo()


def test_boosted_trees_of_the_stacker_have_all_rounds(spark, monkeypatch):
    given, real = [], ml.fit_binned

    def seen(rows, columns, trees):
        given.append((trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize()))
        return real(rows, columns, trees.setMaxIter(2))  # two are enough to see the rest run

    monkeypatch.setattr(learning.ml, "fit_binned", seen)
    got = {r.model for r in learning.stacker(spark, "/root/testdata/sf0.001").collect()}
    assert given == [(100, 3, 0.05)] and got == {"logistic", "boosted"}


def test_binned_counts_give_the_trees_of_the_rows(spark):
    """Values of few kinds, so that Spark's own splits are the edges; the rarest is one row of 20,000."""
    rows = spark.range(20_000).select((F.col("id") % 9).cast("double").alias("x"), F.when(F.col("id") == 777, 50.0).otherwise(F.col("id") * 7919 % 13).alias("z"), F.lit(1.0).alias("same"))
    rows = rows.withColumn("label", ((F.col("x") * 3 + F.col("z") * 2 + F.xxhash64("x", "z") % 9) > 20).cast("int"))
    assert ml.bin_edges(rows, ["x", "z", "same"]) == {"x": [float(k) for k in range(1, 9)], "z": [*(float(k) for k in range(1, 13)), 50.0], "same": [1.0]}
    assert ml.bin_edges(spark.range(101).select(F.col("id").alias("x")), ["x"], 4) == {"x": [25.0, 50.0, 75.0]}
    trees = ml.boosted(4).setLabelCol("label")
    counted = ml.fit_binned(rows, ["x", "z", "same"], trees)
    plain = Pipeline(stages=[VectorAssembler(inputCols=["x", "z", "same"], outputCol="features"), trees.copy({trees.maxBins: 150})]).fit(rows)
    p = lambda model: [r.p for r in ml.scored(model, rows).groupBy("x", "z").agg(F.max("p").alias("p")).orderBy("x", "z").collect()]
    assert p(counted) == pytest.approx(p(plain), abs=1e-9)
    with pytest.raises(ValueError):
        ml.fit_binned(rows, ["x"], trees.copy({trees.subsamplingRate: 0.5}))
