"""What searches and folds do once, however many candidates or models there are."""

import pytest
from pyspark.sql import functions as F

from flowspark.operators import ml


def test_strategies_that_give_one_number():
    assert [ml.features_per_node(s, 6) for s in ("sqrt", "log2", "0.5", "all", "onethird", "2", "9", "1.0")] == [3, 3, 3, 6, 2, 2, 6, 6]


def test_candidates_that_cannot_differ_share_their_fits(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"), (F.col("id") % 7 + F.col("id") % 11 > 8).cast("int").alias("label"), (F.col("id") % 2).cast("int").alias("fold"))
    one = {"maxDepth": 2, "minInstancesPerNode": 1, "numTrees": 2}
    candidates = [one | {"featureSubsetStrategy": s} for s in ("sqrt", "all", "1.0")] + [one | {"featureSubsetStrategy": "0.5"}]
    fits, fitted = [], ml.fitted
    monkeypatch.setattr(ml, "fitted", lambda tasks, *more: fits.append((len(tasks), more[0])) or fitted(tasks, *more))
    monkeypatch.setattr(ml, "FITTED_ROWS", 600)
    got = {r.candidate: r.asDict() for r in ml.search(df, ["x", "z"], candidates, folds=2, parallelism=5).collect()}
    # sqrt, all and 1.0 look at both features, 0.5 at one; two fits at a time have 600 rows
    assert fits == [(4, 2)] and sorted(got) == ["c00", "c01", "c02", "c03"]
    alone = ml.search(df, ["x", "z"], candidates[1:2], folds=2).first().asDict()
    for name in ("recall", "fpr", "roc_auc", "average_precision"):
        assert got["c00"][name] == got["c01"][name] == got["c02"][name] == pytest.approx(alone[name])
    assert "all" in got["c01"]["settings"] and "1.0" in got["c02"]["settings"]


def test_counts_stand_for_rows(spark):
    rows = spark.range(600).select((F.col("id") % 9).cast("double").alias("x"), (F.col("id") * 7919 % 13 < F.col("id") % 9 + 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    for k in (0, 1):
        read = {"read": ["x"]} if k else {}
        got = ml.out_of_fold(rows, 3, [*ml.prepare(["x"], []), ml.logistic(labelCol="label")], **read).groupBy("fold", "x").agg(F.count("*").alias("n"), F.max("p").alias("p")).orderBy("fold", "x").collect()
        if k == 0:
            first = got
    assert [(r.fold, r.x, r.n) for r in got] == [(r.fold, r.x, r.n) for r in first] and [r.p for r in got] == pytest.approx([r.p for r in first], abs=1e-6)
    with pytest.raises(ValueError):
        ml.fit_counted(None, rows, ml.logistic(labelCol="label", regParam=0.1), "n")


def test_folds_are_dealt_once_and_narrow(spark, monkeypatch):
    """What the models read is a written table of three columns, so that no pass sorts again."""
    from flowspark.plans import learning

    given = []
    real = ml.out_of_fold
    monkeypatch.setattr(learning.ml, "out_of_fold", lambda d, *a, **b: given.append(d) or real(d, *a, **b))
    learning.oof_scores(spark, "/root/testdata/sf0.001")
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert given[0].columns == ["fold", "label", "score"] and "Window" not in plan and "Join" not in plan


def test_pairs_of_scores_are_counted_before_they_are_blended(spark):
    from flowspark.operators import evaluate as ev

    df = spark.range(1000).selectExpr("double(id % 4) / 4 score", "double(id % 3) / 4 score_b", "int(id % 2) label")
    counts = ev.blend_counts(df, [0.0, 0.5, 1.0])
    assert counts.count() == 12 * 4 and {r.n for r in counts.groupBy("candidate").agg(F.sum("n").alias("n")).collect()} == {1000}
    one = lambda d, n: sorted(map(tuple, ev.score_counts(d, ["candidate"], score="s", decimals=6, n=n).collect()))
    long = ev.blends(df, [0.0, 0.5, 1.0])
    assert one(counts, "n") == one(long, None)
    rates = lambda d, n: sorted(map(str, ev.confusion(d.withColumn("predicted", (F.col("s") >= 0.5).cast("int")), ["candidate"], n=n).collect()))
    assert rates(counts, "n") == rates(long, None)


def test_partitions_of_a_search_follow_rows_and_cores_and_models_go(spark, monkeypatch):
    """Many small partitions are joined before the fits, and what a model scores is written by its own task."""
    df = spark.range(0, 400, 1, 40).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"), (F.col("id") % 2).cast("int").alias("fold"))
    fits, results, real_scored, fitted = [], [], ml.scored, ml.fitted
    monkeypatch.setattr(ml, "scored", lambda model, rows, *more: fits.append(rows.rdd.getNumPartitions()) or real_scored(model, rows, *more))
    monkeypatch.setattr(ml, "fitted", lambda *a: results.extend(fitted(*a)) or results)
    got = ml.search(df, ["x"], [{"maxDepth": 1, "numTrees": 1, "subsamplingRate": 1.0, "minInstancesPerNode": 1}], folds=2).first()
    assert fits == [spark.sparkContext.defaultParallelism] * 2 and got.recall == got.roc_auc == 1.0
    assert all(set(r.columns) == {"fit", "fold", "hit", "s", "pos", "neg"} and r.inputFiles() for r in results)
    monkeypatch.setattr(ml, "PART_ROWS", 20)
    fits.clear()
    ml.search(df, ["x"], [{"maxDepth": 1, "numTrees": 1}], folds=2)
    assert fits == [20, 20]
