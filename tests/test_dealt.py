"""Partitions of sessions follow the counted rows."""

from pyspark.sql import functions as F

from flowspark.functions import tables
from flowspark.operators import incidents as inc
from flowspark.operators import policies as po

KEYS = ["src", "dst", "dport"]


def test_sessions_follow_the_rows(spark, monkeypatch):
    df = spark.range(400).selectExpr("id * 37 % 900 t", "id % 23 src", "id % 3 dst", "id % 2 dport", "double(id * 7919 % 100) / 100 score", "int(id % 3 = 0) label", "concat('c', id % 4) cat", "concat('p', id % 2) period")
    takes = {
        "evidence": lambda: inc.evidence(inc.gap_sessions(df, KEYS, 30, rows=df.count()), [*KEYS, "session"]),
        "stages": lambda: po.stage_comparison(df, KEYS, 30, 0.1, 0.4),
        "effect": lambda: po.promotion_effect(df, KEYS, 30, 0.1, 0.4, po.capture_hours(df)),
        "categories": lambda: po.category_metrics(df, KEYS, 30, 0.1, 0.4),
    }
    rounded = lambda d: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
    few = {k: rounded(f()) for k, f in takes.items()}
    monkeypatch.setattr(tables, "ROWS", 10)
    many = {k: rounded(f()) for k, f in takes.items()}
    assert many == few
    plans = {k: f()._jdf.queryExecution().executedPlan().toString() for k, f in takes.items()}
    assert takes["evidence"]().rdd.getNumPartitions() == 40
    assert all(", 40), REPARTITION_BY_NUM" in p for p in plans.values())
    # over all attacks only, no row is doubled for a category that is dropped
    assert "Generate explode(array(ALL_ATTACKS" not in plans["effect"] and "Generate explode(array(ALL_ATTACKS" in plans["categories"]


def test_stacker_fits_rows_in_partitions_that_follow_them(spark, monkeypatch):
    from flowspark.plans import learning

    class Seen(Exception):
        pass

    def seen(a, *more):
        raise Seen(a.rdd.getNumPartitions(), a.storageLevel.useMemory)

    monkeypatch.setattr(tables, "ROWS", 300)
    monkeypatch.setattr(learning, "fit", seen)
    rows = learning.split(spark, "/root/testdata/sf0.001")[0].count()
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    try:
        learning.stacker(spark, "/root/testdata/sf0.001")
        raise AssertionError("no fit")
    except Seen as e:
        assert e.args == (-(-rows // 300), True) and rows > 3000
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
