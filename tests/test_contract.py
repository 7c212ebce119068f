import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowspark.operators import contract as ct
from flowspark.operators import ml, profile
from flowspark.operators.validate import InvalidInput, check_header
from flowspark.sources import files


def test_the_contract_has_128_features_in_order():
    assert [len(x) for x in (ct.BASELINE, ct.STATIC, ct.TEMPORAL, ct.MODEL)] == [76, 9, 43, 128] and len(set(ct.MODEL)) == 128
    assert not set(ct.IDENTIFIERS) & set(ct.MODEL)


def test_from_csv_to_vectors(spark, tmp_path):
    """A flow CSV is validated, its features made in order, the vector is of floats, scores go back to the rows."""
    names = ["Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp", *ct.BASELINE, "Label"]
    rows = [[f"f{k}", f"10.0.0.{k % 2}", 40000 + k, "10.1.1.1", 80, 6, f"20/08/2026 01:00:{5 * (k // 2):02d} PM", *(k + j for j in range(76)), "Benign"] for k in range(6)]
    text = "\n".join(",".join(f'"{x}"' for x in r) for r in [names, *rows])
    (tmp_path / "flows.csv").write_text(text + "\n")
    flows = files.read_flow_csv(spark, str(tmp_path / "flows.csv"), ct.FLOW)
    assert "Label" not in flows.columns
    table = ct.model_table(flows.withColumn("row", F.substring("Flow ID", 2, 9).cast("long")), "row")
    assert tuple(table.columns) == (*ct.IDENTITY, *ct.MODEL)
    got = table.orderBy("source_row_id").collect()
    assert [r.src_conn_10s for r in got] == [0, 0, 1, 1, 2, 2] and [r.dst_conn_60s for r in got] == [0, 0, 2, 2, 4, 4]
    assert got[2].src_bytes_60s == (0 + 3) + (0 + 4) and got[3]["Total Fwd Packet"] == 4.0 and got[0].timestamp == dt.datetime(2026, 8, 20, 13)
    vectors = table.select("source_row_id", ct.model_vector(table).alias("v"))
    assert dict(vectors.dtypes)["v"] == "array<float>" and len(vectors.first().v) == 128
    with pytest.raises(PySparkException, match="not finite: Flow Duration"):
        table.withColumn("Flow Duration", F.lit(1e300)).select(ct.model_vector(table)).collect()
    scores = vectors.select("source_row_id", (F.col("v")[0] / 10).cast("double").alias("score")).orderBy(F.desc("source_row_id"))
    back = ct.in_source_order(table, scores, "source_row_id").select("source_row_id", "score").collect()
    assert [(r.source_row_id, round(r.score, 6)) for r in back] == [(k, k / 10) for k in range(6)]
    for wrong in (scores.limit(5), scores.unionByName(scores.limit(1)), scores.withColumn("source_row_id", F.col("source_row_id") + 1)):
        with pytest.raises(PySparkException, match="no single score"):
            ct.in_source_order(table, wrong, "source_row_id").collect()


def test_output_checks(spark):
    df = spark.createDataFrame([(1.0, 0, "x"), (2.0, 1, "y")], "a double, label int, attack_cat string")
    check = lambda d, n=2, columns=("a", "label", "attack_cat"): ct.check_output(d, list(columns), n, context=("a",))
    assert sorted(map(tuple, check(df).collect())) == [("x", 0, 1), ("y", 1, 1)]
    for bad in (df.withColumn("a", F.lit(float("nan"))), df.withColumn("label", F.lit(2)), df.withColumn("attack_cat", F.lit(None).cast("string")), df.limit(1), df.drop("a")):
        with pytest.raises(ValueError):
            check(bad)
    with pytest.raises(ValueError, match="identifiers"):
        check(df.withColumn("Src IP", F.lit("x")), columns=("a", "label", "attack_cat", "Src IP"))
    features, target = ct.features_and_target(df.withColumn("id", F.lit(1)))
    assert features.columns == ["a"] and target.columns == ["label"]
    with pytest.raises(ValueError):
        ct.features_and_target(df.where("label = 1"))


def test_headers_with_commas_in_names():
    assert check_header('"a,b","c"') == ["a,b", "c"]
    with pytest.raises(InvalidInput):
        check_header('"a,b","a,b"')


def test_days_are_pruned_and_counted(spark, tmp_path):
    at = dt.datetime(2024, 1, 17, 5)
    df = spark.createDataFrame([(k, at + dt.timedelta(hours=12 * k)) for k in range(5)], "id long, ts timestamp_ntz")
    files.write_by_day(df, str(tmp_path / "d"), "ts")
    day = files.read_day(spark, str(tmp_path / "d"), "2024-01-18", expected=2)
    assert sorted(r.id for r in day.collect()) == [2, 3] and day.columns == df.columns
    assert "PartitionFilters: [isnotnull(capture_date" in day._jdf.queryExecution().toString()
    with pytest.raises(InvalidInput):
        files.read_day(spark, str(tmp_path / "d"), "2024-01-18", expected=3)
    assert files.routed(df, "ts", "2024-01-17").where("on_day").count() == 2


def test_order_of_time_across_pieces_and_files(spark):
    times = [("a", k, t) for k, t in enumerate([1, 2, 2, 1, 5, None, 4])] + [("b", k, t) for k, t in enumerate([3, 9])]
    df = spark.createDataFrame(times, "file string, row long, t long")
    for piece in (2, 3, 100):
        r = profile.order_of_time(df, "t", "file", "row", piece).first()
        assert (r.invalid, r.is_sorted) == (1, False) and 2 <= r.reversals <= 3
    assert profile.order_of_time(df.where("file = 'b'"), "t", "file", "row").first().is_sorted


def test_candidates(spark):
    shape = "candidate string, recall double, fpr double, average_precision double, f1 double"
    rows = [("a", 0.98, 0.0205, 0.9, 0.8), ("b", 0.976, 0.02, 0.8, 0.9), ("c", 0.99, 0.05, 0.99, 0.99), ("d", 0.9, 0.001, 0.99, 0.99)]
    got = {r.candidate: (r.eligible, r.selected, r["rank"]) for r in ml.select_candidate(spark.createDataFrame(rows, shape)).collect()}
    assert got == {"a": (True, True, 2), "b": (True, False, 1), "c": (True, False, 3), "d": (False, False, 4)}
    low = [(c, r - 0.05, f, p, x) for c, r, f, p, x in rows] + [("e", 0.939, 0.01, 0.1, 0.1)]
    got = {r.candidate: r.selected for r in ml.select_candidate(spark.createDataFrame(low, shape)).collect()}
    assert got == {"a": False, "b": False, "c": False, "d": False, "e": True}  # within 0.002 of the best recall, at the lowest rate


def test_folds_and_coverage(spark):
    df = spark.range(100).select((F.col("id") / 2).cast("long").alias("t"), "id")
    folds = ml.temporal_folds(df, "t", [20, 30, 40], 5)
    ml.check_temporal_folds(folds, "t", 5)
    with pytest.raises(ValueError):
        ml.check_temporal_folds(folds.withColumn("role", F.lit("train")), "t", 5)
    with pytest.raises(ValueError):
        ml.check_temporal_folds(folds, "t", 0)
    ml.check_purge(df, "t", 3)
    with pytest.raises(ValueError):
        ml.check_purge(df, "t", 2)
    ml.check_coverage(df, df, ["id"])
    for bad in (df.limit(99), df.unionByName(df.limit(1))):
        with pytest.raises(ValueError):
            ml.check_coverage(df, bad, ["id"])
    assert len({str(c) for c in ml.draw_candidates({"a": [1, 2, 3], "b": [1, 2, 3, 4]}, 12, 1)}) == 12 == len(ml.draw_candidates({"a": list(range(5)), "b": list(range(5))}, 12, 1))


def test_late_baseline_columns_stay_out_of_the_shuffles(spark):
    """Columns that follow from others are made after the windows: no shuffle or sort below them carries them."""
    from flowspark.plans import tables

    table = tables.metered(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = table._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    below = plan[plan.index("RepartitionByExpression"):]
    assert "Idle Min" in plan
    assert "Flow Duration" not in below
    assert "Idle Min" not in below
    row = table.where("source_row_id is not null").first()
    part = int(row.source_row_id.split("-")[2])
    assert [row[c] for c in ct.BASELINE] == [part * (k + 3) % 997 for k in range(76)]


def test_learning_stores_no_column_that_follows_from_the_part(spark):
    from flowspark.plans import learning

    d, names = learning.metered(spark, "/root/testdata/sf0.001")
    stored = spark.read.parquet(*d.inputFiles()).columns
    assert not {names[c] for c in ct.BASELINE} & set(stored) and {names[c] for c in ct.TEMPORAL} < set(stored)
    assert len(d.columns) == 130


def test_shuffles_carry_nothing_that_follows_from_other_columns(spark):
    """Inputs of features, classes of ports and quotients are made after the shuffles; windows by like keys share a sort."""
    from flowspark.plans import tables

    table = tables.metered(spark, "/root/testdata/sf0.001")
    plan = table._jdf.queryExecution().optimizedPlan()
    dealt, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "RepartitionByExpression":
            dealt.append([node.output().apply(i).name() for i in range(node.output().size())])
    raw = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "Protocol", "Timestamp"]
    wide, narrow = sorted(dealt, key=len, reverse=True)
    assert narrow == raw and wide[:6] == raw and len(wide) == 6 + 19
    assert not [c for c in wide if "ratio" in c or "mean" in c or "diversity" in c]
    assert table._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 6


def test_columns_made_after_the_shuffles_give_the_same_features(spark):
    from flowspark.operators.features import causal, flow_features

    df = spark.range(600).selectExpr("id", "id * 37 % 211 t", "if(id % 50 = 7, null, id % 7) src", "id % 5 dst", "id % 3 sport", "id % 2 dport", "6 + 11 * (id % 2) proto", "if(id % 9 = 4, null, id % 13 / 4.0) bytes", "id % 4 packets", "id % 2 syn", "id % 3 rst")
    made = {"bytes": F.expr("if(id % 9 = 4, null, id % 13 / 4.0)"), "dst": F.expr("id % 5"), "src": F.expr("if(id % 50 = 7, null, id % 7)"), "syn": F.expr("id % 2")}
    rows = lambda d: sorted(map(str, d.select("id", *(f.name for f in flow_features())).collect()))
    late = causal(df.drop(*made), flow_features(), made=made)
    assert late.columns == [*df.drop(*made).columns, *(f.name for f in flow_features())]
    assert rows(late) == rows(causal(df, flow_features()))
