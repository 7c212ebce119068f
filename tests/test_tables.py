import pytest
from pyspark.sql import functions as F

from flowspark.operators import align, drift, evaluate, ml, profile
from flowspark.operators.validate import Contract, InvalidInput, check_columns, check_header, validate
from flowspark.sources.files import pinned_csv_schema, read_flow_csv, with_row_id, write_report, write_summary, write_table

CONTRACT = Contract(numeric=("Flow Duration", "Bwd IAT/s"))
NAMES = ["Flow ID", "Src IP", "Dst IP", "Src Port", "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Bwd IAT/s", "Label"]
GOOD = ["f", "10.0.0.1", "10.0.0.2", "50000", "443", "6", "17/02/2015 08:00:00 PM", "1.5", "2", "Benign"]


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in NAMES))


def test_header():
    assert check_header("﻿a,b,c\r\n") == ["a", "b", "c"]
    for bad in (None, "", "a,,b", "a,b,a"):
        with pytest.raises(InvalidInput):
            check_header(bad)


def test_columns():
    assert check_columns(NAMES, CONTRACT) == ["Label"]
    with pytest.raises(InvalidInput, match="Src IP, Protocol"):
        check_columns([n for n in NAMES if n not in ("Src IP", "Protocol")], CONTRACT)
    for extra in ("flow_bytes", "stranger"):
        with pytest.raises(InvalidInput, match=extra):
            check_columns([*NAMES, extra], CONTRACT)


def test_valid_rows_are_typed(spark):
    out = validate(frame(spark, GOOD, [*GOOD[:6], "7/2/2015 8:00:01 PM", *GOOD[7:]]), CONTRACT)
    assert out.columns == NAMES[:-1] and dict(out.dtypes)["Timestamp"] == "timestamp_ntz" and dict(out.dtypes)["Src Port"] == "bigint"
    assert out.count() == 2 and validate(frame(spark), CONTRACT).count() == 0


@pytest.mark.parametrize(
    "at, bad", [(1, " "), (2, None), (3, "65536"), (3, "1.5"), (4, "-1"), (5, "256"), (5, "6.5"), (5, "x"), (6, "31/02/2015 08:00:00 PM"), (6, "2015-02-17"), (7, "nan"), (7, "Infinity"), (8, ""), (8, None)]
)
def test_bad_rows(spark, at, bad):
    row = list(GOOD)
    row[at] = bad
    with pytest.raises(InvalidInput):
        validate(frame(spark, GOOD, row), CONTRACT)


def test_csv_in_and_files_out(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("﻿" + ",".join(NAMES) + "\n" + ",".join(GOOD) + "\n", encoding="utf-8")
    df = read_flow_csv(spark, str(path), CONTRACT)
    assert df.count() == 1
    path.write_text(",".join(NAMES) + "\n")
    assert read_flow_csv(spark, str(path), CONTRACT).count() == 0
    numbers = spark.range(10).selectExpr("id", "id % 2 day")
    write_table(numbers, str(tmp_path / "t"), ["day"])
    with pytest.raises(Exception, match="exists"):
        write_table(numbers, str(tmp_path / "t"))
    write_report(numbers, str(tmp_path / "r"))
    assert pinned_csv_schema(spark, str(tmp_path / "r")).simpleString() == "struct<id:int,day:int>"
    write_summary(numbers.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 10
    assert with_row_id(spark, str(tmp_path / "t")).groupBy("file", "row_id").count().where("count > 1").count() == 0


def test_alignment_with_duplicates(spark):
    left = spark.createDataFrame([("p", 0), ("q", 1), ("q", 2), ("r", 3)], "k string, a long")
    right = spark.createDataFrame([("q", 0), ("q", 1), ("r", 2), ("p", 3)], "k string, b long")
    j = align.aligned(left, right, ["k"], ["a"], ["b"])
    assert {r.a: r.b for r in j.collect()} == {0: 3, 1: 0, 2: 1, 3: 2}
    assert align.mismatches(j, {"x": ("a", "b")}).first().asDict() == {"matched": 4, "x": 4}
    with pytest.raises(ValueError):
        align.one_to_one(left, right, ["k"])
    nulls = spark.createDataFrame([(None, 1)], "k string, a long")
    assert align.aligned(nulls, nulls.withColumnRenamed("a", "b"), ["k"], ["a"], ["b"]).count() == 1


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.01), (0, 0.10), (1, 0.09), (1, 0.80)], "label int, score double")
    r = evaluate.confusion(df.withColumn("predicted", (F.col("score") >= 0.1).cast("int")), []).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.recall, r.fpr) == (1, 1, 1, 1, 0.5, 0.5)
    none = evaluate.confusion(df.where("label = 0").withColumn("predicted", F.lit(0)), []).first()
    assert (none.precision, none.f1, none.recall) == (0.0, 0.0, None)
    one = evaluate.ranking(evaluate.score_counts(spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)], "label int, score double"), []), []).first()
    assert one.roc_auc == pytest.approx(0.875) and one.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    s = {round(r.threshold, 2): (r.tn, r.fp, r.fn, r.tp) for r in evaluate.threshold_sweep(evaluate.score_counts(df, []), [], range(10, 91, 10)).collect()}
    assert s[0.1] == (1, 1, 1, 1) and s[0.8] == (2, 0, 1, 1) and s[0.9] == (2, 0, 2, 0) and len(s) == 9
    best = evaluate.select_threshold(evaluate.threshold_sweep(evaluate.score_counts(df, []), [], range(1, 100)), 0.5).first()
    assert (best.eligible, best.fp, best.threshold) == (True, 0, 0.8)


def test_two_models(spark):
    rows = [(0, 0.8, 0.7), (0, 0.1, 0.2), (1, 0.9, 0.2), (1, 0.2, 0.9), (1, 0.8, 0.8), (1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double, score_b double")
    kinds = [r[0] for r in df.select(evaluate.overlap_kind(F.col("label"), F.col("score") >= 0.5, F.col("score_b") >= 0.5)).collect()]
    assert kinds == ["both_false_positive", "both_true_negative", "only_a_detected", "only_b_detected", "both_detected", "both_missed"]
    b = evaluate.blends(df, [0.0, 1.0])
    assert b.where("candidate = 'blend_1.00' and s <> score").count() == 0 == b.where("candidate = 'blend_0.00' and s <> score_b").count()
    assert b.where("candidate = 'max' and s <> greatest(score, score_b)").count() == 0


def test_drift(spark):
    same = spark.range(1, 101).selectExpr("explode(array('a', 'b')) population", "'f' feature", "cast(id as double) value")
    moved = same.withColumn("value", F.when(F.col("population") == "b", F.col("value") + 100).otherwise(F.col("value")))
    psi = lambda d: drift.stability_index(drift.running_counts(d)).first().psi
    assert psi(same) == pytest.approx(0) and psi(moved) > 0
    assert drift.ks_statistic(moved).first().ks == 1.0 and drift.ks_statistic(same).first().ks == 0.0
    cats = spark.createDataFrame([("a", "f", x) for x in ("tcp", "tcp", "udp")] + [("b", "f", x) for x in ("tcp", "icmp")], "population string, feature string, value string")
    s = drift.shares(cats, ["feature"], "value")
    assert s.where("na = 0").count() == 1 and s.groupBy("feature").agg(drift.js(bits=True).alias("x")).first().x > 0
    ranks = drift.mean_ranks(spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0)], "g int, v double"), ["g"], ["v"])
    assert sorted(r.rank_v for r in ranks.collect()) == [1.5, 1.5, 3.0]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (2, None, 2.0)], "row_id long, c string, v double")
    assert profile.by_kind(df) == {"numeric": ["row_id", "v"], "categorical": ["c"], "other": [], "identifier": ["row_id"]}
    d = profile.duplicates(df, df.columns).first()
    assert (d.rows, d.distinct_rows, d.duplicates) == (3, 2, 1)
    assert {r.value: r.percent for r in profile.distribution(df, "c").collect()} == {"a": 33.3333, None: 66.6667}
    assert profile.schema_differences(df, df.drop("v").withColumn("c", F.lit(1))) == [("c", "string", "int"), ("v", "double", None)]


def test_folds(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as int) label", "id t")
    s = ml.stratified_split(df, "label", F.col("id").cast("string"))
    assert {(r.label, r.part): r["count"] for r in s.groupBy("label", "part").count().collect()} == {(0, "validation"): 180, (0, "train"): 720, (1, "validation"): 20, (1, "train"): 80}
    again = ml.stratified_split(df.repartition(7), "label", F.col("id").cast("string"))
    assert s.exceptAll(again).count() == 0
    folds = ml.stratified_folds(df, "label", F.col("id").cast("string")).groupBy("fold").count().collect()
    assert sum(r["count"] for r in folds) == 1000 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 2
    t = ml.temporal_folds(df, "t", [400, 600, 800], 10)
    assert t.where("fold = 0 and role = 'train'").agg(F.max("t")).first()[0] == 389 and t.where("fold = 1 and role = 'predict'").agg(F.min("t")).first()[0] == 600
    built = []
    build = lambda: built.append(1) or df
    for _ in range(2):
        assert ml.resumable(spark, str(tmp_path / "fold=0"), "abc", build).count() == 1000
    assert built == [1]


def test_running_sums_and_quantiles(spark):
    import numpy as np

    from flowspark.operators.prefix import exact_quantiles, running_sums

    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 500, 3000) / 7, strict=True)] + [(9, 1.5), (9, None), (9, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in exact_quantiles(df, ["g"], "v", shares).collect():
        own = [v for g, v in rows if g == r.g and v is not None and v == v]
        assert r.q == pytest.approx(np.quantile(own, shares).tolist())
    counts = df.where("g < 9").groupBy("g", "v").agg(F.count("*").alias("n"))
    for down in (False, True):
        for r in running_sums(counts, ["g"], "v", ["n"], descending=down, pieces=7).collect():
            assert r.run_n == sum(g == r.g and (v >= r.v if down else v <= r.v) for g, v in rows) and r.all_n == sum(g == r.g for g, v in rows)


def histogram_psi(a, b, epsilon, again):
    """The rule written with lists: distinct deciles, open ends, special cases for one and two edges."""
    import numpy as np

    edges = np.unique(np.quantile(a, np.arange(11) / 10))
    if len(edges) == 1 and not again:
        return 0.0 if set(b) <= set(a) else float("inf")
    inner = [np.nextafter(edges[0], -np.inf), np.nextafter(edges[0], np.inf)] if len(edges) == 1 else ([] if not again else [edges[0] + (edges[1] - edges[0]) / 2]) if len(edges) == 2 else edges[1:-1]
    counts = [np.bincount(np.searchsorted(inner, x, "right"), minlength=len(inner) + 1).astype(float) for x in (a, b)]
    p, q = (np.maximum(c, epsilon) / np.maximum(c, epsilon).sum() if again else np.maximum(c / c.sum(), epsilon) for c in counts)
    return float(((q - p) * np.log(q / p)).sum())


def test_psi_of_tied_and_constant_features(spark):
    cases = {
        "zeros": ([0.0] * 95 + [1.0 * k for k in range(5)], [0.0] * 50 + [1.0 * k for k in range(50)]),
        "two": ([0.0] * 99 + [7.0], [0.0] * 3 + [7.0] * 4 + [3.0, 3.5, 9.0]),
        "one": ([3.0] * 40, [2.0] * 5 + [3.0] * 30 + [4.0] * 15),
        "same": ([3.0] * 40, [3.0] * 7),
        "tiny": ([k * 1e-12 for k in range(60)], [k * 2e-12 for k in range(60)]),
        "plain": ([float(k * k % 97) for k in range(200)], [float(k * 3 % 120) for k in range(150)]),
    }
    rows = [(f, p, v) for f, both in cases.items() for p, values in zip("ab", both, strict=True) for v in values] + [("plain", "a", None), ("plain", "b", float("nan"))]
    run = drift.running_counts(spark.createDataFrame(rows, "feature string, population string, value double"))
    two = {r.feature: r.psi for r in drift.numeric_divergences(run).collect()}
    one = {r.feature: r.psi for r in drift.stability_index(run).collect()}
    for f, (a, b) in cases.items():
        assert two[f] == pytest.approx(histogram_psi(a, b, 1e-10, True), abs=1e-9), f
        assert one[f] == pytest.approx(histogram_psi(a, b, 1e-6, False)), f
    assert two["zeros"] > 1 and one["same"] == 0 and one["one"] == float("inf") and two["tiny"] > 0


def test_drift_reads_its_input_once(spark):
    """All statistics of numeric and categorical features, in two scopes, from one pass over the rows."""
    seen = spark.sparkContext.accumulator(0)

    def rows(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    d = spark.range(0, 500, 1, 3).selectExpr("id", "if(id % 3 = 0, 'a', 'b') population", "if(id % 50 = 0, null, double(id % 17)) x", "if(id % 2 = 0, 'u', null) c", "id % 2 scope").mapInPandas(rows, "id long, population string, x double, c string, scope long")
    from flowspark.operators.prefix import running_sums

    numbers, text = drift.profile(d, ["x"], ["c"], ["scope"])
    by = ["scope", "feature"]
    run = running_sums(numbers, by, "value", ["na", "nb"])
    out = {r.scope: r for r in drift.drift_of(run, by).join(drift.moments(run, by).select(*by, "var_a", "var_b"), by).collect()}
    levels = {(r.scope, r.value): (r.na, r.nb) for r in drift.shared(text, by).collect()}
    assert seen.value == 500
    import numpy as np

    for scope in (0, 1):
        x = {p: np.array([k % 17 for k in range(500) if k % 2 == scope and (k % 3 == 0) == (p == "a") and k % 50], float) for p in "ab"}
        r = out[scope]
        assert [r.mean_a, r.mean_b, r.median_a, r.median_b, r.var_a, r.var_b] == pytest.approx([x["a"].mean(), x["b"].mean(), np.median(x["a"]), np.median(x["b"]), x["a"].var(ddof=1), x["b"].var(ddof=1)])
        grid = np.unique(np.r_[x["a"], x["b"]])
        assert r.ks == pytest.approx(max(abs((x["a"] <= v).mean() - (x["b"] <= v).mean()) for v in grid))
        kept = [k for k in range(500) if k % 2 == scope]
        assert levels[scope, "u" if scope == 0 else None] == (sum(k % 3 == 0 for k in kept), sum(k % 3 != 0 for k in kept))


def test_a_hot_fingerprint_is_ranked_in_ranges(spark, monkeypatch):
    """Half of all rows share one fingerprint: ranks and alignment are those of one window, and no group is one task."""
    monkeypatch.setattr(align, "GROUP", 50)
    rows = [((None, 1) if k % 2 else (k % 40, k % 7)) + ((k * 7919) % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, o int, id int")
    got = {r.id: r.r for r in align.duplicate_rank(df, ["a", "b"], ["o"], "r").collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(r[:2], []).append(r[3])
    assert got == {i: n + 1 for ids in groups.values() for n, i in enumerate(ids)}
    other = df.where("o % 10 <> 3").withColumnRenamed("id", "id2").withColumnRenamed("o", "o2")
    joined = align.aligned(df.where("o % 10 <> 3"), other, ["a", "b"], ["o"], ["o2"])
    assert joined.where("id = id2").count() == joined.count() == other.count()
    assert align.duplicate_rank(df.limit(0), ["a"], ["o"]).collect() == []


def test_set_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 6), (2, 5), (2, 6), (3, 5), (3, 6), (4, 5), (4, 5), (4, 6), (5, None)], "g int, x int")
    d = {r.g: r.d for r in df.groupBy("g").agg(align.set_digest("x").alias("d")).collect()}
    assert d[1] == d[2] and len(set(d.values())) == 4


def test_positions(spark):
    """Places over all rows and within groups, over many ranges, with ties and nulls."""
    from flowspark.operators.prefix import positions

    rows = [(None if k % 5 == 0 else k % 3, (k * 31) % 50, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(4)
    out = positions(df, ["v", "id"]).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.position)] == [r[2] for r in sorted(rows, key=lambda r: r[1:])]
    for g in (None, 0, 1, 2):
        mine = sorted((r for r in positions(df, ["v"], ["g"], "p").collect() if r.g == g), key=lambda r: r.p)
        assert [r.p for r in mine] == list(range(len(mine))) and [r.v for r in mine] == sorted(r[1] for r in rows if r[0] == g)
    assert positions(df.limit(0), ["v"]).collect() == []


def test_fits_run_side_by_side(spark):
    """Tasks of one pool overlap, results keep their order, and a search gives what its folds one by one give."""
    import threading
    import time

    now, most, lock = [0], [0], threading.Lock()

    def task(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return k

    assert ml.fitted([lambda k=k: task(k) for k in range(8)], 4, spark) == list(range(8)) and most[0] == 4
    d = spark.range(400).selectExpr("id", "int(id % 3) fold", "double(id % 40) x", "double(id % 7) z", "int(id % 40 > 25) label")
    candidates = [{"maxDepth": 3, "numTrees": 2}, {"maxDepth": 12, "numTrees": 2}]
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = {r.candidate: r for r in ml.search(d, ["x", "z"], candidates, parallelism=3).collect()}
    assert set(out) == {"c00", "c01"} and all(r.recall > 0.9 and r.roc_auc > 0.95 for r in out.values())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_sketches_merge_over_periods(spark):
    """Estimates of spans from daily sketches: near the exact counts, and the same as from one sketch of the span's rows."""
    d = spark.range(60_000).selectExpr("int(id / 5000) day", "if(id % 100 = 0, null, id * 7919 % 30000) x", "id % 3 y")
    daily = profile.distinct_sketches(d, F.col("day"), ["x", "y"])
    assert daily.count() == 24
    got = {(r.span, r.column): r.estimate for r in profile.distinct_estimates(daily, F.floor(F.col("period") / 6)).collect()}
    one = {(r.span, r.column): r.estimate for r in profile.distinct_estimates(profile.distinct_sketches(d, F.floor(F.col("day") / 6), ["x", "y"]), F.col("period")).collect()}
    assert got == one and got[0, "y"] == got[1, "y"] == 3
    for half in (0, 1):
        exact = len({k * 7919 % 30000 for k in range(half * 30_000, half * 30_000 + 30_000) if k % 100})
        assert abs(got[half, "x"] - exact) < 0.08 * exact
