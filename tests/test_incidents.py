import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowspark.operators import incidents as inc

SCHEMA = "id long, t long, src string, dst string, dport int, proto int, score double"
POLICY = inc.Policy()
# profile rows of the end-to-end case: second of the day after 13:00, ends, port, protocol, score
GOLDEN = [
    (0, 0, "192.0.2.1", "198.51.100.1", 80, 6, 0.10905555555555556), (1, 0, "192.0.2.2", "198.51.100.2", 443, 6, 0.09088888888888891), (2, 0, "192.0.2.3", "198.51.100.1", 53, 17, 0.14411111111111108),
    (3, 0, "192.0.2.10", "198.51.100.20", 445, 6, 0.4112575757575758), (4, 0, "192.0.2.10", "198.51.100.20", 445, 17, 0.4112575757575758), (5, 5, "192.0.2.2", "198.51.100.2", 443, 6, 0.11253703703703706),
    (6, 5, "192.0.2.10", "198.51.100.20", 445, 6, 0.4325909090909091), (7, 5, "192.0.2.1", "198.51.100.1", 80, 6, 0.15135449735449738), (8, 10, "192.0.2.4", "198.51.100.3", 8443, 6, 0.08777777777777779),
    (9, 10, "192.0.2.3", "198.51.100.1", 53, 17, 0.1624656084656085), (10, 360, "192.0.2.10", "198.51.100.20", 445, 6, 0.34781313131313135), (11, 360, "192.0.2.5", "198.51.100.4", 22, 6, 0.08755555555555558),
]


def rows(*items):
    return [(i, t, s, "d", 80, p, x) for i, (t, s, p, x) in enumerate(items)]


def found(spark, data):
    out = inc.incidents(spark.createDataFrame(data, SCHEMA), POLICY, row_id="id")
    return inc.ordered(out, POLICY.keys).orderBy("sequence").collect()


def test_rules_of_sessions(spark):
    assert found(spark, rows()) == []
    assert [r.members for r in found(spark, rows((0, "a", 6, 0.2)))] == [[0]]
    assert [r.members for r in found(spark, rows((0, "a", 6, 0.2), (300, "a", 6, 0.2)))] == [[0, 1]]
    assert [r.members for r in found(spark, rows((0, "a", 6, 0.2), (301, "a", 6, 0.2)))] == [[0], [1]]
    assert [r.members for r in found(spark, rows((0, "a", 6, 0.2), (200, "a", 6, 0.05), (400, "a", 6, 0.2)))] == [[0], [2]]
    both = found(spark, rows((0, "a", 17, 0.2), (0, "a", 6, 0.25), (1, "b", 6, 0.2)))
    assert [(r.members, r.protocols, r.promoted) for r in both] == [([0, 1], [6, 17], True), ([2], [6], False)]


def test_golden_run(spark, tmp_path):
    df = spark.createDataFrame(GOLDEN[::-1], SCHEMA)
    assert inc.alerts(df, POLICY).count() == 9
    out = found(spark, GOLDEN)
    assert [(r.members, r.promoted) for r in out] == [([0, 7], False), ([3, 4, 6], True), ([2, 9], False), ([5], False), ([10], True)]
    start = dt.datetime(2026, 8, 20, 13)
    when = lambda c: (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(c)))
    timed = inc.incidents(df, POLICY).withColumns({"first_seen": when("first_seen"), "last_seen": when("last_seen")})
    inc.write_jsonl(inc.public_incidents(timed, {"model_version": "m2"}), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["incident_id"] for x in lines] == ["inc_e05487e368f9e26a2a6939c7be622de508056478d3876c344c77a53ba4214872", "inc_1650df57d0101d5881c988734fdd08741349020266b214145a5425c81646ae26"]
    assert lines[0]["protocols"] == [6, 17] and lines[0]["first_seen"] == "2026-08-20T13:00:00" and lines[0]["last_seen"] == "2026-08-20T13:00:05"
    assert (lines[0]["max_attack_score"], lines[0]["mean_attack_score"], lines[1]["max_attack_score"]) == (0.432590909091, 0.418368686869, 0.347813131313)
    assert tuple(lines[0]) == inc.PUBLIC and len(inc.PUBLIC) == 15 and lines[0]["model_version"] == "m2" and lines[0]["promoted"] is True


def test_public_form_is_closed(spark, tmp_path):
    shape = "src string, dst string, dport int, first_seen timestamp_ntz, last_seen timestamp_ntz, protocols array<int>, flows long, max_score double, mean_score double, promoted boolean"
    t = dt.datetime(2015, 2, 17, 12, 3, 21)
    good = ("a", "b", 80, t, t, [17, 6, 17], 3, 0.5, 0.4, True)
    public = inc.public_incidents(spark.createDataFrame([good], shape)).collect()[0]
    assert public.protocols == [6, 17] and public.first_seen == "2015-02-17T12:03:21"
    for at, bad in ((0, " "), (2, 65536), (4, dt.datetime(2015, 2, 17, 12, 0)), (5, [256]), (7, 1.5), (7, float("nan"))):
        row = list(good)
        row[at] = bad
        with pytest.raises(ValueError):
            inc.write_jsonl(inc.public_incidents(spark.createDataFrame([tuple(row)], shape)), str(tmp_path / f"bad{at}"))


def test_evidence_and_truth(spark):
    scores = [(10, 0.11), (20, 0.20), (30, 0.30), (40, 0.50)]
    df = spark.createDataFrame([(1, t, s, 0) for t, s in scores] + [(2, 5, 0.4, 1), (2, 6, 0.4, 0)], "k long, t long, score double, label int")
    e = {r.k: r for r in inc.evidence(df, ["k"]).collect()}
    assert (e[1].flows, e[1].max_score, e[1].n_ge_30, e[1].duration) == (4, 0.5, 2, 30) and e[1].top3_mean_score == pytest.approx(1 / 3)
    t = {r.k: (r.tp_or_mixed, r.pure_false_positive, r.mixed, r.attack_only) for r in inc.truth(df, ["k"]).collect()}
    assert t == {1: (False, True, False, False), 2: (True, False, True, False)}


def test_reference_and_policy_sessions(spark):
    base = [(0, "a", "b", 80, "Benign", 0, 0.2), (10, "x", "y", 53, "Benign", 0, 0.2), (20, "a", "b", 80, "Fuzzers", 1, 0.8), (40, "a", "b", 80, "Benign", 0, 0.3), (40, "a", "b", 80, "Fuzzers", 1, 0.9), (120, "a", "b", 80, "Fuzzers", 1, 0.8), (120, "a", "b", 80, "Fuzzers", 1, 0.01)]
    df = spark.createDataFrame(base, "t long, src string, dst string, dport int, cat string, label int, score double")
    ref = inc.reference_sessions(df, ["src", "dst"], 30)
    assert {(r.category, r.session): r["count"] for r in ref.groupBy("category", "session").count().collect()} == {(c, s): n for c in ("ALL_ATTACKS", "Fuzzers") for s, n in ((1, 2), (2, 2))}
    grid = inc.policy_sessions(df.where("score >= 0.1"), {"A": ["src", "dst"], "B": ["src", "dst", "dport"]}, [30, 300])
    n = {(r.policy, r.gap): r.n for r in grid.groupBy("policy", "gap").agg(F.count_distinct("key", "session").alias("n")).collect()}
    assert n == {("A", 30): 3, ("A", 300): 2, ("B", 30): 3, ("B", 300): 2}


def test_policy_refuses_contradictions():
    for bad in ({"alert": 0.5, "promote": 0.2}, {"gap": -1}, {"keys": ()}, {"alert": 2}):
        with pytest.raises(ValueError):
            inc.Policy(**bad)


def test_evidence_against_arrays(spark):
    """All statistics of a session from its counts by score: ties, one score, nulls in keys and scores."""
    import random

    import numpy as np

    from flowspark.operators import incidents as inc

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *(x / 20 for x in range(21))]), k) for k in range(300)] + [("one", 0.25, 7), ("none", None, 8)]
    out = {r.k: r for r in inc.evidence(spark.createDataFrame(rows, "k string, score double, t long"), ["k"]).collect()}
    assert set(out) == {r[0] for r in rows}
    for k, r in out.items():
        x = np.array([s for g, s, _ in rows if g == k and s is not None])
        t = [at for g, _, at in rows if g == k]
        assert r.flows == len(t) and r.duration == max(t) - min(t)
        if not len(x):
            assert r.max_score is None and r.median_score is None and r.n_ge_20 == 0
            continue
        top = np.sort(x)[::-1][:3]
        got = [r.max_score, r.mean_score, r.median_score, r.p90_score, r.top3_mean_score, r.std_score]
        assert got == pytest.approx([x.max(), x.mean(), np.median(x), np.quantile(x, 0.9), top.mean(), x.std()])
        assert [r.n_ge_20, r.n_ge_30, r.n_ge_40, r.n_ge_50] == [(x >= v).sum() for v in (0.2, 0.3, 0.4, 0.5)]


def test_incidents_are_numbered_in_any_unit(spark):
    """Microseconds: nearly every incident has a time of its own."""
    from flowspark.operators import incidents as inc

    rows = [(k * 7919 % 1000 * 1_000_003, f"s{k % 7}", k) for k in range(500)]
    out = inc.ordered(spark.createDataFrame(rows, "first_seen long, src string, id int"), ("src",)).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.sequence)] == [r[2] for r in sorted(rows)] and sorted(r.sequence for r in out) == list(range(500))


def test_sessions_of_all_gaps_come_from_one_sort_and_one_shuffle(spark):
    policies, gaps = {"A": ["src"], "B": ["src", "dst"]}, [3, 10, 40]
    df = spark.range(400).selectExpr("id % 3 src", "if(id % 7 = 0, null, id % 2) dst", "id * id % 500 t", "int(id % 5 < 2) label")
    every = inc.policy_sessions(df, policies, gaps, extra=["label"])
    keys = inc.policy_keys(policies)
    assert keys == ["_key_src", "_key_dst"]
    # all keys of a policy without dst are one group, and a null is a key like any other
    assert every.groupBy("policy", "gap", "label", "key", *keys).count().count() == 3 * (3 * 2 + 3 * 3 * 2)
    found = every.select("policy", "gap", "label", "key", "session").distinct().groupBy("policy", "gap", "label").agg(F.count("*").alias("sessions"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, inc.session_counts(df, policies, gaps, ["label"]).select("policy", "gap", "label", "sessions").collect()))
    plan = every.groupBy("policy", "gap", "label", *keys, "session").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
