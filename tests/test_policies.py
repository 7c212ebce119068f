import pytest
from pyspark.sql import functions as F

from flowspark.operators import policies as po

FLOW = "t long, src string, dst string, dport int, proto int, score double, label int, cat string"
KEYS = ["src", "dst", "dport"]


def flow(t, src, score, label, cat=None, dport=80, proto=6):
    return (t, src, "d", dport, proto, score, label, cat)


ROWS = [
    flow(0, "a", 0.2, 1, "X"), flow(10, "a", 0.5, 0), flow(20, "a", 0.05, 1, "X"), flow(400, "a", 0.35, 1, "Y"), flow(900, "a", 0.05, 1, "Y"),
    flow(0, "b", 0.15, 0), flow(5, "b", 0.12, 0, dport=81), flow(0, "c", 0.95, 1, "X"), flow(3600, "c", 0.3, 0), flow(3600, "c", 0.3, 0), flow(3601, "c", 0.3, 0),
]


def test_the_rules_are_42():
    rules = po.promotion_rules()
    assert [sum(r[1] == f for r in rules) for f in "ABC"] == [17, 16, 9] and len({r[0] for r in rules}) == 42
    assert {r[3] for r in rules if r[1] == "A"} == {round(0.1 + 0.05 * k, 2) for k in range(17)}


def test_rules_on_incidents_and_references(spark):
    df = spark.createDataFrame(ROWS, FLOW)
    rules = [("top", "A", 1, 0.4, None), ("many", "B", 2, 0.9, 3), ("high", "C", 3, 0.99, 3), ("all", "A", 1, 0.1, None)]
    grid = {r.rule: r for r in po.promotion_grid(df, KEYS, 300, 0.1, rules, po.capture_hours(df)).collect()}
    # incidents: a0-10 (mixed), a400, b80, b81, c0, c3600; references: a0-20, a400, a900 and c0
    seen = {k: (r.promoted, r.true_incidents, r.false_incidents, r.references, r.promoted_references) for k, r in grid.items()}
    assert seen == {"top": (2, 2, 0, 4, 2), "many": (2, 1, 1, 4, 1), "high": (1, 0, 1, 4, 0), "all": (6, 3, 3, 4, 3)}
    assert grid["all"].recall == 0.75 and not grid["all"].reaches_recall and grid["top"].reduction == pytest.approx(4 / 6) and grid["all"].false_per_hour == pytest.approx(3 / (3602 / 3600))
    # none reaches the recall: the best recall first
    assert po.select_rule(po.promotion_grid(df, KEYS, 300, 0.1, rules, po.capture_hours(df))).first().rule == "all"
    low = po.promotion_grid(df, KEYS, 300, 0.1, rules, po.capture_hours(df), least_recall=0.5)
    assert po.select_rule(low).first().rule == "top"


def test_effect_and_categories(spark):
    df = spark.createDataFrame(ROWS, FLOW)
    r = po.promotion_effect(df, KEYS, 300, 0.1, 0.4, po.capture_hours(df)).first()
    assert (r.all_incidents, r.all_false, r.all_mixed, r.references, r.all_references, r.promoted_references, r.promoted_false) == (6, 3, 1, 4, 3, 2, 0)
    assert (r.all_recall, r.promoted_recall, r.promoted_precision, r.false_reduction) == (0.75, 0.5, 1.0, 1.0)
    got = {x.category: (x.attack_flows, x.detected_flows, x.references, x.detected, x.promoted, x.sufficient_ground_truth) for x in po.category_metrics(df, KEYS, 300, 0.1, 0.4, least=3).collect()}
    assert got == {"ALL_ATTACKS": (5, 3, 4, 3, 2, True), "X": (3, 2, 2, 2, 2, False), "Y": (2, 1, 2, 1, 0, False)}
    # a flow of 0.5 in the incident promotes the attack of 0.2 beside it: membership counts, not the flow's own score
    stages = {x.stage: x for x in po.stage_comparison(df.withColumn("period", F.lit("p")), KEYS, 300, 0.1, 0.4).collect()}
    assert {k: (x.objects, x.false_objects, x.recall) for k, x in stages.items()} == {"flows": (9, 6, 0.6), "incidents": (6, 3, 0.75), "promoted": (2, 0, 0.5)}


def test_policy_grid(spark):
    df = spark.createDataFrame(ROWS, FLOW)
    grid = {(r.policy, r.gap): r for r in po.policy_grid(df, {"A": ["src", "dst"], "B": KEYS}, [5, 300], 0.1, po.capture_hours(df)).collect()}
    a, b = grid["A", 300], grid["B", 300]
    assert (a.incidents, a.false_incidents, a.mixed_incidents, a.normal_in_mixed, a.references, a.detected_references) == (5, 2, 1, 1, 4, 3)
    assert (b.incidents, b.false_incidents, b.normal_sessions, b.attack_sessions, b.n_keys, b.largest, b.median_size) == (6, 3, 4, 3, 3, 3, 1.0)
    assert grid["B", 5].mixed_incidents == 0 and b.incident_recall == 0.75 and b.absorbed_share == pytest.approx(1 / 6)


def test_shortlist_prefers_the_simplest_service_aware_policy(spark):
    rows = [(p, g, k, f + (20 if p == "C" else 0), 0.999) for p, k in (("A", 2), ("B", 3), ("C", 4)) for g, f in ((60, 300), (300, 80 if p == "A" else 900))]
    grid = spark.createDataFrame(rows, "policy string, gap long, n_keys int, false_incidents long, incident_recall double")
    got = [(r.policy, r.gap, r.rank, r.recommended) for r in po.select_policies(grid, {"A": 60, "B": 300, "C": 300}, plain=("A",)).orderBy("rank").collect()]
    assert got == [("B", 60, 1, True), ("C", 60, 2, False), ("A", 60, 3, False)]
    low = grid.withColumn("incident_recall", F.expr("case when policy = 'B' and gap = 60 then 0.9 when policy = 'B' then 0.996 else 0.999 end"))
    got = {r.policy: (r.gap, r.comparable, r.recommended) for r in po.select_policies(low, {"A": 60, "B": 300, "C": 300}, plain=("A",)).collect()}
    assert got == {"A": (60, False, False), "B": (300, False, False), "C": (60, True, True)}


def test_nothing_gives_nothing(spark):
    df = spark.createDataFrame([], FLOW)
    assert po.policy_grid(df, {"A": ["src"]}, [5], 0.1, po.capture_hours(df)).collect() == []
    assert po.category_metrics(df, KEYS, 5, 0.1, 0.4).collect() == [] == po.stage_comparison(df.withColumn("period", F.lit("p")), KEYS, 5, 0.1, 0.4).collect()
