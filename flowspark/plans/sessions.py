"""Queries of alerts, sessions, incidents and promotion, on flows by day with a gap of 30 days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import n_if, status
from ..operators import incidents as inc
from ..operators import policies as po
from ..sources.adapters import EV, LI, flows_ev, flows_li

P = inc.Policy(alert=0.4, promote=0.9, gap=30)
KEYS = list(P.keys)
BY = [*KEYS, "session"]
#: SQL of the sessions of alerts.
SES = f"""{LI}, al as (select *, coalesce((t - lag(t) over w > 30)::int, 1) nw from li where score >= 0.4 window w as (partition by src, dst, dport order by t)),
 ses as (select *, sum(nw) over (partition by src, dst, dport order by t range between unbounded preceding and current row)::bigint "session" from al),
 inc as (select src, dst, dport, "session", min(t) first_seen, max(t) last_seen, list_sort(list_distinct(list(proto))) protocols, count(*) flows, max(score) max_score, avg(score) mean_score,
  max(score) >= 0.9 promoted, sum("label")::bigint attack_flows, sum(1 - "label")::bigint normal_flows, min(ts) first_ts, max(ts) last_ts from ses group by all)"""
INC = "src, dst, dport, first_seen, last_seen, flows, round(max_score, 6) max_score, round(mean_score, 6) mean_score"


def alerting(spark, sf_dir):
    return inc.alerts(flows_li(spark, sf_dir), P)


def members(spark, sf_dir):
    return inc.gap_sessions(alerting(spark, sf_dir), KEYS, P.gap, rows=flows_li(spark, sf_dir).count())


def found(spark, sf_dir):
    return inc.incidents(flows_li(spark, sf_dir), P)


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def flow_alerts(spark, sf_dir):
    return flows_li(spark, sf_dir).select("src", "t", "score", (F.col("score") >= P.alert).alias("is_alert"))


def gap_sessions(spark, sf_dir):
    # peers of one time are in one session whatever their order: the session of a (key, time) is unique
    return members(spark, sf_dir).groupBy(*KEYS, "t").agg(F.max("session").alias("last_session"), F.count("*").alias("n"))


def incidents(spark, sf_dir):
    out = inc.ordered(found(spark, sf_dir), P.keys)
    return rounded(out, "max_score", "mean_score").select("sequence", *KEYS, "first_seen", "last_seen", F.array_join(F.col("protocols").cast("array<string>"), ",").alias("protocols"), "flows", "max_score", "mean_score", "promoted")


def promoted_incidents(spark, sf_dir):
    return rounded(found(spark, sf_dir).where("promoted"), "max_score", "mean_score").select(*KEYS, "first_seen", "last_seen", "flows", "max_score", "mean_score")


def timed(spark, sf_dir):
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int")).cast("timestamp_ntz")
    return found(spark, sf_dir).withColumns({"first_seen": day("first_seen"), "last_seen": day("last_seen")})


def incident_ids(spark, sf_dir):
    d = timed(spark, sf_dir)
    return d.select(*KEYS, inc.incident_id(F.col("src"), F.col("dst"), F.col("dport"), F.col("first_seen"), F.col("last_seen")).alias("incident_id"))


def incident_v1(spark, sf_dir):
    return inc.public_incidents(timed(spark, sf_dir)).withColumn("protocols", F.array_join(F.col("protocols").cast("array<string>"), ",")).withColumns({c: F.round(c, 9) for c in ("max_attack_score", "mean_attack_score")})


ID = "'inc_' || sha256('incident-v1|src_ip=' || src || '|dst_ip=' || dst || '|dst_port=' || dport || '|first_seen=' || strftime(first_ts, '%Y-%m-%dT%H:%M:%S') || '|last_seen=' || strftime(last_ts, '%Y-%m-%dT%H:%M:%S'))"


def incident_evidence(spark, sf_dir):
    e = inc.evidence(members(spark, sf_dir), BY)
    return rounded(e, "max_score", "mean_score", "median_score", "p90_score", "top3_mean_score", "std_score")


def incident_truth(spark, sf_dir):
    return inc.truth(members(spark, sf_dir), BY)


def with_truth(spark, sf_dir):
    return found(spark, sf_dir).join(inc.truth(members(spark, sf_dir), BY), BY)


def run_summary(spark, sf_dir):
    flows = flows_li(spark, sf_dir).agg(F.count("*").alias("flows"), F.count_if(F.col("score") >= P.alert).alias("alerts"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return flows.crossJoin(found(spark, sf_dir).agg(F.count("*").alias("incidents"), n_if("promoted").alias("promoted")))


def reference_detection(spark, sf_dir):
    ref = inc.reference_sessions(flows_li(spark, sf_dir), KEYS, P.gap)
    per = ref.groupBy("category", *KEYS, "session").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= P.alert).alias("hit"), F.max((F.col("score") >= P.promote).cast("int")).alias("promoted"))
    return per.groupBy("category").agg(
        F.sum("n").alias("flows"), F.sum("hit").alias("detected_flows"), F.count("*").alias("incidents"), n_if("hit > 0").alias("detected_incidents"), F.sum("promoted").alias("with_promoted_flow")
    )


REF = f"""{LI}, atk as (select *, unnest(['ALL_ATTACKS', cat]) category from li where "label" = 1), an as (select *, coalesce((t - lag(t) over (partition by category, src, dst, dport order by t) > 30)::int, 1) nw from atk),
 rs as (select *, sum(nw) over (partition by category, src, dst, dport order by t range between unbounded preceding and current row)::bigint rsession from an),
 per as (select category, src, dst, dport, rsession, count(*) n, sum((score >= 0.4)::int)::bigint hit, max((score >= 0.9)::int) promoted from rs group by all)"""


def attack_incident_recall(spark, sf_dir):
    return reference_detection(spark, sf_dir).select("category", "flows", "detected_flows", "incidents", "detected_incidents", F.round(F.col("detected_flows") / F.col("flows"), 6).alias("flow_recall"), F.round(F.col("detected_incidents") / F.col("incidents"), 6).alias("incident_recall"))


def promoted_recall(spark, sf_dir):
    """A reference incident counts as promoted if a promoted alert incident holds one of its flows."""
    alerted = members(spark, sf_dir)
    good = inc.incidents(flows_li(spark, sf_dir), P).where("promoted").select(*BY)
    kept = alerted.where("label = 1").join(good, BY, "left_semi").select(*KEYS, "t").distinct().withColumn("hit", F.lit(1))
    ref = inc.reference_sessions(flows_li(spark, sf_dir), KEYS, P.gap)
    per = ref.join(kept, [*KEYS, "t"], "left").groupBy("category", *KEYS, "session").agg(F.max(F.coalesce("hit", F.lit(0))).alias("promoted"))
    return per.groupBy("category").agg(F.count("*").alias("incidents"), F.sum("promoted").cast("long").alias("promoted"), F.round(F.avg("promoted"), 6).alias("recall"))


POLICIES = {"A": ["src", "dst"], "B": ["src", "dst", "dport"], "C": ["src", "dst", "dport", "proto"]}
GAPS = [3, 10, 30, 90]


HOURS = 1 / 24  # a time unit is a day


def capture(spark, sf_dir):
    return po.capture_hours(flows_li(spark, sf_dir), per_hour=HOURS)


def all_rounded(df):
    """Every fraction to six places."""
    return df.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def policy_grid(spark, sf_dir):
    return all_rounded(po.policy_grid(flows_li(spark, sf_dir), POLICIES, GAPS, P.alert, capture(spark, sf_dir)))


def policy_categories(spark, sf_dir):
    """Reference attack incidents of every policy, gap and category."""
    return all_rounded(po.policy_categories(flows_li(spark, sf_dir), POLICIES, GAPS, P.alert))


KEY_SQL = "case p.policy when 'A' then [src, dst] when 'B' then [src, dst, dport] else [src, dst, dport, proto] end k from li, (values ('A'), ('B'), ('C')) p(policy), (values (3), (10), (30), (90)) gp(gap)"


def sessions_sql(name: str, where: str, extra: str) -> str:
    """Sessions of chosen flows under every policy and gap, apart for ``extra``."""
    part = f"partition by policy, gap, {extra}, k order by t"
    return f"""{name}0 as (select li.*, {extra} x, p.policy, gp.gap, {KEY_SQL} where {where}), {name}1 as (select *, coalesce((t - lag(t) over (partition by policy, gap, x, k order by t) > gap)::int, 1) nw from {name}0),
 {name} as (select *, sum(nw) over (partition by policy, gap, x, k order by t range between unbounded preceding and current row) s from {name}1)"""


REFERENCES = "count(*) \"references\", count(*) filter (hit > 0) detected_references, count(*) filter (hit = 0) missed_references, round(sum(hit) / sum(n)::double, 6) flow_recall, round(count(*) filter (hit > 0) / count(*)::double, 6) incident_recall"
POL = f"""{LI}, {sessions_sql('gs', 'score >= 0.4', '0')}, {sessions_sql('ga', 'score >= 0.4', '"label"')}, {sessions_sql('gr', '"label" = 1', "unnest(['ALL_ATTACKS', cat])")},
 rp as (select policy, gap, x category, k, s, count(*) n, sum((score >= 0.4)::int) hit from gr group by all), cp as (select count(*) flows, (max(t) - min(t) + 1) * 24::double "hours" from li),
 gi as (select policy, gap, k, s, count(*) n, sum("label")::bigint attack, max(t) - min(t) dur from gs group by all),
 p1 as (select policy, gap, sum(n)::bigint alerts, sum(n - attack)::bigint normal_alerts, sum(attack)::bigint attack_alerts, count(*) incidents, count(*) filter (attack > 0) true_incidents, count(*) filter (attack = n) attack_incidents,
  count(*) filter (attack = 0) false_incidents, count(*) filter (attack > 0 and attack < n) mixed_incidents, sum(case when attack > 0 and attack < n then n - attack else 0 end)::bigint normal_in_mixed,
  sum(case when attack > 0 and attack < n then attack else 0 end)::bigint attack_in_mixed, avg(n) mean_size, max(n) largest, avg(dur) mean_duration, quantile_cont(n, 0.5) median_size, quantile_cont(n, 0.95) p95_size from gi group by all),
 p2 as (select policy, gap, count(*) filter (x = 0) normal_sessions, count(*) filter (x = 1) attack_sessions from (select distinct policy, gap, x, k, s from ga) group by all),
 p3 as (select policy, gap, {REFERENCES} from rp where category = 'ALL_ATTACKS' group by all),
 pm as (select policy, gap::bigint gap, alerts, normal_alerts, attack_alerts, incidents, true_incidents, attack_incidents, false_incidents, mixed_incidents, normal_in_mixed, attack_in_mixed, round(mean_size, 6) mean_size, largest,
  round(mean_duration, 6) mean_duration, round(median_size, 6) median_size, round(p95_size, 6) p95_size, normal_sessions, attack_sessions, "references", detected_references, missed_references, flow_recall, incident_recall, flows, "hours",
  case policy when 'A' then 2 when 'B' then 3 else 4 end n_keys, round(1 - incidents / alerts::double, 6) reduction, round(normal_in_mixed / normal_alerts::double, 6) absorbed_share, round(normal_alerts / nullif(false_incidents, 0)::double, 6) false_compression,
  round(normal_alerts / nullif(normal_sessions, 0)::double, 6) normal_compression, round(attack_alerts / nullif(attack_sessions, 0)::double, 6) attack_compression, round(flows / "hours", 6) flows_per_hour, round(alerts / "hours", 6) alerts_per_hour,
  round(incidents / "hours", 6) incidents_per_hour, round(false_incidents / "hours", 6) false_per_hour, round(true_incidents / "hours", 6) true_per_hour from p1 join p2 using (policy, gap) join p3 using (policy, gap), cp)"""


LIMITS = {"A": 10, "B": 30, "C": 30}


def select_policy(spark, sf_dir):
    """The shortlist, a gap for each policy, with its rank and the recommended one."""
    grid = po.policy_grid(flows_li(spark, sf_dir), POLICIES, GAPS, P.alert, capture(spark, sf_dir))
    out = all_rounded(po.select_policies(grid, LIMITS, plain=("A",)))
    return out.select("rank", "policy", "gap", "false_incidents", "incidents", "incident_recall", "false_compression", "reduction", "absorbed_share", "comparable", "recommended")


#: Promotion is judged on alerts from a low score on, as the rules' levels ask for.
LOW = inc.Policy(alert=0.1, promote=0.9, gap=30)
RULE_SQL = "rules(rule, family, complexity, level, least) as (values " + ", ".join(f"('{r}', '{f}', {c}, {x}::double, {n if n is not None else 'null'}::bigint)" for r, f, c, x, n in po.promotion_rules()) + ")"


def promotion_grid(spark, sf_dir):
    """All 42 promotion rules on every incident: what each keeps, its recall, precision, rates and reduction."""
    return all_rounded(po.promotion_grid(flows_li(spark, sf_dir), KEYS, LOW.gap, LOW.alert, po.promotion_rules(), capture(spark, sf_dir)))


#: Alert sessions from 0.1 on (lse), reference sessions with the evidence of the alert sessions they meet (lrf).
LOW_SQL = f"""{LI}, l0 as (select *, row_number() over () row_id from li), l1 as (select *, coalesce((t - lag(t) over w > 30)::int, 1) nw from l0 where score >= 0.1 window w as (partition by src, dst, dport order by t)),
 lse as (select *, sum(nw) over (partition by src, dst, dport order by t range between unbounded preceding and current row)::bigint s from l1),
 lev as (select src, dst, dport, s, max(score) top, count(*) n, count(*) filter (score >= 0.3) n30, sum("label")::bigint attack from lse group by all),
 lme as (select row_id, top, n, n30 from lse join lev using (src, dst, dport, s)),
 a0 as (select *, unnest(['ALL_ATTACKS', cat]) category from l0 where "label" = 1), a1 as (select *, coalesce((t - lag(t) over (partition by category, src, dst, dport order by t) > 30)::int, 1) nw from a0),
 a2 as (select *, sum(nw) over (partition by category, src, dst, dport order by t range between unbounded preceding and current row) rs from a1),
 lrf as (select category, src, dst, dport, rs, count(*) flows, count(top) hits, max(top) top, max(n) n, max(n30) n30 from a2 left join lme using (row_id) group by all), cp as (select count(*) flows, (max(t) - min(t) + 1) * 24::double "hours" from li)"""
KEEP = "coalesce(top >= level or coalesce(case family when 'B' then n >= least when 'C' then n30 >= least end, false), false)"
GRID = f"""{LOW_SQL}, {RULE_SQL}, g1 as (select rule, family, complexity, level, least, count(*) filter ({KEEP}) promoted, count(*) filter ({KEEP} and attack > 0) true_incidents, count(*) filter ({KEEP} and attack = 0) false_incidents, count(*) ungated
  from lev, rules group by all), g2 as (select rule, count(*) "references", count(*) filter ({KEEP}) promoted_references from lrf, rules where category = 'ALL_ATTACKS' group by all),
 grid as (select g1.*, "references", promoted_references, flows, "hours", "references" - promoted_references missed_references, round(promoted_references / "references"::double, 6) recall, round(true_incidents / nullif(promoted, 0)::double, 6) "precision",
  round(false_incidents / "hours", 6) false_per_hour, round(promoted / "hours", 6) promoted_per_hour, ungated - promoted fewer, round(1 - promoted / ungated::double, 6) reduction, promoted_references / "references"::double >= 0.999 reaches_recall from g1 join g2 using (rule), cp)"""


def select_promotion(spark, sf_dir):
    """One rule of the grid: recall of 0.999 first, then fewest false, fewest in all, simplest, most precise."""
    return all_rounded(po.select_rule(po.promotion_grid(flows_li(spark, sf_dir), KEYS, LOW.gap, LOW.alert, po.promotion_rules(), capture(spark, sf_dir))))


def promotion_effect(spark, sf_dir):
    return all_rounded(po.promotion_effect(flows_li(spark, sf_dir), KEYS, LOW.gap, LOW.alert, LOW.promote, capture(spark, sf_dir)))


def category_incident_metrics(spark, sf_dir):
    return all_rounded(po.category_metrics(flows_li(spark, sf_dir), KEYS, LOW.gap, LOW.alert, LOW.promote))


def fp_rows(spark, sf_dir):
    return inc.policy_sessions(alerting(spark, sf_dir).where("label = 0"), POLICIES, [30])


def fp_patterns(spark, sf_dir):
    """The 20 keys with most false alerts of each policy, with their service, cumulative share and dominance."""
    rows = fp_rows(spark, sf_dir).select("policy", F.array_join("key", "|").alias("pattern"))
    part = F.split("pattern", "[|]")
    # what of protocol and port a policy's key holds
    service = F.concat(F.when(F.col("policy") == "C", F.get(part, F.lit(3))).otherwise("*"), F.lit("/"), F.when(F.col("policy") == "A", "*").otherwise(F.get(part, F.lit(2))))
    return all_rounded(po.top_patterns(rows, "policy")).withColumn("service", service)


def pure_fp_patterns(spark, sf_dir):
    """Keys of incidents without an attack, over all and among promoted: top 20 each, with shares."""
    from pyspark.sql import Window

    d = with_truth(spark, sf_dir).where("pure_false_positive").withColumn("stage", F.explode(F.when(F.col("promoted"), F.array(F.lit("aggregated"), F.lit("promoted"))).otherwise(F.array(F.lit("aggregated")))))
    per = d.groupBy("stage", F.concat_ws("|", "src", "dst", "dport").alias("pattern")).agg(F.count("*").alias("incidents"), F.sum("flows").alias("flows"))
    total = per.groupBy("stage").agg(F.sum("incidents").alias("ti"), F.sum("flows").alias("tf"))
    w = Window.partitionBy("stage").orderBy(F.desc("flows"), F.desc("incidents"), "pattern")
    out = per.withColumn("rank", F.row_number().over(w)).where("rank <= 20").join(total, "stage")
    return out.select("stage", "pattern", "incidents", "flows", "rank", F.round(F.col("incidents") / F.col("ti") + 1e-9, 6).alias("incident_share"), F.round(F.col("flows") / F.col("tf"), 6).alias("flow_share"))


HALF = 11_600  # days since 1970, about the middle of the shipping dates
PERIODS = (10_200, 11_600)


def pattern_overlap(spark, sf_dir):
    """Destination roll-up of false alerts in two periods: top 20 of each and whether the other has it."""
    from pyspark.sql import Window

    d = alerting(spark, sf_dir).where("label = 0").withColumn("period", F.when(F.col("t") < HALF, "a").otherwise("b"))
    per = d.groupBy("period", "src", "dst").agg(F.count("*").alias("flows"))
    top = per.withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("flows"), "src", "dst"))).where("rank <= 20")
    other = top.select(F.when(F.col("period") == "a", "b").otherwise("a").alias("period"), "src", "dst", F.lit(True).alias("in_other"))
    return top.join(other, ["period", "src", "dst"], "left").withColumn("in_other", F.coalesce("in_other", F.lit(False)))


def pattern_rollup(spark, sf_dir):
    """False alerts of the patterns that either period ranks among its twenty first, by port and by protocol."""
    top = pattern_overlap(spark, sf_dir).select("period", "src", "dst", "in_other")
    d = alerting(spark, sf_dir).where("label = 0").withColumn("period", F.when(F.col("t") < HALF, "a").otherwise("b")).join(F.broadcast(top), ["period", "src", "dst"])  # forty rows
    kinds = F.explode(F.array(F.struct(F.lit("port").alias("kind"), F.col("dport").cast("string").alias("value")), F.struct(F.lit("protocol").alias("kind"), F.col("proto").cast("string").alias("value"))))
    return d.select("period", "in_other", kinds.alias("x")).groupBy("period", "x.kind", "x.value").agg(F.count("*").alias("flows"), n_if("in_other").alias("flows_in_both"))


def in_periods(spark, sf_dir):
    return flows_li(spark, sf_dir).withColumn("period", F.when(F.col("t") < PERIODS[0], "a").when(F.col("t") < PERIODS[1], "b").otherwise("c"))


def stage_comparison(spark, sf_dir):
    """Long table of volume and quality by three periods and stages (flows, incidents, promoted)."""
    return all_rounded(po.stage_comparison(in_periods(spark, sf_dir), KEYS, LOW.gap, LOW.alert, LOW.promote, per_hour=HOURS)).drop("wanted")


PERIOD_SQL = f"case when t < {PERIODS[0]} then 'a' when t < {PERIODS[1]} then 'b' else 'c' end"
STAGE = f"""{LI}, q0 as (select *, {PERIOD_SQL} pd, row_number() over () row_id from li), q1 as (select *, coalesce((t - lag(t) over (partition by pd, src, dst, dport order by t) > 30)::int, 1) nw from q0 where score >= 0.1),
 q2 as (select *, sum(nw) over (partition by pd, src, dst, dport order by t range between unbounded preceding and current row) s from q1),
 q3 as (select pd, src, dst, dport, s, max(score) top, sum("label") attack from q2 group by all), q4 as (select row_id, top from q2 join q3 using (pd, src, dst, dport, s)),
 r1 as (select *, coalesce((t - lag(t) over (partition by pd, src, dst, dport order by t) > 30)::int, 1) nw from q0 where "label" = 1), r2 as (select *, sum(nw) over (partition by pd, src, dst, dport order by t range between unbounded preceding and current row) rs from r1),
 r3 as (select pd, src, dst, dport, rs, count(*) n, count(top) hits, max(top) top from r2 left join q4 using (row_id) group by all),
 r4 as (select pd, 'flows' stage, sum(hits)::bigint found, sum(n)::bigint wanted from r3 group by all union all select pd, 'incidents', count(*) filter (hits > 0), count(*) from r3 group by all union all select pd, 'promoted', count(*) filter (top >= 0.9), count(*) from r3 group by all),
 st as (select pd, 'flows' stage, ("label" = 0) f from q2 union all select pd, 'incidents', attack = 0 from q3 union all select pd, 'promoted', attack = 0 from q3 where top >= 0.9),
 hr as (select pd, (max(t) - min(t) + 1) * 24::double "hours" from q0 group by all),
 stages as (select pd "period", stage, count(*) objects, count(*) filter (f) false_objects, found, "hours", round(found / wanted::double, 6) recall, round(1 - count(*) filter (f) / count(*)::double, 6) "precision", round(count(*) / "hours", 6) objects_per_hour,
  round(count(*) filter (f) / "hours", 6) false_per_hour from st join r4 using (pd, stage) join hr using (pd) group by pd, stage, found, wanted, "hours")"""


def delta_status(spark, sf_dir):
    """Precision of each stage from period a to b: stable within 0.001, else improved or degraded."""
    s = stage_comparison(spark, sf_dir)
    both = s.where("period = 'a'").select("stage", F.col("precision").alias("before")).join(s.where("period = 'b'").select("stage", F.col("precision").alias("after")), "stage")
    delta = F.round(F.col("after") - F.col("before"), 6)
    return both.withColumn("delta", delta).withColumn("status", status(delta, F.lit(True)))


def verdict(spark, sf_dir):
    d = promotion_effect(spark, sf_dir)
    enough, fewer = F.col("promoted_true") >= 0.1 * F.col("all_true"), F.col("false_reduction") >= 0.5
    return d.select(enough.alias("keeps_true"), fewer.alias("cuts_false"), F.when(enough & fewer, "accept").when(enough | fewer, "review").otherwise("reject").alias("verdict"))


EFFECT = f"""{LOW_SQL}, e1 as (select count(*) all_incidents, count(*) filter (attack = 0) all_false, count(*) filter (attack > 0) all_true, count(*) filter (attack > 0 and attack < n) all_mixed,
 count(*) filter (top >= 0.9) promoted_incidents, count(*) filter (top >= 0.9 and attack = 0) promoted_false, count(*) filter (top >= 0.9 and attack > 0) promoted_true, count(*) filter (top >= 0.9 and attack > 0 and attack < n) promoted_mixed from lev),
 e2 as (select count(*) "references", count(*) filter (hits > 0) all_references, count(*) filter (top >= 0.9) promoted_references from lrf where category = 'ALL_ATTACKS'),
 eff as (select e1.*, e2.*, cp.*, {', '.join(f'round({x}_references / "references"::double, 6) {x}_recall, round({x}_true / nullif({x}_incidents, 0)::double, 6) {x}_precision, round({x}_incidents / "hours", 6) {x}_per_hour, round({x}_false / "hours", 6) {x}_false_per_hour' for x in ('all', 'promoted'))},
 round(1 - promoted_incidents / all_incidents::double, 6) incident_reduction, round(1 - promoted_false / nullif(all_false, 0)::double, 6) false_reduction, all_incidents - promoted_incidents fewer_incidents, all_false - promoted_false fewer_false from e1, e2, cp)"""


def hourly_rates(spark, sf_dir):
    """Alerts of each user per hour of capture, both ends counted."""
    d = flows_ev(spark, sf_dir).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    hours = (F.max("sec") - F.min("sec") + 1) / 3600
    return d.groupBy("src").agg(F.count("*").alias("n"), F.round(hours, 6).alias("hours"), F.round(F.count("*") / hours, 6).alias("per_hour"))


QUERIES = {
    f.__name__: f
    for f in (
        flow_alerts, gap_sessions, incidents, promoted_incidents, incident_ids, incident_v1, incident_evidence, incident_truth, run_summary, attack_incident_recall, promoted_recall, select_policy, promotion_grid,
        select_promotion, promotion_effect, category_incident_metrics, fp_patterns, pure_fp_patterns, pattern_overlap, pattern_rollup, stage_comparison, policy_grid, policy_categories, delta_status, verdict, hourly_rates,
    )
}
SQL = {
    "flow_alerts": f"with {LI} select src, t, score, score >= 0.4 is_alert from li",
    "gap_sessions": f'with {SES} select src, dst, dport, t, max("session") last_session, count(*) n from ses group by all',
    "incidents": f"with {SES} select row_number() over (order by first_seen, src, dst, dport) - 1 \"sequence\", {INC}, array_to_string(protocols, ',') protocols, promoted from inc",
    "promoted_incidents": f"with {SES} select {INC} from inc where promoted",
    "incident_ids": f"with {SES} select src, dst, dport, {ID} incident_id from inc",
    "incident_v1": f"""with {SES} select 'incident-v1' schema_version, {ID} incident_id, strftime(first_ts, '%Y-%m-%dT%H:%M:%S') first_seen, strftime(last_ts, '%Y-%m-%dT%H:%M:%S') last_seen, src::varchar src_ip, dst::varchar dst_ip,
        dport::int dst_port, array_to_string(protocols, ',') protocols, flows flow_count, round(max_score, 9) max_attack_score, round(mean_score, 9) mean_attack_score, promoted,
        '0.1.0' product_version, 'unnamed' model_version, 'unnamed' feature_contract from inc where promoted""",
    "incident_evidence": f"""with {SES} select src, dst, dport, "session", count(*) flows, round(max(score), 6) max_score, round(avg(score), 6) mean_score, round(median(score), 6) median_score, round(quantile_cont(score, 0.9), 6) p90_score,
        round(list_avg(list_sort(list(score), 'DESC')[1:3]), 6) top3_mean_score, count(*) filter (score >= 0.2) n_ge_20, count(*) filter (score >= 0.3) n_ge_30, count(*) filter (score >= 0.4) n_ge_40, count(*) filter (score >= 0.5) n_ge_50,
        round(stddev_pop(score), 6) std_score, max(t) - min(t) duration from ses group by all""",
    "incident_truth": f"""with {SES} select src, dst, dport, "session", attack_flows, normal_flows, attack_flows > 0 tp_or_mixed, attack_flows = 0 pure_false_positive, attack_flows > 0 and normal_flows > 0 mixed,
        attack_flows > 0 and normal_flows = 0 attack_only from inc""",
    "run_summary": f"with {SES} select (select count(*) from li) flows, (select count(*) from al) alerts, (select min(t) from li) first_t, (select max(t) from li) last_t, count(*) incidents, count(*) filter (promoted) promoted from inc",
    "attack_incident_recall": f"""with {REF} select category, sum(n)::bigint flows, sum(hit)::bigint detected_flows, count(*) incidents, count(*) filter (hit > 0) detected_incidents, round(sum(hit) / sum(n)::double, 6) flow_recall,
        round(count(*) filter (hit > 0) / count(*)::double, 6) incident_recall from per group by all""",
    "promoted_recall": f"""with {SES}, {REF.removeprefix(LI + ', ')}, good as (select distinct s.src, s.dst, s.dport, s.t from ses s join inc i on (s.src, s.dst, s.dport, s."session") = (i.src, i.dst, i.dport, i."session") where i.promoted and s."label" = 1),
        pr as (select category, r.src, r.dst, r.dport, rsession, max((g.src is not null)::int) promoted from rs r left join good g on (r.src, r.dst, r.dport, r.t) = (g.src, g.dst, g.dport, g.t) group by all)
        select category, count(*) incidents, sum(promoted)::bigint promoted, round(avg(promoted), 6) recall from pr group by all""",
    "policy_grid": f"with {POL} select * from pm",
    "policy_categories": f"with {POL} select policy, gap::bigint gap, category, sum(n)::bigint attack_flows, sum(hit)::bigint detected_flows, {REFERENCES} from rp group by all",
    "select_policy": f"""with {POL}, b0 as (select *, row_number() over (partition by policy order by incident_recall >= 0.995 desc, false_incidents, gap) r from pm where gap <= case policy when 'A' then 10 else 30 end), b1 as (select *, policy <> 'A' aware from b0 where r = 1),
        b2 as (select *, aware and false_incidents <= 1.10 * min(false_incidents) filter (aware) over () and incident_recall >= max(incident_recall) filter (aware) over () - 0.001 comparable from b1),
        b3 as (select *, (row_number() over (order by comparable desc, aware desc, n_keys, false_incidents, policy))::int "rank" from b2)
        select "rank", policy, gap, false_incidents, incidents, incident_recall, false_compression, reduction, absorbed_share, comparable, "rank" = 1 recommended from b3""",
    "promotion_grid": f"with {GRID} select * from grid",
    "select_promotion": f"""with {GRID} select * from grid order by reaches_recall desc, case when reaches_recall then 0 else -recall end, false_incidents, promoted, complexity, "precision" desc nulls last, rule limit 1""",
    "promotion_effect": f"with {EFFECT} select * from eff",
    "category_incident_metrics": f"""with {LOW_SQL} select category, sum(flows)::bigint attack_flows, sum(hits)::bigint detected_flows, count(*) "references", count(*) filter (hits > 0) detected, count(*) filter (top >= 0.9) promoted, round(sum(hits) / sum(flows)::double, 6) flow_recall,
        round(count(*) filter (hits > 0) / count(*)::double, 6) recall, count(*) - count(*) filter (top >= 0.9) promoted_missed, round(count(*) filter (top >= 0.9) / count(*)::double, 6) promoted_recall, count(*) >= 20 sufficient_ground_truth from lrf group by all""",
    "fp_patterns": f"""with {LI}, f as (select policy, case policy when 'A' then src || '|' || dst when 'B' then src || '|' || dst || '|' || dport else src || '|' || dst || '|' || dport || '|' || proto end pattern, count(*) flows from li, (values ('A'), ('B'), ('C')) p(policy) where score >= 0.4 and "label" = 0 group by all),
        r as (select *, (row_number() over (partition by policy order by flows desc, pattern))::int "rank", sum(flows) over (partition by policy) total, max(flows) over (partition by policy) most,
        (sum(flows) over (partition by policy order by flows desc, pattern rows between unbounded preceding and current row))::bigint cumulative from f)
        select policy, pattern, flows, "rank", cumulative, round(cumulative / total::double, 6) cumulative_share, 2 * most >= total one_dominates, case policy when 'A' then '*/*' when 'B' then '*/' || split_part(pattern, '|', 3) else split_part(pattern, '|', 4) || '/' || split_part(pattern, '|', 3) end service from r where "rank" <= 20""",
    "pure_fp_patterns": f"""with {SES}, f as (select unnest(case when promoted then ['aggregated', 'promoted'] else ['aggregated'] end) stage, src || '|' || dst || '|' || dport pattern, flows from inc where attack_flows = 0),
        g as (select stage, pattern, count(*) incidents, sum(flows)::bigint flows from f group by all), r as (select *, (row_number() over (partition by stage order by flows desc, incidents desc, pattern))::int "rank",
        sum(incidents) over (partition by stage) ti, sum(flows) over (partition by stage) tf from g)
        select stage, pattern, incidents, flows, "rank", round(incidents / ti::double + 1e-9, 6) incident_share, round(flows / tf::double, 6) flow_share from r where "rank" <= 20""",
    "pattern_overlap": f"""with {LI}, f as (select case when t < {HALF} then 'a' else 'b' end "period", src, dst, count(*) flows from li where score >= 0.4 and "label" = 0 group by all),
        r as (select *, (row_number() over (partition by "period" order by flows desc, src, dst))::int "rank" from f qualify "rank" <= 20)
        select r."period", r.src, r.dst, r.flows, r."rank", o.src is not null in_other from r left join r o on o."period" <> r."period" and o.src = r.src and o.dst = r.dst""",
    "pattern_rollup": f"""with {LI}, f as (select case when t < {HALF} then 'a' else 'b' end "period", src, dst, count(*) flows from li where score >= 0.4 and "label" = 0 group by all),
        r as (select *, row_number() over (partition by "period" order by flows desc, src, dst) rk from f qualify rk <= 20), tp as (select r.*, o.src is not null in_other from r left join r o on o."period" <> r."period" and o.src = r.src and o.dst = r.dst),
        d as (select tp."period", in_other, unnest(['port', 'protocol']) kind, unnest([dport::varchar, proto::varchar]) "value" from li join tp on li.src = tp.src and li.dst = tp.dst and tp."period" = case when t < {HALF} then 'a' else 'b' end where score >= 0.4 and "label" = 0)
        select "period", kind, "value", count(*) flows, count(*) filter (in_other) flows_in_both from d group by all""",
    "stage_comparison": f"with {STAGE} select * from stages",
    "delta_status": f"""with {STAGE}, d as (select a.stage, a."precision" "before", b."precision" "after", round(b."precision" - a."precision", 6) delta from stages a join stages b on a.stage = b.stage and a."period" = 'a' and b."period" = 'b')
        select *, case when abs(delta) <= 0.001 then 'stable' when delta > 0 then 'improved' else 'degraded' end status from d""",
    "verdict": f"""with {EFFECT} select promoted_true >= 0.1 * all_true keeps_true, false_reduction >= 0.5 cuts_false, case when promoted_true >= 0.1 * all_true and false_reduction >= 0.5 then 'accept'
        when promoted_true >= 0.1 * all_true or false_reduction >= 0.5 then 'review' else 'reject' end verdict from eff""",
    "hourly_rates": f"""with {EV} select src, count(*) n, round((max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) + 1) / 3600, 6) "hours",
        round(count(*) / ((max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) + 1) / 3600), 6) per_hour from (select *  from ev) group by all""",
}
