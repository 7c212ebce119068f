"""Choosing how alerts become incidents, and which incidents are promoted.

Grids are exploded once and aggregated once, whatever the number of policies, gaps and rules.
``hours`` is the length of the capture; rates are per hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import n_if
from ..functions.tables import written
from .incidents import gap_sessions, policy_keys, policy_sessions, session_counts
from .prefix import quantiles_of, running_sums


def capture_hours(df: DataFrame, time: str = "t", per_hour: float = 3600.0) -> DataFrame:
    """One row: rows, and hours from the first to the last time unit, both counted; ``per_hour`` units are an hour."""
    return df.agg(F.count("*").alias("flows"), ((F.max(time) - F.min(time) + 1) / per_hour).alias("hours"))


def _sizes(per: DataFrame, by: list[str]) -> DataFrame:
    """Median and 95th percentile of the incident sizes, from counts by size."""
    run = running_sums(per.groupBy(*by, F.col("n").alias("size")).agg(F.count("*").alias("c")), by, "size", ["c"])
    q = quantiles_of(run, by, "size", "c", [0.5, 0.95])
    return q.select(*by, F.get("q", F.lit(0)).cast("double").alias("median_size"), F.get("q", F.lit(1)).cast("double").alias("p95_size"))


def policy_categories(flows: DataFrame, policies: dict[str, list[str]], gaps: list[int], alert: float, category: str = "cat", score: str = "score") -> DataFrame:
    """True attacks grouped under every policy and gap, over all and by category: what of them alerts."""
    attacks = flows.where("label = 1").withColumns({"category": F.explode(F.array_compact(F.array(F.lit("ALL_ATTACKS"), F.col(category)))), "hit": (F.col(score) >= alert).cast("long")})
    by = ["policy", "gap", "category"]
    per = policy_sessions(attacks, policies, gaps, extra=["category"]).groupBy(*by, *policy_keys(policies), "session").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"))
    out = per.groupBy(*by).agg(F.sum("n").alias("attack_flows"), F.sum("hit").alias("detected_flows"), F.count("*").alias("references"), n_if("hit > 0").alias("detected_references"))
    return out.withColumns({"missed_references": F.col("references") - F.col("detected_references"), "flow_recall": F.col("detected_flows") / F.col("attack_flows"), "incident_recall": F.col("detected_references") / F.col("references")})


def policy_grid(flows: DataFrame, policies: dict[str, list[str]], gaps: list[int], alert: float, capture: DataFrame, score: str = "score") -> DataFrame:
    """One row a policy and gap: volume, sizes, absorption of normal alerts, compression, recall and hourly rates.
    ``capture``: one row of flows and hours."""
    # what the grid looks at, read once: alerts and attacks, with the columns of some policy's key
    used = list(dict.fromkeys([*(k for keys in policies.values() for k in keys), "t", "label", score]))
    flows = written(flows.where((F.col(score) >= alert) | (F.col("label") == 1)).select(*used), "grid-rows")
    alerts, by = flows.where(F.col(score) >= alert), ["policy", "gap"]
    keyed = policy_keys(policies)
    per = policy_sessions(alerts, policies, gaps).groupBy(*by, *keyed, "session").agg(F.count("*").alias("n"), F.sum("label").alias("attack"), (F.max("t") - F.min("t")).alias("took"))
    per = written(per.drop(*keyed, "session"), "grid-sessions")
    in_mixed = lambda c: F.sum(F.when(F.expr("attack > 0 and attack < n"), F.expr(c)).otherwise(0))
    out = per.groupBy(*by).agg(
        F.sum("n").alias("alerts"), F.sum(F.expr("n - attack")).alias("normal_alerts"), F.sum("attack").alias("attack_alerts"), F.count("*").alias("incidents"), n_if("attack > 0").alias("true_incidents"),
        n_if("attack = n").alias("attack_incidents"), n_if("attack = 0").alias("false_incidents"), n_if("attack > 0 and attack < n").alias("mixed_incidents"), in_mixed("n - attack").alias("normal_in_mixed"),
        in_mixed("attack").alias("attack_in_mixed"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"), F.avg("took").alias("mean_duration"),
    )
    apart = session_counts(alerts, policies, gaps, ["label"])
    apart = apart.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("sessions"))), F.lit(0)).alias(f"{name}_sessions") for k, name in ((0, "normal"), (1, "attack"))))
    found = policy_categories(flows.withColumn("cat", F.lit(None).cast("string")), policies, gaps, alert, score=score).where("category = 'ALL_ATTACKS'").drop("category", "attack_flows", "detected_flows")
    keys = F.create_map(*(F.lit(x) for name, k in policies.items() for x in (name, len(k))))
    out = out.join(_sizes(per, by), by).join(apart, by).join(found, by, "left").crossJoin(F.broadcast(capture))  # one row
    rates = {"flows_per_hour": "flows", "alerts_per_hour": "alerts", "incidents_per_hour": "incidents", "false_per_hour": "false_incidents", "true_per_hour": "true_incidents"}
    ratios = {"absorbed_share": ("normal_in_mixed", "normal_alerts"), "false_compression": ("normal_alerts", "false_incidents"), "normal_compression": ("normal_alerts", "normal_sessions"), "attack_compression": ("attack_alerts", "attack_sessions")}
    return out.withColumns(
        {"n_keys": keys[F.col("policy")], "reduction": 1 - F.col("incidents") / F.col("alerts")}
        | {k: F.try_divide(a, b) for k, (a, b) in ratios.items()}
        | {k: F.col(c) / F.col("hours") for k, c in rates.items()}
    )


def select_policies(grid: DataFrame, limits: dict[str, int], plain: tuple[str, ...] = (), least_recall: float = 0.995, near_false: float = 1.10, near_recall: float = 0.001) -> DataFrame:
    """The shortlist: of each policy the gap within its limit with the fewest false incidents (then the shorter)
    among those that reach the recall, or among all if none does.  Policies that are not ``plain`` know the service; of
    them those near the fewest false incidents and the best recall are comparable, and the one of
    fewest keys is recommended.  The other service-aware ones follow, then the plain ones."""
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    within = grid.where(F.col("gap") <= limit[F.col("policy")]).withColumn("reaches_recall", F.coalesce(F.col("incident_recall") >= least_recall, F.lit(False)))
    each = Window.partitionBy("policy").orderBy(F.desc("reaches_recall"), "false_incidents", "gap")
    best = within.withColumn("_r", F.row_number().over(each)).where("_r = 1").drop("_r").withColumn("aware", ~F.col("policy").isin(*plain) if plain else F.lit(True))
    every = Window.partitionBy()  # a row a policy
    fewest, most = F.min(F.when(F.col("aware"), F.col("false_incidents"))).over(every), F.max(F.when(F.col("aware"), F.col("incident_recall"))).over(every)
    best = best.withColumn("comparable", F.col("aware") & (F.col("false_incidents") <= near_false * fewest) & (F.col("incident_recall") >= most - near_recall))
    order = Window.orderBy(F.desc("comparable"), F.desc("aware"), "n_keys", "false_incidents", "policy")
    return best.withColumn("rank", F.row_number().over(order)).withColumn("recommended", F.col("rank") == 1)


def promotion_rules(a: list[float] | None = None, b: tuple = ((0.20, 0.30, 0.40, 0.50), (3, 5, 10, 20)), c: tuple = ((0.30, 0.40, 0.50), (2, 3, 5))) -> list[tuple]:
    """(rule, family, complexity, level, least): A promotes by the highest score, B also by the number of alerts, C
    also by the number of alerts of 0.30 or more; 42 of them unless told otherwise."""
    out = [(f"max>={x:.2f}", "A", 1, x, None) for x in (a or [k / 100 for k in range(10, 91, 5)])]
    for family, complexity, name, (levels, counts) in (("B", 2, "n", b), ("C", 3, "n30", c)):
        out += [(f"max>={x:.2f} or {name}>={n}", family, complexity, x, n) for x in levels for n in counts]
    return out


def with_session_evidence(flows: DataFrame, keys: list[str], gap: int, alert: float, score: str = "score", time: str = "t", level: float = 0.30, rows: int | None = None) -> DataFrame:
    """``flows`` with what their alert session holds: its number, ``top`` score, ``n`` alerts and ``n30`` of ``level``
    or more; null for flows that do not alert.  ``rows``: those of ``flows``, which partitions then follow."""
    is_alert = F.col(score) >= alert
    own = Window.partitionBy(*keys, "session")
    seen = gap_sessions(flows.where(is_alert), keys, gap, time, rows=rows).withColumns({"top": F.max(score).over(own), "n": F.count("*").over(own), "n30": F.count_if(F.col(score) >= level).over(own)})
    return seen.unionByName(flows.where(~is_alert | F.col(score).isNull()), allowMissingColumns=True)


def reference_evidence(evidenced: DataFrame, keys: list[str], gap: int, category: str | None = "cat", time: str = "t", rows: int | None = None) -> DataFrame:
    """One row a true-attack session, over all and by category: its flows, those that alert, and the best evidence of
    the alert sessions that hold one of them.  A rule promotes a reference if it holds for that.
    ``category`` None: over all only.  ``rows``: those of ``evidenced``, which partitions then follow."""
    kinds = F.lit("ALL_ATTACKS") if category is None else F.explode(F.array(F.lit("ALL_ATTACKS"), F.col(category)))
    wide = evidenced.where("label = 1").withColumnRenamed("session", "_alert").withColumn("category", kinds)
    rows = None if rows is None else rows * (1 if category is None else 2)
    return gap_sessions(wide, ["category", *keys], gap, time, rows=rows).groupBy("category", *keys, "session").agg(F.count("*").alias("flows"), F.count("_alert").alias("hits"), *(F.max(c).alias(c) for c in ("top", "n", "n30")))


def holds(family: Column, level: Column, least: Column) -> Column:
    """Whether a rule promotes evidence of top, n and n30."""
    also = F.when(family == "B", F.col("n") >= least).when(family == "C", F.col("n30") >= least)
    return F.coalesce((F.col("top") >= level) | F.coalesce(also, F.lit(False)), F.lit(False))


def promotion_grid(flows: DataFrame, keys: list[str], gap: int, alert: float, rules: list[tuple], capture: DataFrame, least_recall: float = 0.999) -> DataFrame:
    """Every rule on every incident: recall of reference incidents, precision, hourly rates, reduction."""
    rows = flows.count()
    seen = with_session_evidence(flows, keys, gap, alert, rows=rows)
    table = F.broadcast(flows.sparkSession.createDataFrame(rules, "rule string, family string, complexity int, level double, least long"))  # a fixed list
    rule, keep = ["rule", "family", "complexity", "level", "least"], holds(F.col("family"), F.col("level"), F.col("least"))
    per = seen.where("session is not null").groupBy(*keys, "session").agg(*(F.first(c).alias(c) for c in ("top", "n", "n30")), F.sum("label").alias("attack"))
    done = per.crossJoin(table).groupBy(*rule).agg(F.count_if(keep).alias("promoted"), F.count_if(keep & (F.col("attack") > 0)).alias("true_incidents"), F.count_if(keep & (F.col("attack") == 0)).alias("false_incidents"), F.count("*").alias("ungated"))
    ref = reference_evidence(seen, keys, gap, None, rows=rows).crossJoin(table).groupBy("rule").agg(F.count("*").alias("references"), F.count_if(keep).alias("promoted_references"))
    out = done.join(ref, "rule", "left").crossJoin(F.broadcast(capture))  # one row
    recall = F.try_divide("promoted_references", "references")
    return out.withColumns(
        {
            "missed_references": F.col("references") - F.col("promoted_references"), "recall": recall, "precision": F.try_divide("true_incidents", "promoted"), "false_per_hour": F.col("false_incidents") / F.col("hours"),
            "promoted_per_hour": F.col("promoted") / F.col("hours"), "fewer": F.col("ungated") - F.col("promoted"), "reduction": 1 - F.col("promoted") / F.col("ungated"), "reaches_recall": F.coalesce(recall >= least_recall, F.lit(False)),
        }
    )


def select_rule(grid: DataFrame) -> DataFrame:
    """One rule: among those that reach the recall (or, if none does, the best recall first) the fewest false
    incidents, then the fewest in all, the simplest, the most precise."""
    recall = F.when(F.col("reaches_recall"), 0.0).otherwise(-F.col("recall"))
    return grid.orderBy(F.desc("reaches_recall"), recall, "false_incidents", "promoted", "complexity", F.desc_nulls_last("precision"), "rule").limit(1)


def promotion_effect(flows: DataFrame, keys: list[str], gap: int, alert: float, promote: float, capture: DataFrame) -> DataFrame:
    """One row: incidents, false, true and mixed ones, references found, recall, precision and rates before and after
    promotion, and the reductions."""
    rows = flows.count()
    seen = with_session_evidence(flows, keys, gap, alert, rows=rows)
    per = seen.where("session is not null").groupBy(*keys, "session").agg(F.first("top").alias("top"), F.count("*").alias("n"), F.sum("label").alias("attack"))
    ref = reference_evidence(seen, keys, gap, None, rows=rows)
    stages = {"all": F.lit(True), "promoted": F.col("top") >= promote}
    counted = per.agg(*(x for s, c in stages.items() for x in (
        F.count_if(c).alias(f"{s}_incidents"), F.count_if(c & (F.col("attack") == 0)).alias(f"{s}_false"), F.count_if(c & (F.col("attack") > 0)).alias(f"{s}_true"), F.count_if(c & (F.col("attack") > 0) & (F.col("attack") < F.col("n"))).alias(f"{s}_mixed"))))
    found = ref.agg(F.count("*").alias("references"), n_if("hits > 0").alias("all_references"), F.count_if(F.col("top") >= promote).alias("promoted_references"))
    out = counted.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(capture))  # one row each
    for s in stages:
        out = out.withColumns({f"{s}_recall": F.try_divide(f"{s}_references", "references"), f"{s}_precision": F.try_divide(f"{s}_true", f"{s}_incidents"), f"{s}_per_hour": F.col(f"{s}_incidents") / F.col("hours"), f"{s}_false_per_hour": F.col(f"{s}_false") / F.col("hours")})
    fewer = lambda c: 1 - F.try_divide(f"promoted_{c}", f"all_{c}")
    return out.withColumns({"incident_reduction": fewer("incidents"), "false_reduction": fewer("false"), "fewer_incidents": F.col("all_incidents") - F.col("promoted_incidents"), "fewer_false": F.col("all_false") - F.col("promoted_false")})


def category_metrics(flows: DataFrame, keys: list[str], gap: int, alert: float, promote: float, least: int = 20) -> DataFrame:
    """Recall of flows and of reference incidents by category: found by any incident, and by a promoted one."""
    rows = flows.count()
    ref = reference_evidence(with_session_evidence(flows, keys, gap, alert, rows=rows), keys, gap, rows=rows)
    out = ref.groupBy("category").agg(F.sum("flows").alias("attack_flows"), F.sum("hits").alias("detected_flows"), F.count("*").alias("references"), n_if("hits > 0").alias("detected"), F.count_if(F.col("top") >= promote).alias("promoted"))
    share = lambda a, b: F.col(a) / F.col(b)
    return out.withColumns({"flow_recall": share("detected_flows", "attack_flows"), "recall": share("detected", "references"), "promoted_missed": F.col("references") - F.col("promoted"), "promoted_recall": share("promoted", "references"), "sufficient_ground_truth": F.col("references") >= least})


def stage_comparison(flows: DataFrame, keys: list[str], gap: int, alert: float, promote: float, period: str = "period", per_hour: float = 3600.0) -> DataFrame:
    """Long table by period and stage (flows, incidents, promoted): volume, false ones, recall, precision, rates.
    Every period is grouped for itself."""
    keyed = [period, *keys]
    rows = flows.count()
    seen = with_session_evidence(flows, keyed, gap, alert, rows=rows)
    hours = flows.groupBy(period).agg(((F.max("t") - F.min("t") + 1) / per_hour).alias("hours"))
    per = seen.where("session is not null").groupBy(*keyed, "session").agg(F.first("top").alias("top"), F.count("*").alias("n"), F.sum("label").alias("attack"))
    ref = reference_evidence(seen, keyed, gap, None, rows=rows).groupBy(period).agg(F.count("*").alias("references"), n_if("hits > 0").alias("incidents"), F.count_if(F.col("top") >= promote).alias("promoted"), F.sum("flows").alias("attacks"), F.sum("hits").alias("flows"))
    ref = ref.select(period, F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("found"), F.col(n).alias("wanted")) for s, n in (("flows", "attacks"), ("incidents", "references"), ("promoted", "references"))))).alias("x")).select(period, "x.*")
    some = lambda s, x, false: x.groupBy(period).agg(F.count("*").alias("objects"), F.count_if(false).alias("false_objects")).withColumn("stage", F.lit(s))
    none = F.col("attack") == 0
    every = some("flows", seen.where("session is not null"), F.col("label") == 0).unionByName(some("incidents", per, none)).unionByName(some("promoted", per.where(F.col("top") >= promote), none))
    out = every.join(ref, [period, "stage"], "left").join(hours, period)
    return out.withColumns({"recall": F.try_divide("found", "wanted"), "precision": 1 - F.col("false_objects") / F.col("objects"), "objects_per_hour": F.col("objects") / F.col("hours"), "false_per_hour": F.col("false_objects") / F.col("hours")})


def top_patterns(rows: DataFrame, group: str, pattern: str = "pattern", most: int = 20) -> DataFrame:
    """The ``most`` patterns of each group by rows, with rank, cumulative share, and whether one holds half of all."""
    per = rows.groupBy(group, pattern).agg(F.count("*").alias("flows"))
    total = per.groupBy(group).agg(F.sum("flows").alias("_total"), F.max("flows").alias("_most"))
    w = Window.partitionBy(group).orderBy(F.desc("flows"), pattern)
    out = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("cumulative", F.sum("flows").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(total, group)
    return out.withColumns({"cumulative_share": F.col("cumulative") / F.col("_total"), "one_dominates": 2 * F.col("_most") >= F.col("_total")}).drop("_total", "_most")
