"""Alerts to incidents: gap sessions, their aggregates, stable ids, promotion and truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_seconds
from ..functions.tables import dealt
from .prefix import positions


@dataclass(frozen=True)
class Policy:
    """How alerts become incidents.  A flow alerts at ``alert`` or more; alerts of one key join while
    gaps are at most ``gap`` time units; an incident is promoted at ``promote`` or more."""

    alert: float = 0.10
    promote: float = 0.25
    gap: int = 300
    keys: tuple[str, ...] = ("src", "dst", "dport")

    def __post_init__(self):
        if not 0 <= self.alert <= 1 or not self.alert <= self.promote <= 1:
            raise ValueError("thresholds must satisfy 0 <= alert <= promote <= 1")
        if self.gap < 0 or not self.keys:
            raise ValueError("a policy needs a gap of 0 or more and a key")


def gap_sessions(df: DataFrame, keys: list[str], gap, time: str = "t", ties: list[str] | None = None, name: str = "session", rows: int | None = None) -> DataFrame:
    """``df`` with the number of each row's session within its key: a new one starts after a gap over ``gap``.
    The running number takes peers of one time together, so their order cannot matter.  Where the caller counted ``rows`` (at least those of
    ``df``), partitions follow them."""
    df = df if rows is None else dealt(df, rows, *keys)
    w = Window.partitionBy(*keys).orderBy(time, *(ties or []))
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def alerts(df: DataFrame, policy: Policy, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= policy.alert)


def incidents(df: DataFrame, policy: Policy, score: str = "score", time: str = "t", row_id: str | None = None) -> DataFrame:
    """One row an incident.  Flows below the alert threshold neither join nor bridge."""
    rows = gap_sessions(alerts(df, policy, score), list(policy.keys), policy.gap, time)
    members = [F.transform(F.array_sort(F.collect_list(F.struct(time, row_id))), lambda x: x[row_id]).alias("members")] if row_id else []
    out = rows.groupBy(*policy.keys, "session").agg(
        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.array_sort(F.collect_set("proto")).alias("protocols"),
        F.count("*").alias("flows"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), *members,
    )
    return out.withColumn("promoted", F.col("max_score") >= policy.promote)


def ordered(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Incidents with their 0-based number by time and key, in any time unit: ranges of (time, key) are counted, so no task holds or sums
    more than one of them."""
    return positions(found, ["first_seen", *keys], name="sequence")


def incident_id(src: Column, dst: Column, dport: Column, first: Column, last: Column) -> Column:
    """``inc_`` and the SHA-256 of a fixed text of the key and the times (timestamps without a zone)."""
    said = F.concat(F.lit("incident-v1|src_ip="), src.cast("string"), F.lit("|dst_ip="), dst.cast("string"), F.lit("|dst_port="), dport.cast("string"), F.lit("|first_seen="), iso_seconds(first), F.lit("|last_seen="), iso_seconds(last))
    return F.concat(F.lit("inc_"), F.sha2(said, 256))


#: What made the incidents (a run names its own), and
#: fixed values: names and order of the public form's fields, which readers of it expect.
VERSIONS = {"product_version": "0.1.0", "model_version": "unnamed", "feature_contract": "unnamed"}
PUBLIC = ("schema_version", "incident_id", "first_seen", "last_seen", "src_ip", "dst_ip", "dst_port", "protocols", "flow_count", "max_attack_score", "mean_attack_score", "promoted", *VERSIONS)


def public_incidents(found: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """Promoted incidents in their public form: ISO times, scores to 12 places, sorted protocols.

    ``found``: src, dst, dport, first_seen and last_seen as timestamps, protocols, flows, scores, promoted.
    """
    return found.where("promoted").select(
        F.lit("incident-v1").alias("schema_version"), incident_id(F.col("src"), F.col("dst"), F.col("dport"), F.col("first_seen"), F.col("last_seen")).alias("incident_id"),
        iso_seconds("first_seen").alias("first_seen"), iso_seconds("last_seen").alias("last_seen"), F.col("src").cast("string").alias("src_ip"), F.col("dst").cast("string").alias("dst_ip"), F.col("dport").cast("int").alias("dst_port"),
        F.array_sort(F.array_distinct("protocols")).alias("protocols"), F.col("flows").alias("flow_count"), F.round("max_score", 12).alias("max_attack_score"), F.round("mean_score", 12).alias("mean_attack_score"),
        "promoted", *(F.lit(v).alias(k) for k, v in (VERSIONS | (versions or {})).items()),
    )


def public_violations(public: DataFrame) -> DataFrame:
    """Rows of the public form that break it, with what they break."""
    rules = {
        "blank_end": (F.trim("src_ip") == "") | (F.trim("dst_ip") == "") | F.col("src_ip").isNull() | F.col("dst_ip").isNull(),
        "time_order": F.col("last_seen") < F.col("first_seen"),
        "port": ~F.col("dst_port").between(0, 65535),
        "protocol": F.exists("protocols", lambda p: (p < 0) | (p > 255)),
        "score": ~F.col("max_attack_score").between(0, 1) | ~F.col("mean_attack_score").between(0, 1) | F.isnan("max_attack_score") | F.isnan("mean_attack_score"),
    }
    if tuple(public.columns) != PUBLIC:
        raise ValueError("the public form has other columns")
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    return public.withColumn("broken", broken).where(F.size("broken") > 0)


def write_jsonl(public: DataFrame, path: str) -> None:
    """Ordered JSON lines, refused as a whole if a row breaks the form."""
    if not public_violations(public).isEmpty():
        raise ValueError("incidents break the public form")
    ranked = public.orderBy("first_seen", "src_ip", "dst_ip", "dst_port", "incident_id")
    ranked.select(F.to_json(F.struct(*public.columns)).alias("value")).write.mode("errorifexists").text(path)


def evidence(members: DataFrame, by: list[str], score: str = "score", time: str = "t", levels: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Label-free statistics of each session's scores, from its counts by distinct score in order of score: rows are counted before they
    move, and what a session needs in memory does not grow with it (its sort spills).  Null scores are flows and nothing else."""
    counts = members.groupBy(*by, F.col(score).alias("_v")).agg(F.count("*").alias("_rows"), F.count(score).alias("_n"), F.min(time).alias("_from"), F.max(time).alias("_to"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"_run": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole), "_mean": F.try_divide(F.sum(F.col("_v") * F.col("_n")).over(whole), F.sum("_n").over(whole))})

    def quantile(p: int, d: int) -> Column:
        """The quantile p / d, linear between neighbours; ranks are whole numbers."""
        rank, part = F.expr(f"{p} * (_all - 1) div {d}"), F.expr(f"({p} * (_all - 1)) % {d}")
        low, high = F.min(F.when(F.col("_run") > rank, F.col("_v"))), F.min(F.when(F.col("_run") > rank + (part > 0).cast("long"), F.col("_v")))
        return low + (high - low) * (F.max(part) / d)

    above = F.col("_all") - F.col("_run")  # scores over this one
    taken = F.when(above < 3, F.least(F.col("_n"), 3 - above)).otherwise(0)
    return run.groupBy(*by).agg(
        F.sum("_rows").alias("flows"), F.max("_v").alias("max_score"), F.max("_mean").alias("mean_score"), quantile(1, 2).alias("median_score"), quantile(9, 10).alias("p90_score"),
        F.try_divide(F.sum(F.col("_v") * taken), F.sum(F.when(F.col("_v").isNotNull(), taken))).alias("top3_mean_score"),
        *(F.coalesce(F.sum(F.when(F.col("_v") >= x, F.col("_n"))), F.lit(0)).alias(f"n_ge_{int(round(x * 100)):02d}") for x in levels),
        F.sqrt(F.try_divide(F.sum(F.col("_n") * F.pow(F.col("_v") - F.col("_mean"), 2)), F.sum("_n"))).alias("std_score"), (F.max("_to") - F.min("_from")).alias("duration"),
    )


def truth(members: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """What each session holds: attack and normal flows, and the kinds that follow."""
    out = members.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("attack_flows"), F.count_if(F.col(label) == 0).alias("normal_flows"))
    return out.withColumns(
        {
            "tp_or_mixed": F.col("attack_flows") > 0,
            "pure_false_positive": F.col("attack_flows") == 0,
            "mixed": (F.col("attack_flows") > 0) & (F.col("normal_flows") > 0),
            "attack_only": (F.col("attack_flows") > 0) & (F.col("normal_flows") == 0),
        }
    )


def reference_sessions(df: DataFrame, keys: list[str], gap: int, category: str = "cat", time: str = "t") -> DataFrame:
    """Sessions of true attacks, over all (``ALL_ATTACKS``) and within each category."""
    wide = df.where("label = 1").withColumn("category", F.explode(F.array(F.lit("ALL_ATTACKS"), F.col(category))))
    return gap_sessions(wide, ["category", *keys], gap, time)


def policy_keys(policies: dict[str, list[str]]) -> list[str]:
    """Columns of `policy_sessions` that tell the keys of one policy apart: those that the policy does not use are null."""
    return [f"_key_{k}" for k in dict.fromkeys(k for keys in policies.values() for k in keys)]


def _gaps_before(df: DataFrame, policies: dict[str, list[str]], time: str, extra: list[str] | None) -> tuple[DataFrame, list[str]]:
    """``df`` once a policy, with ``_gap``, the time since the row before of its key: one sort, whatever the number of gaps."""
    used = dict.fromkeys(k for keys in policies.values() for k in keys)
    one = [F.struct(F.lit(name).alias("policy"), *((F.col(k) if k in keys else F.lit(None)).cast(dict(df.dtypes)[k]).alias(f"_key_{k}") for k in used)) for name, keys in policies.items()]
    by = ["policy", *(extra or []), *policy_keys(policies)]
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumn("_p", F.explode(F.array(*one))).select("*", "_p.*").drop("_p").withColumn("_gap", F.col(time) - F.lag(time).over(w)), by


def policy_sessions(df: DataFrame, policies: dict[str, list[str]], gaps: list[int], time: str = "t", extra: list[str] | None = None) -> DataFrame:
    """Each alert under every policy and gap, with its session: one shuffle for the whole grid, one sort for all gaps of a policy.
    Rows that differ in ``extra`` are never in one session.  Beside ``key``, an array of texts, the columns of `policy_keys` name the key:
    what is grouped by them does not move again."""
    rows, by = _gaps_before(df, policies, time, extra)
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_s{i}": F.sum(F.coalesce((F.col("_gap") > g).cast("int"), F.lit(1))).over(w) for i, g in enumerate(gaps)})
    key = F.coalesce(*(F.when(F.col("policy") == name, F.array(*(F.col(f"_key_{k}").cast("string") for k in keys))) for name, keys in policies.items()))
    each = F.explode(F.array(*(F.struct(F.lit(g).cast("long").alias("gap"), F.col(f"_s{i}").alias("session")) for i, g in enumerate(gaps))))
    return rows.withColumn("_g", each).select(*df.columns, *policy_keys(policies), "policy", "_g.gap", key.alias("key"), "_g.session")


def session_counts(df: DataFrame, policies: dict[str, list[str]], gaps: list[int], extra: list[str], time: str = "t") -> DataFrame:
    """(policy, gap, extra, sessions): how many sessions `policy_sessions` finds; their first rows are counted."""
    rows, _ = _gaps_before(df, policies, time, extra)
    per = rows.groupBy("policy", *extra).agg(*(F.count_if(F.coalesce(F.col("_gap") > g, F.lit(True))).alias(f"_s{i}") for i, g in enumerate(gaps)))
    each = F.explode(F.array(*(F.struct(F.lit(g).cast("long").alias("gap"), F.col(f"_s{i}").alias("sessions")) for i, g in enumerate(gaps))))
    return per.withColumn("_g", each).select("policy", *extra, "_g.*")
