"""Queries of validation, profiling, alignment, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..functions.tables import written
from ..operators import align as al
from ..operators import contract as ct
from ..operators import profile as pf
from ..operators import validate as va
from ..operators.features import causal, flow_features
from ..operators.prefix import exact_quantiles
from ..sources.adapters import EV, LI, flows_ev, flows_li, table
from ..sources.files import routed
from .causal import DAYS, feature_sql

CONTRACT = va.Contract(endpoints=("src",), ports=("sport", "dport"), protocol="proto", timestamp="time", numeric=("amount",), optional=("id",))


def raw_events(spark, sf_dir):
    """Events as a text table with errors in known places."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"), F.when(k % 101 == 0, "  ").otherwise(F.col("event_type")).alias("src"), F.when(k % 97 == 0, "70000").otherwise((k % 60000).cast("string")).alias("sport"),
        F.when(k % 89 == 0, "1.5").otherwise("80").alias("dport"), F.when(k % 83 == 0, "-1").when(k % 79 == 0, "x").otherwise("6").alias("proto"),
        F.when(k % 73 == 0, "31/02/2024 1:00:00 PM").otherwise(F.date_format(F.col("ts"), "dd/MM/yyyy hh:mm:ss a")).alias("time"),
        F.when(k % 71 == 0, "Infinity").when(k % 67 == 0, None).otherwise(F.col("value").cast("string")).alias("amount"),
    )


RAW = """v as (select event_id id, list_filter([case when event_id % 73 = 0 then 'timestamp:time' end, case when event_id % 101 = 0 then 'blank:src' end, case when event_id % 97 = 0 then 'port:sport' end,
 case when event_id % 89 = 0 then 'port:dport' end, case when event_id % 83 = 0 or event_id % 79 = 0 then 'protocol:proto' end, case when event_id % 71 = 0 or event_id % 67 = 0 then 'number:amount' end], lambda x: x is not null) violations from events)"""


def checked(spark, sf_dir):
    return va.with_violations(raw_events(spark, sf_dir), va.row_rules(CONTRACT))


def validate_rows(spark, sf_dir):
    return checked(spark, sf_dir).select("id", F.array_join("violations", ",").alias("violations"))


def validation_report(spark, sf_dir):
    r = va.report(checked(spark, sf_dir), "id")
    return r.select("rule", F.col("count").alias("n"), F.array_join(F.col("rows").cast("array<string>"), ",").alias("first_rows"))


def route_by_day(spark, sf_dir):
    """Rows of one capture day out of all: scanned, matched, and the first of them."""
    r = routed(table(spark, sf_dir, "events"), "ts", "2024-01-17")
    return r.agg(F.count("*").alias("scanned"), F.count_if("on_day").alias("matched"), F.min(F.when(F.col("on_day"), F.col("event_id"))).alias("first_id"))


def split_by_day(spark, sf_dir):
    """Counts before each event that start anew every capture day."""
    d = flows_ev(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    w = Window.partitionBy("day", "src").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    return d.select("id", "day", F.count("*").over(w).alias("before_today"))


def with_context(spark, sf_dir):
    flows = flows_li(spark, sf_dir).withColumn("dst", F.col("src") * 10 + F.col("dst"))
    return causal(flows, flow_features()).withColumnRenamed("cat", "attack_cat")


def output_check(spark, sf_dir):
    """What a feature table must not hold: bad targets, missing categories, values of the 43 features that are not finite."""
    full = with_context(spark, sf_dir).drop("src", "dst")  # as it is published
    return ct.output_report(full).withColumn("leaked", F.lit(",".join(sorted(set(ct.IDENTIFIERS) & set(full.columns)))))


def target_distribution(spark, sf_dir):
    return flows_li(spark, sf_dir).groupBy(F.col("cat").alias("attack_cat"), "label").agg(F.count("*").alias("n"))


def parquet_row_id(spark, sf_dir):
    """Every row with its place in its file, without any sort."""
    return table(spark, sf_dir, "lineitem").select(F.col("_metadata.row_index").alias("row_id"), "l_orderkey", "l_linenumber")


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def dup_rank(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return al.duplicate_rank(d, ["l_orderkey", "l_linenumber"], ["l_extendedprice"])


def row_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", al.fingerprint("c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("fingerprint"))


def sides(spark, sf_dir):
    """Two builds of one keyed table: the second lost and changed rows in known places."""
    a = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))
    b = a.where("p % 50 <> 0").withColumn("q", F.when(F.col("p") % 20 == 1, F.col("q") + 1).otherwise(F.col("q")))
    return a, b.withColumnsRenamed({"q": "q2", "p": "p2"})


SIDES = """a as (select l_orderkey % 5000 k, l_linenumber n, l_quantity q, l_partkey p from lineitem), b as (select k, n, case when p % 20 = 1 then q + 1 else q end q2, p p2 from a where p % 50 <> 0),
 ar as (select *, row_number() over (partition by k, n order by p, q) r from a), br as (select *, row_number() over (partition by k, n order by p2, q2) r from b), j as (select * from ar join br using (k, n, r))"""


def align_tables(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return al.mismatches(al.aligned(a, b, ["k", "n"], ["p", "q"], ["p2", "q2"]), {"quantity": ("q", "q2"), "part": ("p", "p2")})


def unmatched_rows(spark, sf_dir):
    a, b = (al.duplicate_rank(x, ["k", "n"], [o]) for x, o in zip(sides(spark, sf_dir), ("p", "p2"), strict=True))
    on = ["k", "n", "duplicate_rank"]
    left = a.join(b, on, "left_anti").agg(F.count("*").alias("only_left"))
    return left.crossJoin(b.join(a, on, "left_anti").agg(F.count("*").alias("only_right")))


def dup_stats(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
    return g.where("count > 1").agg(F.count("*").alias("groups"), F.sum("count").alias("rows"), F.max("count").alias("largest"))


def left_complete(spark, sf_dir):
    """All orders with all customers, and whether any lacks one."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").agg(F.count("*").alias("rows"), F.count_if(F.col("c_custkey").isNull()).alias("missing"))


left_complete_whole = left_complete


def feature_parity(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    p = al.parity(al.aligned(a, b, ["k", "n"], ["p", "q"], ["p2", "q2"]), {"q": ("q", "q2"), "p": ("p", "p2")}, 0.5)
    return p.select("feature", "mismatched", F.col("max_difference").cast("double").alias("max_difference"))


def score_parity(spark, sf_dir):
    """Two scores of an event: largest difference, how many differ, and decisions that differ."""
    d = table(spark, sf_dir, "events").select((F.col("event_id") % 1000 / 1000.0).alias("a"), (F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 1000 + 5).otherwise(F.col("event_id") % 1000) / 1000.0).alias("b"))
    return d.agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 12).alias("max_difference"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("different"), F.count_if((F.col("a") >= 0.4) != (F.col("b") >= 0.4)).alias("decisions"))


def incident_parity(spark, sf_dir):
    """Sessions of events under two gaps, compared by their member sets."""
    from ..operators.incidents import gap_sessions

    def by_members(gap):
        s = gap_sessions(flows_ev(spark, sf_dir), ["src", "dst"], gap, ties=None)
        return s.groupBy("src", "dst", "session").agg(al.set_digest("id").alias("members"), F.count("*").alias("n"), F.max("bytes").alias("top")).select("members", "n", "top")

    a, b = by_members(86_400_000_000), by_members(43_200_000_000).withColumnsRenamed({"n": "n2", "top": "top2"})
    j = a.join(b, "members", "full_outer")
    return j.agg(F.count_if(F.col("n2").isNull()).alias("missing"), F.count_if(F.col("n").isNull()).alias("extra"), F.count_if(F.col("n").isNotNull() & F.col("n2").isNotNull()).alias("equal_sets"), F.count_if(F.col("top") != F.col("top2")).alias("different_top"))


EVENT = ["event_id", "user_id", "event_type", "value", "props"]


def with_gaps(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").withColumns({"event_type": F.when(k % 13 != 0, F.col("event_type")), "value": F.when(k % 17 == 0, float("inf")).when(k % 19 != 0, F.col("value")), "const": F.lit("c")})


GAPS = """g as (select event_id, ts, user_id, case when event_id % 13 <> 0 then event_type end event_type, case when event_id % 17 = 0 then 'inf'::double when event_id % 19 <> 0 then "value" end "value", props, 'c' const from events)"""


def profile_missing(spark, sf_dir):
    return pf.per_column(with_gaps(spark, sf_dir), [*EVENT, "const"], {"missing": lambda c: F.count_if(c.isNull()), "percent": lambda c: F.round(100 * F.count_if(c.isNull()) / F.count("*"), 4), "rows": lambda c: F.count("*")})


def profile_infinite(spark, sf_dir):
    return pf.per_column(with_gaps(spark, sf_dir).select(F.col("value"), F.col("user_id").cast("double").alias("user_id")), ["value", "user_id"], {"infinite": lambda c: F.count_if(F.abs(c) == float("inf"))})


def profile_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    with_ids = pf.duplicates(d, d.columns).withColumn("scope", F.lit("all columns"))
    return with_ids.unionByName(pf.duplicates(d.select("l_quantity", "l_discount", "l_tax", "l_returnflag"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"]).withColumn("scope", F.lit("without ids")))


def profile_constant(spark, sf_dir):
    return pf.per_column(with_gaps(spark, sf_dir), ["event_type", "user_id", "const"], {"constant": lambda c: (F.count_distinct(c) + F.max(c.isNull().cast("int"))) <= 1})


def value_distribution(spark, sf_dir):
    return pf.distribution(with_gaps(spark, sf_dir), "event_type")


def target_crosstab(spark, sf_dir):
    d = flows_li(spark, sf_dir)
    return d.groupBy("cat").pivot("label", [0, 1]).count().fillna(0).withColumnsRenamed({"0": "normal", "1": "attack"}).withColumn("inconsistent", F.expr("normal > 0 and attack > 0"))


def describe_numeric(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    d = table(spark, sf_dir, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    out = d.groupBy("column").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    out = out.join(exact_quantiles(d, ["column"], "value", [0.25, 0.5, 0.75]), "column")
    return out.select("column", "n", "mean", "std", "low", *(F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "high")


def describe_categorical(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").unpivot([], ["l_returnflag", "l_linestatus"], "column", "value").groupBy("column", "value").count()
    return d.groupBy("column").agg(F.sum("count").alias("n"), F.count("*").alias("uniques"), F.max_by("value", F.struct("count", "value")).alias("top"), F.max("count").alias("freq"))


def cardinality(spark, sf_dir):
    d = flows_ev(spark, sf_dir)
    return d.agg(F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("destinations"), F.count_distinct("proto").alias("protocols"), F.count_distinct(F.floor(F.col("t") / 1_000_000)).alias("seconds"), F.round(F.count_distinct("id") / F.count("*"), 6).alias("id_unique_share"))


def weekly_cardinality(spark, sf_dir):
    """Sources, destinations and events of each week, exactly, and whether the estimates from daily sketches are within five standard errors."""
    d, columns = flows_ev(spark, sf_dir).withColumn("day", F.to_date("ts")), ["src", "dst", "id"]
    week = lambda day: F.date_trunc("week", day).cast("date").cast("string")
    daily = written(pf.distinct_sketches(d, F.col("day"), columns), "sketches")
    exact = d.groupBy(week(F.col("day")).alias("week")).agg(*(F.count_distinct(c).alias(c) for c in columns)).unpivot(["week"], columns, "column", "exact")
    told = pf.distinct_estimates(daily, week(F.col("period"))).withColumnRenamed("span", "week")
    near = F.abs(F.col("estimate") - F.col("exact")) <= 1 + 5 * 1.04 / 64 * F.col("exact")
    return exact.join(told, ["week", "column"], "left").select("week", "column", "exact", F.coalesce(near, F.lit(False)).alias("near"))


def label_distribution(spark, sf_dir):
    return pf.distribution(with_gaps(spark, sf_dir), F.coalesce(F.trim("event_type"), F.lit("<MISSING>")), "label")


def daily_profile(spark, sf_dir):
    d = flows_ev(spark, sf_dir)
    bad = F.col("dst") == "error"
    return d.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"), F.count_if(bad).alias("errors"), F.count_distinct("src").alias("sources"), F.count_distinct(F.when(bad, F.col("src"))).alias("error_sources"))


def host_overlap(spark, sf_dir):
    """Sources, destinations and any endpoints that every pair of calendar days shares, pairs that share none too."""
    d = flows_ev(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    ends = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("host")) for k, c in (("src", "src"), ("dst", "dst"), ("any", "src"), ("any", "dst"))))
    hosts = d.select("day", F.explode(ends).alias("e")).select("day", "e.*").distinct()
    shared = hosts.join(hosts.withColumnRenamed("day", "other"), ["kind", "host"]).where("day < other")
    shared = shared.groupBy("day", "other").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_shared") for k in ("src", "dst", "any")))
    days = d.select("day").distinct()
    pairs = days.join(days.withColumnRenamed("day", "other"), F.col("day") < F.col("other"))
    return pairs.join(shared, ["day", "other"], "left").fillna(0, ["src_shared", "dst_shared", "any_shared"])


host_overlap_days = host_overlap


def time_quality(spark, sf_dir):
    """Seconds, peers, fractions, invalid times, and whether the file is in order of time."""
    d = flows_ev(spark, sf_dir).withColumn("sec", F.floor(F.col("t") / 1_000_000))
    rows = table(spark, sf_dir, "events").select("ts", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = pf.order_of_time(rows, "ts", "file", "row")  # one row
    per = d.groupBy("sec").agg(F.count("*").alias("n"), F.count_if(F.col("ts").cast("string").rlike(r"\.\d")).alias("frac"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_seconds"), F.max("n").alias("most_peers"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_in_shared_seconds"), F.sum("frac").alias("fractional"), F.min("sec").alias("first_second"), F.max("sec").alias("last_second")).crossJoin(F.broadcast(order))


def time_gaps(spark, sf_dir):
    d = flows_ev(spark, sf_dir).select("src", F.floor(F.col("t") / 1_000_000).alias("sec")).distinct()
    g = d.withColumn("gap", F.lead("sec").over(Window.partitionBy("src").orderBy("sec")) - F.col("sec"))
    return g.groupBy("src").agg(F.count_if(F.col("gap") > 60).alias("over_minute"), F.count_if(F.col("gap") > 3600).alias("over_hour"), F.count_if(F.col("gap") > 86400).alias("over_day"), F.max("gap").alias("longest"))


def category_set_diff(spark, sf_dir):
    """Nations that only customers have and that only suppliers have, over both whole tables."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.subtract(s).withColumn("side", F.lit("customers")).unionByName(s.subtract(c).withColumn("side", F.lit("suppliers")))


category_set_diff_whole = category_set_diff


def combined_distribution(spark, sf_dir):
    both = pf.union_all(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))
    return pf.distribution(both, "nation", "nation")


def companion_match(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows")), table(spark, sf_dir, "labels").agg(F.count("*").alias("labels"))
    return a.crossJoin(b).withColumn("matches", F.col("rows") == F.col("labels"))


def top_k(spark, sf_dir):
    """The three dearest orders of each priority."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


def set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(a.union(b).distinct(), "n_union").crossJoin(n(a.intersect(b), "n_both")).crossJoin(n(a.subtract(b), "n_only"))


BASE_SQL = {c: f"(l_partkey * {k + 3} % 997)::double" for k, c in enumerate(ct.BASELINE)}


def baseline():
    """Each baseline column, a whole number that follows from the part."""
    return {c: (F.col("l_partkey") * (k + 3) % 997).cast("double") for k, c in enumerate(ct.BASELINE)}


def metered(spark, sf_dir, kept: tuple[str, ...] = ()):
    """The contract's table over rows of a flow meter's shape: every baseline column is a whole number that follows from the
    part, a day is a second."""
    raw = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01"))
    flows = raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", 6).when(F.col("l_returnflag") == "A", 17).otherwise(1).cast("long").alias("Protocol"),
        F.timestamp_seconds(day).cast("timestamp_ntz").alias("Timestamp"),
    )
    late = baseline() | {
        "row": F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")), "Src IP": F.col("l_suppkey"), "Dst IP": F.col("l_suppkey") * 10 + F.col("l_partkey") % 4,
        "Src Port": F.col("l_partkey") * 7 % 65536, "Dst Port": (F.col("l_linenumber") % 2 * 2000).cast("long"),
    }
    return ct.model_table(flows, "row", late, kept)


def model_table(spark, sf_dir):
    """The 128 features of a model in the contract's order, with identities, of `metered` flows."""
    out = metered(spark, sf_dir).drop("flow_id", "timestamp")
    return out.select("source_row_id", "src_ip", "dst_ip", "src_port", "dst_port", "identity_protocol", *(F.round(F.col(f"`{c}`") + 1e-7, 4).alias(c) if dict(out.dtypes)[c] == "double" and c in ct.TEMPORAL else F.col(f"`{c}`") for c in ct.MODEL))


QUERIES = {
    f.__name__: f
    for f in (
        validate_rows, validation_report, route_by_day, split_by_day, output_check, target_distribution, model_table, parquet_row_id, dup_rank, row_fingerprint, align_tables, unmatched_rows, dup_stats, left_complete, feature_parity, score_parity, incident_parity,
        profile_missing, profile_infinite, profile_duplicates, profile_constant, value_distribution, target_crosstab, describe_numeric, describe_categorical, cardinality, weekly_cardinality, label_distribution, daily_profile, host_overlap,
        time_quality, time_gaps, category_set_diff, combined_distribution, companion_match, top_k, set_ops,
    )
} | {"left_complete_whole": left_complete, "host_overlap_days": host_overlap, "category_set_diff_whole": category_set_diff}  # the names of round 1
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(columns: list[str], shown: str, source: str) -> str:
    return " union all ".join(f"select '{c}' \"column\", {shown.replace('@', chr(34) + c + chr(34))} from {source}" for c in columns)


def members_sql(name: str, gap: int) -> str:
    return f"""{name}n as (select *, coalesce((t - lag(t) over (partition by src, dst order by t) > {gap})::int, 1) nw from ev), {name}s as (select *, sum(nw) over (partition by src, dst order by t range between unbounded preceding and current row) s from {name}n),
     {name} as (select string_agg(id::varchar, ',' order by id) members, max(bytes) top from {name}s group by src, dst, s)"""


def model_table_sql() -> str:
    base = ", ".join(f'{e} "{c}"' for c, e in BASE_SQL.items())
    fl = f"""fl as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey source_row_id, l_suppkey::varchar src, (l_suppkey * 10 + l_partkey % 4)::varchar dst, (l_partkey * 7 % 65536)::bigint sport, (l_linenumber % 2 * 2000)::bigint dport,
     (case l_returnflag when 'R' then 6 when 'A' then 17 else 1 end)::bigint proto, (l_shipdate::date - date '1970-01-01')::bigint t, {base}, {BASE_SQL['Total Length of Fwd Packet']} + {BASE_SQL['Total Length of Bwd Packet']} bytes,
     {BASE_SQL['Total Fwd Packet']} + {BASE_SQL['Total Bwd packets']} packets, {BASE_SQL['SYN Flag Count']} syn, {BASE_SQL['RST Flag Count']} rst from lineitem)"""
    sql = feature_sql([f.name for f in DAYS])
    columns = sql[sql.index("count(*) over", sql.index(" select src, dst")):]
    ports = ", ".join(f"({c} between {lo} and {hi})::int {side}_port_{n}" for side, c in (("src", "sport"), ("dst", "dport")) for n, lo, hi in (("well_known", 0, 1023), ("registered", 1024, 49151), ("ephemeral", 49152, 65535)))
    names = ", ".join(f'"{c}"' for c in ct.BASELINE)
    return f"with {fl} select source_row_id, src src_ip, dst dst_ip, sport src_port, dport dst_port, proto identity_protocol, {names}, sport \"Src Port\", dport \"Dst Port\", proto \"Protocol\", {ports}, {columns}"


SQL = {
    "validate_rows": f"with {RAW} select id, array_to_string(violations, ',') violations from v",
    "validation_report": f"""with {RAW}, x as (select id, unnest(violations) rule from v), r as (select *, row_number() over (partition by rule order by id) r from x)
        select rule, count(*) n, string_agg(case when r <= 20 then id::varchar end, ',' order by id) first_rows from r group by all""",
    "route_by_day": "select count(*) scanned, count(*) filter (strftime(ts, '%d/%m/%Y') = '17/01/2024') matched, min(event_id) filter (ts::date = date '2024-01-17') first_id from events",
    "split_by_day": f"with {EV} select id, strftime(ts, '%Y-%m-%d') \"day\", count(*) over (partition by ts::date, src order by t range between unbounded preceding and current row exclude group) before_today from ev",
    "output_check": f"""with f as ({feature_sql([f.name for f in DAYS])}), {LI} select count(*) "rows", (select count(*) from li where "label" is null or "label" not in (0, 1)) bad_targets, (select count(*) from li where cat is null) null_categories,
        ({' + '.join(f'count(*) filter ({f.name} is null or not isfinite({f.name}))' for f in DAYS)}) not_finite, '' leaked from f""",
    "target_distribution": f'with {LI} select cat attack_cat, "label", count(*) n from li group by all',
    "model_table": model_table_sql(),
    "dup_rank": "select l_orderkey, l_linenumber, l_extendedprice, (row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice))::int duplicate_rank from lineitem",
    "row_fingerprint": """select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') fingerprint from customer""",
    "align_tables": f"with {SIDES} select count(*) matched, count(*) filter (q is distinct from q2) quantity, count(*) filter (p is distinct from p2) part from j",
    "unmatched_rows": f"with {SIDES} select (select count(*) from ar anti join br using (k, n, r)) only_left, (select count(*) from br anti join ar using (k, n, r)) only_right",
    "dup_stats": "with g as (select count(*) n from lineitem group by l_orderkey, l_linenumber having count(*) > 1) select count(*) \"groups\", sum(n)::bigint \"rows\", max(n) largest from g",
    "left_complete": "select count(*) \"rows\", count(*) filter (c_custkey is null) missing from orders left join customer on o_custkey = c_custkey",
    "left_complete_whole": "select count(*) \"rows\", count(*) filter (c_custkey is null) missing from orders left join customer on o_custkey = c_custkey",
    "feature_parity": f"with {SIDES} select 'q' feature, count(*) filter (abs(q - q2) > 0.5) mismatched, max(abs(q - q2))::double max_difference from j union all select 'p', count(*) filter (abs(p - p2) > 0.5), max(abs(p - p2))::double from j",
    "score_parity": """with d as (select event_id % 1000 / 1000.0::double a, (event_id % 1000 + case when event_id % 11 = 0 then 5 else 0 end) / 1000.0::double b from events)
        select count(*) n, round(max(abs(a - b)), 12) max_difference, count(*) filter (abs(a - b) > 1e-12) different, count(*) filter ((a >= 0.4) <> (b >= 0.4)) decisions from d""",
    "incident_parity": f"""with {EV}, {members_sql('x', 86_400_000_000)}, {members_sql('y', 43_200_000_000)} select count(*) filter (y.members is null) missing, count(*) filter (x.members is null) extra, count(*) filter (x.members = y.members) equal_sets,
        count(*) filter (x.top <> y.top) different_top from x full join y on x.members = y.members""",
    "profile_missing": f"with {GAPS} " + each([*EVENT, "const"], "count(*) filter (@ is null) missing, round(100 * count(*) filter (@ is null) / count(*)::double, 4) \"percent\", count(*) \"rows\"", "g"),
    "profile_infinite": f"with {GAPS} " + each(["value", "user_id"], "count(*) filter (isinf(@::double)) infinite", "g"),
    "profile_duplicates": """select 'all columns' "scope", sum(n)::bigint "rows", count(*) distinct_rows, sum(n - 1)::bigint duplicates from (select count(*) n from lineitem group by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_linestatus, l_shipdate) union all select 'without ids', sum(n)::bigint, count(*), sum(n - 1)::bigint from (select count(*) n from lineitem group by l_quantity, l_discount, l_tax, l_returnflag)""",
    "profile_constant": f"with {GAPS} " + each(["event_type", "user_id", "const"], "count(distinct @) + max((@ is null)::int) <= 1 constant", "g"),
    "value_distribution": f"with {GAPS} select event_type \"value\", count(*) n, round(100 * count(*) / (select count(*) from g)::double, 4) \"percent\" from g group by all",
    "target_crosstab": f"with {LI}, c as (select cat, count(*) filter (\"label\" = 0) normal, count(*) filter (\"label\" = 1) attack from li group by all) select *, normal > 0 and attack > 0 inconsistent from c",
    "describe_numeric": each(NUM, "count(@) n, round(avg(@), 4) mean, round(stddev_samp(@), 4) std, min(@) low, round(quantile_cont(@, 0.25), 4) q25, round(quantile_cont(@, 0.5), 4) q50, round(quantile_cont(@, 0.75), 4) q75, max(@) high", "lineitem"),
    "describe_categorical": """with u as (select 'l_returnflag' "column", l_returnflag v, count(*) n from lineitem group by all union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by all)
        select "column", sum(n)::bigint n, count(*) uniques, arg_max(v, (n, v)) top, max(n) freq from u group by all""",
    "cardinality": f"with {EV} select count(distinct src) sources, count(distinct dst) destinations, count(distinct proto) protocols, count(distinct t // 1000000) \"seconds\", round(count(distinct id) / count(*)::double, 6) id_unique_share from ev",
    "weekly_cardinality": f"""with {EV}, w as (select strftime(date_trunc('week', ts), '%Y-%m-%d') "week", count(distinct src) s, count(distinct dst) d, count(distinct id) i from ev group by all)
        select "week", unnest(['src', 'dst', 'id']) "column", unnest([s, d, i]) exact, true near from w""",
    "label_distribution": f"with {GAPS} select coalesce(trim(event_type), '<MISSING>') \"label\", count(*) n, round(100 * count(*) / (select count(*) from g)::double, 4) \"percent\" from g group by all",
    "daily_profile": f"with {EV} select strftime(ts, '%Y-%m-%d') \"day\", count(*) \"rows\", count(*) filter (dst = 'error') errors, count(distinct src) sources, count(distinct src) filter (dst = 'error') error_sources from ev group by all",
    "host_overlap": f"""with {EV}, d as (select ts::date::varchar d, src::varchar src, dst::varchar dst from ev), h as (select d, 'src' k, src h from d union select d, 'dst', dst from d union select d, 'any', src from d union select d, 'any', dst from d),
        s as (select a.d d, b.d o, a.k k from h a join h b on a.k = b.k and a.h = b.h and a.d < b.d), p as (select a.d d, b.d o from (select distinct d from d) a, (select distinct d from d) b where a.d < b.d)
        select p.d "day", p.o other, count(*) filter (k = 'src') src_shared, count(*) filter (k = 'dst') dst_shared, count(*) filter (k = 'any') any_shared from p left join s using (d, o) group by all""",
    "host_overlap_days": f"""with {EV}, d as (select ts::date::varchar d, src::varchar src, dst::varchar dst from ev), h as (select d, 'src' k, src h from d union select d, 'dst', dst from d union select d, 'any', src from d union select d, 'any', dst from d),
        s as (select a.d d, b.d o, a.k k from h a join h b on a.k = b.k and a.h = b.h and a.d < b.d), p as (select a.d d, b.d o from (select distinct d from d) a, (select distinct d from d) b where a.d < b.d)
        select p.d "day", p.o other, count(*) filter (k = 'src') src_shared, count(*) filter (k = 'dst') dst_shared, count(*) filter (k = 'any') any_shared from p left join s using (d, o) group by all""",
    "time_quality": f"""with {EV}, p as (select t // 1000000 sec, count(*) n, count(*) filter (t % 1000000 <> 0) frac from ev group by all) select sum(n)::bigint "rows", count(*) unique_seconds, max(n) most_peers,
        sum(case when n > 1 then n else 0 end)::bigint rows_in_shared_seconds, sum(frac)::bigint fractional, min(sec) first_second, max(sec) last_second, any_value(invalid) invalid, any_value(reversals) reversals, any_value(reversals) = 0 is_sorted
        from p, (select count(*) filter (ts is null) invalid, count(*) filter (ts < before) reversals from (select ts, lag(ts) over (order by k) "before" from (select ts, row_number() over () k from events)))""",
    "time_gaps": f"""with {EV}, d as (select distinct src, t // 1000000 sec from ev), g as (select src, lead(sec) over (partition by src order by sec) - sec gap from d)
        select src, count(*) filter (gap > 60) over_minute, count(*) filter (gap > 3600) over_hour, count(*) filter (gap > 86400) over_day, max(gap) longest from g group by all""",
    "category_set_diff": """with c as (select distinct c_nationkey nation from customer), s as (select distinct s_nationkey nation from supplier)
        select nation, 'customers' side from c anti join s using (nation) union all select nation, 'suppliers' from s anti join c using (nation)""",
    "category_set_diff_whole": """with c as (select distinct c_nationkey nation from customer), s as (select distinct s_nationkey nation from supplier)
        select nation, 'customers' side from c anti join s using (nation) union all select nation, 'suppliers' from s anti join c using (nation)""",
    "combined_distribution": "with b as (select c_nationkey nation from customer union all select s_nationkey from supplier) select nation, count(*) n, round(100 * count(*) / (select count(*) from b)::double, 4) \"percent\" from b group by all",
    "companion_match": "select (select count(*) from documents) \"rows\", (select count(*) from labels) labels, (select count(*) from documents) = (select count(*) from labels) matches",
    "top_k": "select o_orderpriority, o_orderkey, o_totalprice, (row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey))::int \"rank\" from orders qualify \"rank\" <= 3",
    "set_ops": """with a as (select o_custkey k from orders where o_totalprice > 300000), b as (select o_custkey k from orders where o_orderstatus = 'F')
        select (select count(*) from (from a union from b)) n_union, (select count(*) from (from a intersect from b)) n_both, (select count(*) from (from a except from b)) n_only""",
}
