"""Queries on streams: the events file is streamed to its end, what the watermark has closed is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import flow_features
from ..sources.adapters import table
from ..sources.files import shared_folder
from ..streaming import flows as st


def events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as a stream takes a single file only through one
    return st.source(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def stream_incidents(spark, sf_dir):
    alerts = events(spark, sf_dir).where("value >= 5")
    out = st.incidents(alerts, ["user_id", "event_type"], "ts", "24 hours", "0 seconds", "value", 30.0)
    return ntz(st.drain(out, shared_folder(spark)), "first_seen", "last_seen")


def tumbling_counts(spark, sf_dir):
    return ntz(st.drain(st.counts(events(spark, sf_dir), "event_type", "ts", "0 seconds", "6 hours"), shared_folder(spark)), "start", "end")


def sliding_counts(spark, sf_dir):
    return ntz(st.drain(st.counts(events(spark, sf_dir), "event_type", "ts", "0 seconds", "12 hours", "4 hours"), shared_folder(spark)), "start", "end")


def stream_features(spark, sf_dir):
    out = st.drain(st.causal_features(events(spark, sf_dir), "user_id", "event_id", "ts", "value", "0 seconds", 86_400_000), shared_folder(spark))
    return out.withColumn("amount", F.round("amount", 4))


HOURS = flow_features(6, 24, 3_600_000_000)
SHAPE = {"src": "user_id", "dst": "event_type", "sport": "event_id % 7", "dport": "event_id % 3", "proto": "case event_id % 4 when 0 then 6 when 1 then 17 end", "bytes": "case when event_id % 11 > 0 then value end", "packets": "event_id % 5", "syn": "event_id % 2", "rst": "case when event_id % 3 > 0 then 1 end"}


def stream_flow_features(spark, sf_dir):
    """All 43 features of flows with nulls, by source and by destination, each from a stream of its own."""
    out = None
    for side in ("src", "dst"):
        mine = [f for f in HOURS if f.keys[0] == side]
        flows = events(spark, sf_dir).selectExpr("event_id id", "ts", *(f"{e} {c}" for c, e in SHAPE.items()))
        part = st.drain(st.features_on_stream(flows, mine, "id", "ts", "0 seconds"), shared_folder(spark))
        out = part if out is None else out.join(part, "id")
    return out.select("id", *(F.round(F.col(f.name) + 1e-7, 4).alias(f.name) if f.what in ("sum", "avg", "share", "diversity") else F.col(f.name) for f in HOURS))


def flow_features_sql() -> str:
    columns, windows = [], {}
    for f in HOURS:
        w = "w_" + "_".join(f.keys) + f"_{f.window or 'all'}"
        windows[w] = f"{w} as (partition by {', '.join(f.keys)} order by t range between {'unbounded' if f.window is None else f.window * f.scale} preceding and current row exclude group)"
        number = lambda e: f"round(coalesce({e}, 0) + 1e-7, 4)"
        rows = f"nullif(count(*) over {w}, 0)"
        columns.append({
            "count": f"count(*) over {w}", "distinct": f"count(distinct {f.column}) over {w}", "sum": number(f"(sum({f.column}::double) over {w})"), "avg": number(f"(sum({f.column}::double) over {w}) / nullif(count({f.column}) over {w}, 0)"),
            "since": f"coalesce(t - max(t) over {w}, -1)", "share": number(f"(sum(case when {f.column} = {f.value} then 1 else 0 end) over {w})::double / {rows}"), "diversity": number(f"(count(distinct {f.column}) over {w})::double / {rows}"),
        }[f.what] + f" {f.name}")
    shape = ", ".join(f"{e.replace('value', chr(34) + 'value' + chr(34))} {c}" for c, e in SHAPE.items())
    return f"with fl as (select event_id id, epoch_us(ts) t, {shape} from events), f as (select id, t, {', '.join(columns)} from fl window {', '.join(windows.values())}) select * exclude (t) from f where t < 1000 * {LAST.format('events')}"


QUERIES = {f.__name__: f for f in (stream_incidents, tumbling_counts, sliding_counts, stream_features, stream_flow_features)}
LAST = "(select max(epoch_us(ts)) // 1000 from {})"
SQL = {
    "stream_incidents": f"""with al as (select *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id, event_type order by ts) > 86400000000)::int, 1) nw from events where "value" >= 5),
        s as (select *, sum(nw) over (partition by user_id, event_type order by ts range between unbounded preceding and current row) s from al),
        i as (select user_id, event_type, min(ts) first_seen, max(ts) last_seen, count(*) flows, max("value") max_score, max("value") >= 30 promoted from s group by user_id, event_type, s)
        select * from i where epoch_us(last_seen) + 86400000000 <= 1000 * {LAST.format('al')}""",
    "tumbling_counts": f"""with w as (select event_type, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') "start", count(*) n from events group by all)
        select event_type, "start", "start" + interval '6 hours' "end", n from w where epoch_us("start") // 1000 + 21600000 <= {LAST.format('events')}""",
    "sliding_counts": f"""with w as (select event_type, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') - k * interval '4 hours' "start", count(*) n from events, range(3) r(k) group by all)
        select event_type, "start", "start" + interval '12 hours' "end", n from w where epoch_us("start") // 1000 + 43200000 <= {LAST.format('events')}""",
    "stream_features": f"""with f as (select event_id id, epoch_us(ts) t, count(*) over w conn, round(coalesce(sum("value") over w, 0), 4) amount, coalesce(epoch_us(ts) - max(epoch_us(ts)) over h, -1) micros_since from events
        window w as (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row exclude group), h as (partition by user_id order by epoch_us(ts) range between unbounded preceding and current row exclude group))
        select id, conn, amount, micros_since from f where t < 1000 * {LAST.format('events')}""",
    "stream_flow_features": flow_features_sql(),
}
