"""Queries of the causal window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import causal, causal_by_peers, flow_features, static_features
from ..sources.adapters import EV, LI, flows_ev, flows_li

DAYS = flow_features(10, 60)
HOURS = flow_features(6, 24, 3_600_000_000)
GROUPS = {
    "win_count_src": ["src_conn_10s", "src_conn_60s"],
    "win_distinct_src": ["src_unique_dst_10s", "src_unique_dst_60s", "src_unique_dport_10s", "src_unique_dport_60s"],
    "win_count_pair": ["src_dst_conn_10s", "src_dst_conn_60s", "src_dport_conn_10s", "src_dport_conn_60s", "dst_sport_conn_10s", "dst_sport_conn_60s"],
    "win_sum_src": ["src_bytes_10s", "src_bytes_60s", "src_packets_10s", "src_packets_60s"],
    "win_avg_src": ["src_mean_bytes_per_flow_60s", "src_mean_packets_per_flow_60s"],
    "win_recency": ["seconds_since_src_last_flow", "seconds_since_src_dst_last_flow", "seconds_since_dst_last_flow"],
    "win_ratio": ["src_tcp_ratio_60s", "src_udp_ratio_60s", "dst_tcp_ratio_60s", "dst_udp_ratio_60s"],
    "win_flag_sum": ["src_syn_count_60s", "src_rst_count_60s", "dst_syn_count_60s", "dst_rst_count_60s"],
    "win_diversity": ["src_dport_diversity_60s", "dst_sport_diversity_60s"],
    "win_count_dst": ["dst_conn_10s", "dst_conn_60s"],
    "win_distinct_dst": ["dst_unique_src_10s", "dst_unique_src_60s", "dst_unique_sport_10s", "dst_unique_sport_60s"],
    "win_sum_dst": ["dst_bytes_10s", "dst_bytes_60s", "dst_packets_10s", "dst_packets_60s"],
    "win_avg_dst": ["dst_mean_bytes_per_flow_60s", "dst_mean_packets_per_flow_60s"],
    "feature_subset": [
        "src_conn_10s", "src_conn_60s", "src_unique_dst_60s", "src_dst_conn_60s", "src_bytes_60s", "seconds_since_src_last_flow", "dst_conn_60s", "dst_unique_src_60s", "dst_sport_conn_60s", "dst_bytes_60s",
        "seconds_since_dst_last_flow",
    ],
}
KEYS = ["src", "dst", "sport", "dport", "t"]
BY_NAME = {f.name: f for f in DAYS}


def shown(name: str):
    f = BY_NAME[name]
    # a small shift keeps means that end in 5 from being rounded by their last bit
    return F.round(F.col(name) + 1e-7, 4).alias(name) if f.what in ("sum", "avg", "share", "diversity") else F.col(name)


def feature_query(names: list[str]):
    def run(spark, sf_dir):
        flows = flows_li(spark, sf_dir).withColumn("dst", F.col("src") * 10 + F.col("dst"))
        return causal(flows, [BY_NAME[n] for n in names]).select(*KEYS, *(shown(n) for n in names))

    return run


def feature_sql(names: list[str]) -> str:
    frames, columns = {}, []
    for n in names:
        f = BY_NAME[n]
        span = "unbounded preceding" if f.window is None else f"{f.window} preceding"
        w = "w_" + "_".join(f.keys) + f"_{f.window or 'all'}"
        frames[w] = f"{w} as (partition by {', '.join(f.keys)} order by t range between {span} and current row exclude group)"
        c = {
            "count": f"count(*) over {w}",
            "distinct": f"count(distinct {f.column}) over {w}",
            "sum": f"round(coalesce(sum({f.column}::double) over {w}, 0) + 1e-7, 4)",
            "avg": f"round(coalesce((sum({f.column}::double) over {w}) / nullif(count(*) over {w}, 0), 0) + 1e-7, 4)",
            "since": f"coalesce(t - max(t) over {w}, -1)",
            "share": f"round(coalesce((sum(case when {f.column} = {f.value} then 1 else 0 end) over {w})::double / nullif(count(*) over {w}, 0), 0) + 1e-7, 4)",
            "diversity": f"round(coalesce((count(distinct {f.column}) over {w})::double / nullif(count(*) over {w}, 0), 0) + 1e-7, 4)",
        }[f.what]
        columns.append(f"{c} {n}")
    return f"with {LI}, fl as (select * replace (src * 10 + dst as dst) from li) select {', '.join(KEYS)}, {', '.join(columns)} from fl window {', '.join(frames.values())}"


def feature_table(spark, sf_dir):
    flows = flows_li(spark, sf_dir).withColumn("dst", F.col("src") * 10 + F.col("dst"))
    full = causal(static_features(flows.withColumn("dport", F.col("dport") * 2000 + F.col("sport"))), DAYS)
    return full.select(*KEYS, "proto", *(f"{s}_port_{c}" for s in ("src", "dst") for c in ("well_known", "registered", "ephemeral")), *(shown(f.name) for f in DAYS))


def feature_table_sql() -> str:
    ports = ", ".join(f"({c} between {lo} and {hi})::int {s}_port_{n}" for s, c in (("src", "sport"), ("dst", "dport")) for n, lo, hi in (("well_known", 0, 1023), ("registered", 1024, 49151), ("ephemeral", 49152, 65535)))
    sql = feature_sql([f.name for f in DAYS])
    return sql.replace("src * 10 + dst as dst", "src * 10 + dst as dst, dport * 2000 + sport as dport").replace(", t, ", f", t, proto, {ports}, ", 1)


def peers(spark, sf_dir):
    names = ["src_conn_60s", "src_bytes_60s", "src_mean_packets_per_flow_60s", "seconds_since_src_last_flow"]
    return causal_by_peers(flows_li(spark, sf_dir), [BY_NAME[n] for n in names]).select("src", "t", *(shown(n) for n in names))


def port_class(spark, sf_dir):
    flows = flows_li(spark, sf_dir).select("src", "t", (F.col("sport") * 1500).alias("sport"), (F.col("pkey") * 7 % 65536).alias("dport"))
    return static_features(flows)


PORTS = ", ".join(f"({c} between {lo} and {hi})::int {s}_port_{n}" for s, c in (("src", "sport"), ("dst", "dport")) for n, lo, hi in (("well_known", 0, 1023), ("registered", 1024, 49151), ("ephemeral", 49152, 65535)))


SLABS = ["src_conn_10s", "src_conn_60s", "src_unique_dst_60s", "src_dst_conn_60s", "src_packets_60s", "src_tcp_ratio_60s", "src_dport_diversity_60s", "seconds_since_src_last_flow", "seconds_since_src_dst_last_flow"]


def win_slabs(spark, sf_dir):
    """Three sources have all rows, each over some twenty slabs of 128 days."""
    flows = flows_li(spark, sf_dir).withColumns({"src": F.col("src") % 3, "dst": F.col("pkey") % 50})
    return causal(flows, [BY_NAME[n] for n in SLABS], slab=128).select(*KEYS, *(shown(n) for n in SLABS))


def windows_ev(spark, sf_dir):
    names = ["src_conn_60s", "src_bytes_60s", "src_dst_conn_60s", "seconds_since_src_last_flow"]
    by = {f.name: f for f in HOURS}
    return causal(flows_ev(spark, sf_dir), [by[n] for n in names]).select("id", "src_conn_60s", F.round(F.col("src_bytes_60s"), 4).alias("src_bytes_60s"), "src_dst_conn_60s", F.col("seconds_since_src_last_flow").alias("micros_since"))


QUERIES = {k: feature_query(v) for k, v in GROUPS.items()} | {"feature_table": feature_table, "win_slabs": win_slabs, "win_peer_compaction": peers, "port_class": port_class, "windows_ev": windows_ev}
SQL = {k: feature_sql(v) for k, v in GROUPS.items()} | {
    "feature_table": feature_table_sql(),
    "win_slabs": feature_sql(SLABS).replace("src * 10 + dst as dst", "src % 3 as src, pkey % 50 as dst"),
    "win_peer_compaction": f"""with {LI} select src, t, count(*) over w src_conn_60s, round(coalesce(sum(bytes) over w, 0) + 1e-7, 4) src_bytes_60s, round(coalesce((sum(packets) over w) / nullif(count(*) over w, 0), 0) + 1e-7, 4) src_mean_packets_per_flow_60s,
        coalesce(t - max(t) over h, -1) seconds_since_src_last_flow from li window w as (partition by src order by t range between 60 preceding and current row exclude group),
        h as (partition by src order by t range between unbounded preceding and current row exclude group)""",
    "port_class": f"with {LI}, p as (select src, t, sport * 1500 sport, pkey * 7 % 65536 dport from li) select src, t, sport, dport, {PORTS} from p",
    "windows_ev": f"""with {EV} select id, count(*) over w src_conn_60s, round(coalesce(sum(bytes) over w, 0), 4) src_bytes_60s, count(*) over p src_dst_conn_60s, coalesce(t - max(t) over h, -1) micros_since from ev
        window w as (partition by src order by t range between 86400000000 preceding and current row exclude group), p as (partition by src, dst order by t range between 86400000000 preceding and current row exclude group),
        h as (partition by src order by t range between unbounded preceding and current row exclude group)""",
}
