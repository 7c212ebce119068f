"""The given tables in the shape of flows, and the same shape as SQL views.

A flow has src, dst, sport, dport, proto, a time and its whole number ``t`` of units (days for
``flows_li``, microseconds for ``flows_ev``), bytes, packets, two flags, a category, a label
and two scores that depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    score = lambda a, b: (F.pmod(F.col("l_orderkey") * a + F.col("l_partkey") * b, F.lit(700)) + 300 * label) / 1000.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"),
        (F.col("l_partkey") % 4).alias("dst"),
        (F.col("l_partkey") % 40).alias("sport"),
        (F.col("l_linenumber") % 2).cast("long").alias("dport"),
        F.when(F.col("l_returnflag") == "R", 6).when(F.col("l_returnflag") == "A", 17).otherwise(1).alias("proto"),
        F.col("l_shipdate").alias("ts"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).cast("long").alias("t"),
        F.col("l_extendedprice").alias("bytes"),
        F.col("l_quantity").alias("packets"),
        (F.col("l_linestatus") == "O").cast("int").alias("syn"),
        (F.col("l_discount") > 0.05).cast("int").alias("rst"),
        F.concat("l_linestatus", "l_returnflag").alias("cat"),
        label.alias("label"),
        score(31, 17).alias("score"),
        score(13, 29).alias("score_b"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_partkey").alias("pkey"),
    )


LI = """li as (select l_suppkey src, l_partkey % 4 dst, l_partkey % 40 sport, (l_linenumber % 2)::bigint dport,
 case l_returnflag when 'R' then 6 when 'A' then 17 else 1 end proto, l_shipdate ts, (l_shipdate::date - date '1970-01-01')::bigint t,
 l_extendedprice bytes, l_quantity packets, (l_linestatus = 'O')::int syn, (l_discount > 0.05)::int rst, l_linestatus || l_returnflag cat,
 (l_returnflag = 'R')::int "label", ((l_orderkey * 31 + l_partkey * 17) % 700 + 300 * (l_returnflag = 'R')::int) / 1000.0::double score,
 ((l_orderkey * 13 + l_partkey * 29) % 700 + 300 * (l_returnflag = 'R')::int) / 1000.0::double score_b, l_orderkey okey, l_partkey pkey from lineitem)"""


def flows_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("src"),
        F.col("event_type").alias("dst"),
        F.get_json_object("props", "$.k").cast("int").alias("proto"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("value").alias("bytes"),
        F.lit(1.0).alias("packets"),
    )


EV = """ev as (select event_id id, user_id src, event_type dst, (props->>'$.k')::int proto, ts, epoch_us(ts) t, "value" bytes, 1.0::double packets from events)"""
