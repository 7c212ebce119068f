"""Lossless alignment of two tables and parity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import if_small, written
from .prefix import positions

#: Equal rows that one task ranks; those of larger groups are ranked in ranges of their order.
GROUP = 100_000


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as one ordered JSON object (nulls kept)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def duplicate_rank(df: DataFrame, columns: list[str], order: list[str], name: str = "duplicate_rank") -> DataFrame:
    """Number of each row among those equal in ``columns`` (nulls are equal).  Groups of over ``GROUP`` rows, of which there can be but few, are
    told apart first and ranked by `positions`: no group, whatever its share of the rows, is one task."""
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    names = [f"_k{i}" for i in range(len(columns))]
    hot = written(df.groupBy(*columns).count().where(F.col("count") > GROUP).select(*columns).toDF(*names), "hot-groups")
    n = hot.count()
    if not n:
        return df.withColumn(name, rank)
    same = F.lit(True)
    for c, k in zip(columns, names, strict=True):
        same &= df[c].eqNullSafe(hot[k])
    few = df.join(if_small(hot, n), same, "left_anti").withColumn(name, rank)
    many = positions(df.join(if_small(hot, n), same, "left_semi"), order, columns, name)
    return few.unionByName(many.withColumn(name, (F.col(name) + 1).cast("int")))


def set_digest(member: str | Column) -> Column:
    """Aggregate: one text for equal sets (with repeats) of members in any order, in constant memory: their number, two
    exclusive-ors and a sum of independent 64-bit hashes."""
    member = F.col(member) if isinstance(member, str) else member
    hashed = lambda k: F.xxhash64(F.lit(k), member)
    return F.concat_ws(":", F.count("*").cast("string"), F.hex(F.bit_xor(hashed(1))), F.hex(F.bit_xor(hashed(2))), F.sum(hashed(3).cast("decimal(20,0)")).cast("string"))


def aligned(left: DataFrame, right: DataFrame, columns: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides joined one to one on (columns, rank among equals), null-safe through the fingerprint."""
    a = duplicate_rank(left.withColumn("_fp", fingerprint(*columns)), ["_fp"], left_order, "_rank")
    b = duplicate_rank(right.withColumn("_fp", fingerprint(*columns)), ["_fp"], right_order, "_rank").drop(*columns)
    return a.join(b, ["_fp", "_rank"]).drop("_fp", "_rank")


def mismatches(joined: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per named pair of columns: null-safe differences, in one row."""
    return joined.agg(F.count("*").alias("matched"), *(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(n) for n, (a, b) in pairs.items()))


def parity(joined: DataFrame, pairs: dict[str, tuple[str, str]], tolerance: float) -> DataFrame:
    """Per feature: cells that differ by more than the tolerance, and the largest difference."""
    long = joined.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.abs(F.col(a) - F.col(b)).alias("d"), (~F.col(a).isNull().eqNullSafe(F.col(b).isNull())).alias("odd")) for n, (a, b) in pairs.items()))).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.count_if((F.col("d") > tolerance) | F.col("odd")).alias("mismatched"), F.max("d").alias("max_difference"))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that refuses repeated keys on either side."""
    for side in (left, right):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated keys: {on}")
    return left.join(right, on)
