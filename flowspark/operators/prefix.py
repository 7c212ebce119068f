"""Running sums and exact quantiles over an order of any length.

A window over all values of one group is one task, however many values there are.  Here each group's
values are first dealt into ranges of about equal size (by approximate quantiles, found in one
aggregate of bounded size); sums run inside the ranges, and the ranges' totals, a few rows a
group, are summed before them.  The result is exact whatever the ranges are.

Counts by value come in once and are written, and so are their running sums: each statistic then reads that one table, whatever
the counts were made from.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import if_small, written

PIECES = 64


def running_sums(counts: DataFrame, by: list[str], order: str, columns: list[str], descending: bool = False, pieces: int = PIECES) -> DataFrame:
    """``counts`` (one row a value of ``order``) with ``run_<c>``, the sum up to and with the row, and
    ``all_<c>``, the group's sum, of each column, as a written table.  A null ``order`` is refused.  A group has a row of edges and
    ``pieces`` of totals at most; they are broadcast if there are few groups."""
    counts = written(counts, "counts")
    cuts = F.percentile_approx(order, F.array(*(F.lit(k / pieces) for k in range(1, pieces))), 2000)
    edges = counts.groupBy(*by).agg(cuts.alias("_edges"))
    groups = 1
    if by:
        edges = written(edges, "edges")
        groups = edges.count()
    dealt = counts.join(if_small(edges, groups, 20_000), by) if by else counts.crossJoin(F.broadcast(edges))  # one row
    dealt = dealt.withColumn("_piece", F.size(F.filter("_edges", lambda e: e <= F.col(order)))).drop("_edges")
    ways = lambda c: F.desc(c) if descending else F.asc(c)
    total = dealt.groupBy(*by, "_piece").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    before = Window.partitionBy(*by).orderBy(ways("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    # at most ``pieces`` rows a group
    total = total.select(*by, "_piece", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns), *(F.sum(f"_t_{c}").over(every).alias(f"all_{c}") for c in columns))
    inside = Window.partitionBy(*by, "_piece").orderBy(ways(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_r_{c}": F.sum(c).over(inside) for c in columns}).join(if_small(total, groups * pieces), [*by, "_piece"])
    out = out.select(*counts.columns, *((F.col(f"_b_{c}") + F.col(f"_r_{c}")).alias(f"run_{c}") for c in columns), *(f"all_{c}" for c in columns))
    return written(out, "running")


def quantiles_of(run: DataFrame, by: list[str], value: str, count: str, shares: list[float]) -> DataFrame:
    """Per group the quantiles (linear between neighbours) of ``value`` weighted by ``count``, an array ``q``, from
    the running sums of ``count``.  Ranks are worked out in whole numbers, so no share is off by a last bit."""
    exact = [Fraction(s).limit_denominator(1_000_000) for s in shares]
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s.numerator).cast("long").alias("p"), F.lit(s.denominator).cast("long").alias("d")) for i, s in enumerate(exact))))
    rank = run.where(F.col(count) > 0).select(*by, value, F.col(count).alias("n"), F.col(f"run_{count}").alias("run"), F.col(f"all_{count}").alias("all"), wanted.alias("w"))
    rank = rank.withColumns({"lo": F.expr("w.p * (all - 1) div w.d"), "over": F.expr("(w.p * (all - 1)) % w.d")})
    holds = lambda r: (F.col("run") - F.col("n") <= r) & (r < F.col("run"))
    near = rank.where(holds(F.col("lo")) | (F.col("over") > 0) & holds(F.col("lo") + 1))
    near = near.groupBy(*by, F.col("w.i").alias("i")).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.first(F.col("over") / F.col("w.d")).alias("part"))
    each = near.withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("q"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group the quantiles (linear between neighbours) as an array ``q``; nulls and NaN are left out."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count("*").alias("n"))
    return quantiles_of(running_sums(counts, by, value, ["n"]), by, value, "n", shares)


def positions(df: DataFrame, order: list[str], by: list[str] = (), name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based place in ``order`` within ``by`` (a null is a group like any other), whatever the number of rows: they
    are dealt by ranges of (by, order), written, and counted by (by, range); a place is the place in the range, plus the counts before.  Rows that are
    equal in both may be split between ranges and come in any order.  Groups in few ranges are many rows of counts: meant for few groups, or none."""
    keys = [*by, *order]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    rows = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    runs = rows.groupBy(*by, "_part").agg(F.count("*").alias("_here"), F.min("_at").alias("_first"))
    # a row a range in a group
    before = F.sum("_here").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(*(F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)), F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "ranges")
    same = rows["_part"] == runs["_of"]
    for i, b in enumerate(by):
        same &= rows[b].eqNullSafe(runs[f"_by_{i}"])
    out = rows.join(if_small(runs, runs.count()), same)
    return out.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
