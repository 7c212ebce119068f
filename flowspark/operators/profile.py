"""Table profiling: one aggregate for all columns, turned to one row a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_column(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One row a column with every measure (a function from a column to an aggregate)."""
    one = df.agg(*(F.struct(F.lit(c).alias("column"), *(f(F.col(c)).alias(n) for n, f in measures.items())).alias(f"_{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(columns))))).alias("x")).select("x.*")


def distribution(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """Count and percent (4 places) of each value, nulls kept."""
    counts = df.groupBy((F.col(column) if isinstance(column, str) else column).alias(name)).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(name, "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("percent"))  # one row


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, distinct rows, and rows beyond the first of their kind."""
    g = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def by_kind(df: DataFrame) -> dict[str, list[str]]:
    """Columns by numeric, categorical and other kind, and those named like ids."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    out = {"numeric": [], "categorical": [], "other": [], "identifier": []}
    for name, kind in df.dtypes:
        low = name.lower()
        if low == "id" or low.endswith("_id"):
            out["identifier"].append(name)
        out["numeric" if kind in numeric or kind.startswith("decimal") else "categorical" if kind in ("string", "boolean") else "other"].append(name)
    return out


def schema_differences(a: DataFrame, b: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, type in a, type in b) where they differ, in order of a, then b."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    return [(c, left.get(c), right.get(c)) for c in dict.fromkeys([*left, *right]) if left.get(c) != right.get(c)]


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def order_of_time(rows: DataFrame, time: str, file: str, row: str, piece: int = 1_000_000) -> DataFrame:
    """One row: invalid (null) times, places where a row's time is before that of the row ahead of it in its file or
    at the end of the file before, and whether there is none.  Files are taken in pieces of ``piece`` rows, whose ends are
    compared from a table of one row a piece."""
    d = rows.withColumn("_p", F.floor(F.col(row) / piece))
    inside = Window.partitionBy(file, "_p").orderBy(row)
    known = F.col(time).isNotNull()
    d = d.withColumn("_back", (F.col(time) < F.lag(time).over(inside)).cast("long"))
    per = d.groupBy(file, "_p").agg(F.count_if(~known).alias("invalid"), F.sum("_back").alias("back"), F.min_by(time, F.when(known, F.col(row))).alias("first"), F.max_by(time, F.when(known, F.col(row))).alias("last"))
    ends = per.withColumn("_edge", (F.col("first") < F.lag("last").over(Window.orderBy(file, "_p"))).cast("long"))
    total = ends.agg(F.sum("invalid").alias("invalid"), (F.coalesce(F.sum("back"), F.lit(0)) + F.coalesce(F.sum("_edge"), F.lit(0))).alias("reversals"))
    return total.withColumn("is_sorted", F.col("reversals") == 0)


def distinct_sketches(df: DataFrame, period: Column, columns: list[str], lg: int = 12) -> DataFrame:
    """(period, column, sketch): mergeable counts of distinct values, 2^lg cells each, of each period and column, in one pass.  Kept as a table they
    answer for any span of periods without the rows (`distinct_estimates`); the relative standard error is about 1.04 / sqrt(2^lg), 1.6 % at
    12.  Nulls are no value.  The exact way is ``count_distinct`` over the rows."""
    made = df.groupBy(period.alias("period")).agg(*(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg)).alias(f"_{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)))
    return made.select("period", F.explode(pairs).alias("x")).select("period", "x.*")


def distinct_estimates(sketches: DataFrame, span: Column) -> DataFrame:
    """(span, column, estimate): distinct values of several periods together, from their sketches."""
    return sketches.groupBy(span.alias("span"), "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
