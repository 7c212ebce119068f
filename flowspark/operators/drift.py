"""Distribution drift in long form: (feature, population, value) rows, one job for all features.

Populations are named ``a`` (reference) and ``b``.  Rows are read once, into counts by (feature, value): `profile` does so for
numeric and categorical features together, and every statistic below comes from written counts and their running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from .prefix import quantiles_of, running_sums


def long_form(df: DataFrame, features: list[str], population: str = "population", kind: str = "double") -> DataFrame:
    return df.select(population, *(F.col(c).cast(kind).alias(c) for c in features)).unpivot([population], features, "feature", "value")


def value_counts(long: DataFrame, by: list[str] = ("feature",), population: str = "population") -> DataFrame:
    """(by, value, na, nb): rows of either population by distinct value, without null and NaN."""
    clean = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return clean.groupBy(*by, "value").agg(F.count_if(F.col(population) == "a").alias("na"), F.count_if(F.col(population) == "b").alias("nb"))


def running_counts(long: DataFrame, by: list[str] = ("feature",), population: str = "population") -> DataFrame:
    """`value_counts` with their running sums: what all statistics below are made from."""
    return running_sums(value_counts(long, by, population), list(by), "value", ["na", "nb"])


def profile(df: DataFrame, numeric: list[str], text: list[str], by: list[str] = (), population: str = "population") -> tuple[DataFrame, DataFrame]:
    """Counts by value of all features in one pass over ``df``: the written counts (by, feature, value, na, nb) of the numeric ones, without
    null and NaN, and those of the categorical ones, where null is a value."""
    one = lambda c, kind: F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), (F.col(f"`{c}`").cast("double") if kind == "number" else F.lit(None).cast("double")).alias("number"), (F.col(f"`{c}`").cast("string") if kind == "text" else F.lit(None).cast("string")).alias("text"))
    values = F.explode(F.array(*(one(c, "number") for c in numeric), *(one(c, "text") for c in text)))
    rows = df.select(*by, population, values.alias("v")).select(*by, population, "v.*").where("kind = 'text' or number is not null and not isnan(number)")
    counts = written(rows.groupBy(*by, "feature", "kind", "number", "text").agg(F.count_if(F.col(population) == "a").alias("na"), F.count_if(F.col(population) == "b").alias("nb")), "profile")
    part = lambda kind, value: counts.where(F.col("kind") == kind).select(*by, "feature", F.col(value).alias("value"), "na", "nb")
    return part("number", "number"), part("text", "text")


def moments(run: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    """(by, mean_a, mean_b, var_a, var_b): means and sample variances from counts by value, in two passes over them."""
    mean = run.groupBy(*by).agg(*(F.try_divide(F.sum(F.col("value") * F.col(f"n{p}")), F.sum(f"n{p}")).alias(f"mean_{p}") for p in "ab"))
    mean = written(mean, "means")  # a row a group; its size decides how it is joined
    off = lambda p: F.pow(F.col("value") - F.col(f"mean_{p}"), 2) * F.col(f"n{p}")
    spread = run.join(mean, list(by)).groupBy(*by).agg(*(F.first(f"mean_{p}").alias(f"mean_{p}") for p in "ab"), *(F.try_divide(F.sum(off(p)), F.sum(f"n{p}") - 1).alias(f"var_{p}") for p in "ab"))
    return spread


def ks_of(run: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    distance = F.abs(F.try_divide("run_na", "all_na") - F.try_divide("run_nb", "all_nb"))
    return run.groupBy(*by).agg(F.max(distance).alias("ks"))


def ks_statistic(long: DataFrame, by: list[str] = ("feature",), population: str = "population") -> DataFrame:
    """Largest distance of the two empirical distributions, from counts by distinct value."""
    return ks_of(running_counts(long, by, population), by)


def binned_counts(run: DataFrame, by: list[str] = ("feature",), bins: int = 10) -> DataFrame:
    """(by, bin, n_edges, na, nb): counts in bins between the distinct quantiles 0..1 of the reference ``a``.

    The outer edges are open and bins are closed on the left.  Two edges leave one between them, their
    middle; a single edge leaves three bins: below it, the value itself and above it.
    """
    edges = written(quantiles_of(run, list(by), "value", "na", [k / bins for k in range(bins + 1)]).select(*by, F.array_distinct("q").alias("edges")), "edges")
    n, first, v = F.size("edges"), F.get("edges", F.lit(0)), F.col("value")
    middle = first + (F.get("edges", F.lit(1)) - first) / 2
    inner = F.slice("edges", 2, F.greatest(n - 2, F.lit(0)))
    place = F.when(n == 1, F.when(v < first, 0).when(v == first, 1).otherwise(2)).when(n == 2, (v >= middle).cast("int")).otherwise(F.size(F.filter(inner, lambda e: e <= v)))
    few = run.select(*by, "value", "na", "nb").join(edges, list(by))
    return few.groupBy(*by, place.alias("bin"), n.alias("n_edges")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def numeric_divergences(run: DataFrame, by: list[str] = ("feature",), bins: int = 10) -> DataFrame:
    """(by, psi, js) over the reference's deciles; empty bins count as 1e-10 rows before shares are taken."""
    s = clipped(shared(binned_counts(run, by, bins), list(by)), list(by))
    return s.groupBy(*by).agg(psi().alias("psi"), js().alias("js"))


def stability_index(run: DataFrame, by: list[str] = ("feature",), bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """(by, psi) with shares of at least ``epsilon``, not scaled again.  A reference of two edges has one bin, hence
    0; a constant one gives 0 if the other population is that constant too, else infinity."""
    s = shared(binned_counts(run, by, bins).withColumn("bin", F.when(F.col("n_edges") == 2, 0).otherwise(F.col("bin"))).groupBy(*by, "n_edges", "bin").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")), list(by))
    s = s.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(epsilon))) for c in ("pa", "pb")})
    off = F.sum(F.when(F.col("bin") != 1, F.col("nb")).otherwise(0))
    return s.groupBy(*by).agg(F.when(F.first("n_edges") == 1, F.when(off == 0, 0.0).otherwise(float("inf"))).otherwise(psi()).alias("psi"))


def numeric_drift(long: DataFrame, by: list[str] = ("feature",), population: str = "population") -> DataFrame:
    """(by, mean and median of either population, ks, psi, js), all from one count of the values."""
    return drift_of(running_counts(long, by, population), by)


def drift_of(run: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    """`numeric_drift` from running counts."""
    mean = run.groupBy(*by).agg(*((F.try_divide(F.sum(F.col("value") * F.col(f"n{p}")), F.sum(f"n{p}"))).alias(f"mean_{p}") for p in "ab"))
    out = mean
    for p in "ab":
        out = out.join(quantiles_of(run, list(by), "value", f"n{p}", [0.5]).select(*by, F.get("q", F.lit(0)).alias(f"median_{p}")), list(by), "left")
    return out.join(ks_of(run, by), list(by)).join(numeric_divergences(run, by), list(by), "left")


def group_quantiles(long: DataFrame, by: list[str], q: list[float]) -> DataFrame:
    """(by, n, q): rows and exact quantiles of ``value`` in each group, in value ranges."""
    counts = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))
    run = running_sums(counts, by, "value", ["n"])
    return run.groupBy(*by).agg(F.sum("n").alias("n")).join(quantiles_of(run, by, "value", "n", q), by)


def shared(counts: DataFrame, by: list[str]) -> DataFrame:
    """``counts`` with the shares of na and nb within ``by``."""
    w = Window.partitionBy(*by)
    return counts.withColumns({"pa": F.try_divide("na", F.sum("na").over(w)), "pb": F.try_divide("nb", F.sum("nb").over(w))})


def shares(rows: DataFrame, by: list[str], category: str, population: str = "population") -> DataFrame:
    """Counts and shares of every category in both populations, zeros kept."""
    return shared(rows.groupBy(*by, category).agg(F.count_if(F.col(population) == "a").alias("na"), F.count_if(F.col(population) == "b").alias("nb")), by)


def clipped(s: DataFrame, by: list[str], epsilon: float = 1e-10) -> DataFrame:
    """Shares of counts of at least ``epsilon``; those of an empty population stay null."""
    w = Window.partitionBy(*by)
    for c in "ab":
        n = F.when(F.col(f"p{c}").isNotNull(), F.greatest(F.col(f"n{c}").cast("double"), F.lit(epsilon)))
        s = s.withColumn(f"p{c}", n / F.sum(n).over(w))
    return s


def categorical_divergences(s: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    """(by, psi, js, total_variation) of `shares`."""
    tv = s.groupBy(*by).agg(total_variation().alias("total_variation"))
    return clipped(s, list(by)).groupBy(*by).agg(psi().alias("psi"), js().alias("js")).join(tv, list(by))


def unseen(s: DataFrame, by: list[str] = ("feature",), level: str = "value", sample: int = 100) -> DataFrame:
    """(by, n_unseen, sample): levels of `shares` that only the second population has, and the first of them."""
    new = s.where("na = 0 and nb > 0")
    few = new.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(level))).where(F.col("_r") <= sample)
    few = few.groupBy(*by).agg(F.array_sort(F.collect_list(level)).alias("sample"))
    return s.groupBy(*by).agg(F.count_if(F.expr("na = 0 and nb > 0")).alias("n_unseen")).join(few, list(by), "left")


def psi() -> Column:
    return F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa")))


def js(bits: bool = False) -> Column:
    """Jensen-Shannon divergence of pa and pb, in nats or bits; shares of 0 add nothing."""
    m = (F.col("pa") + F.col("pb")) / 2
    log = F.log2 if bits else F.log
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * log(F.col(c) / m)).otherwise(0.0)
    return F.sum((half("pa") + half("pb")) / 2)


def total_variation() -> Column:
    return F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2


def mean_ranks(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Average rank of each value (ties share theirs) within ``by``: counts by value first."""
    out = df
    for c in columns:
        run = running_sums(df.groupBy(*by, c).agg(F.count("*").alias("n")), by, c, ["n"])
        out = out.join(run.select(*by, c, (F.col("run_n") - (F.col("n") - 1) / 2).alias(f"rank_{c}")), [*by, c])
    return out
