"""Spark ML pipelines with stratified and time-aware folds."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import dealt, if_small, written
from . import evaluate
from .prefix import quantiles_of, running_sums

#: Rows that the fits of a search which run at a time are given in all.
FITTED_ROWS = 40_000_000
#: Rows of a partition of a search's table: each task of a forest makes and shuffles the sums of all nodes of a step, whatever rows it has, so that
#: more partitions than cores cost more than they spare.
PART_ROWS = 2_000_000


def prepare(numeric: list[str], categorical: list[str]) -> list:
    """Scaled numbers and one-hot categories; an unseen category is all zeros."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_h" for c in categorical], dropLast=True)] if categorical else []
    return [
        *index, *hot, VectorAssembler(inputCols=numeric, outputCol="numbers", handleInvalid="error"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *(f"{c}_h" for c in categorical)], outputCol="features"),
    ]


def forest(trees: int = 300, depth: int = 24, seed: int = 42, **more) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="0.5", subsamplingRate=0.8, seed=seed, **more)


def boosted(rounds: int = 100, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(maxDepth=3, maxIter=rounds, stepSize=0.05, seed=seed)


def logistic(**more) -> LogisticRegression:
    return LogisticRegression(**more)


def scored(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """``df`` with the probability of class 1."""
    kept = df.columns
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).select(*kept, out)


def deal(df: DataFrame, by: str, key: Column, name: str = "place", size: str | None = None) -> DataFrame:
    """``df`` with each row's place within its stratum in the order of a digest: same rows, same places.

    A stratum may hold half of all rows, so it is cut by the digest's first two hex digits; places
    count within the pieces and the pieces' sizes are added from a table of 256 rows a stratum.
    """
    df = df.withColumns({"_d": F.unhex(F.md5(key)), "_b": F.substring(F.md5(key), 1, 2)})  # bytes in the order of their hex digits
    counts = df.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = written(counts.select(by, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias(size or "_size")), "strata")
    rows = before.groupBy(by).agg(F.max(size or "_size").alias("_of")).agg(F.sum("_of")).first()[0] or 0
    out = dealt(df, rows, by, "_b").join(if_small(before, before.count()), [by, "_b"]).withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(by, "_b").orderBy("_d")))
    return out.drop("_d", "_b", "_before", *([] if size else ["_size"]))


def stratified_split(df: DataFrame, label: str, key: Column, share: float = 0.2) -> DataFrame:
    """``df`` with ``part``: validation for the first ``share`` of each class, else train."""
    d = deal(df, label, key, size="_size")
    return d.withColumn("part", F.when(F.col("place") <= F.ceil(share * F.col("_size")), "validation").otherwise("train")).drop("place", "_size")


def stratified_folds(df: DataFrame, label: str, key: Column, folds: int = 3) -> DataFrame:
    return deal(df, label, key).withColumn("fold", ((F.col("place") - 1) % folds).cast("int")).drop("place")


def temporal_folds(df: DataFrame, time: str, bounds: list[int], purge: int) -> DataFrame:
    """Expanding folds: fold k trains on times before ``bounds[k]`` less ``purge``, predicts from bounds[k]
    up to bounds[k + 1]; rows within ``purge`` before it are left out.  One row for each use."""
    t, uses = F.col(time), []
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        role = F.when(t < lo - purge, "train").when(t < lo, "purge").when(t < hi, "predict")
        uses.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    return df.withColumn("_u", F.explode(F.array(*uses))).select("*", "_u.*").drop("_u").where("role is not null")


def fitted(tasks: list, parallelism: int, spark) -> list:
    """What each of ``tasks``, functions without arguments that fit a model, returns, in their order; up to ``parallelism`` run at a time, as
    jobs of one session that share its executors."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks))


def fit_counted(ready: PipelineModel, counts: DataFrame, logistic: LogisticRegression, n: str, weight: Column | None = None) -> PipelineModel:
    """``ready``, fitted preparations, and a logistic regression on ``counts`` of equal rows: each is one row whose weight is their number ``n`` (times
    ``weight``), so that the iterations do not grow with the rows where few of them differ.  The optimum is that of the rows themselves without
    regularisation; a penalty is refused, as Spark scales it by a deviation that takes weights for reliabilities."""
    if logistic.getRegParam() != 0:
        raise ValueError("counts stand for rows only without regularisation")
    weighted = counts.withColumn("_weight", (F.lit(1.0) if weight is None else weight) * F.col(n))
    return PipelineModel([*ready.stages, logistic.copy({logistic.weightCol: "_weight"}).fit(ready.transform(weighted))])


def bin_edges(df: DataFrame, columns: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Where the values of each column are cut into at most ``bins``, a cut with the values above it: at every value if they are no more, else at
    the distinct exact quantiles of the rows.  A fixed number of values a column comes to the driver."""
    long = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value").where("value is not null and not isnan(value)")
    run = running_sums(long.groupBy("feature", "value").agg(F.count("*").alias("n")), ["feature"], "value", ["n"])
    few = run.groupBy("feature").agg(F.count("*").alias("_values")).where(F.col("_values") <= bins).select("feature")
    out = {r.feature: r.q for r in run.join(F.broadcast(few), "feature").groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("q")).collect()}  # a row a column
    out = {c: q[1:] or q for c, q in out.items()}
    cuts = quantiles_of(run, ["feature"], "value", "n", [k / bins for k in range(1, bins)])
    return {r.feature: sorted(set(r.q)) for r in cuts.collect()} | out


def fit_binned(df: DataFrame, columns: list[str], trees: GBTClassifier, bins: int = 32) -> PipelineModel:
    """``trees`` without bagging, fitted to the counts of rows that fall into equal bins of all ``columns``: trees see the bins of rows only, so what
    a round reads does not grow with the rows where few bins differ.  Splits are looked for at every `bin_edges`, none is left to a sample."""
    if trees.getSubsamplingRate() != 1:
        raise ValueError("counts stand for rows only without bagging")
    edges, binned = bin_edges(df, columns, bins), [f"{c}_bin" for c in columns]
    cut = Bucketizer(inputCols=columns, outputCols=binned, splitsArray=[[-math.inf, *edges[c], math.inf] for c in columns])
    assemble = VectorAssembler(inputCols=binned, outputCol="features")
    counts = written(cut.transform(df).groupBy(trees.getLabelCol(), *binned).agg(F.count("*").alias("_n")), "binned")
    n = counts.count()
    # bins are numbers in an order, not categories as a Bucketizer says
    rows = assemble.transform(dealt(counts, n, *binned)).withColumn("features", F.col("features").alias("features", metadata={}))
    # Spark samples the square of maxBins rows for its splits: here all
    own = trees.copy({trees.weightCol: "_n", trees.maxBins: max(bins, math.isqrt(n) + 1)})
    return PipelineModel(stages=[cut, assemble, own.fit(rows)])


def out_of_fold(df: DataFrame, folds: int, stages: list, out: str = "p", parallelism: int = 1, read: list[str] | None = None) -> DataFrame:
    """Each row scored by the model of the other folds (column ``fold``).  ``df`` is read for every pass of every fit: a table, not a plan that sorts.
    Where ``read`` names the columns that the stages read, a last stage that is a logistic regression is fitted to their counts (`fit_counted`)."""
    last = stages[-1]
    counted = read is not None and isinstance(last, LogisticRegression)

    def fit(rows: DataFrame) -> PipelineModel:
        own = [s.copy() for s in stages]
        if not counted:
            return Pipeline(stages=own).fit(rows)
        return fit_counted(Pipeline(stages=own[:-1]).fit(rows), rows.groupBy(last.getLabelCol(), *read).agg(F.count("*").alias("_n")), own[-1], "_n")

    tasks = [lambda k=k: fit(df.where(F.col("fold") != k)) for k in range(folds)]
    parts = [scored(model, df.where(F.col("fold") == k), out) for k, model in enumerate(fitted(tasks, parallelism, df.sparkSession))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def sample_weights(category: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(category) == name, w).otherwise(out)
    return out


def importances(model, names: list[str], spark, k: int) -> DataFrame:
    ranked = sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame([(i + 1, n, x) for i, (n, x) in enumerate(ranked)], "rank int, feature string, importance double")


def fold_done(spark, path: str, config: str) -> bool:
    """Whether a fold's scores were written whole under the same configuration."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{config}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def resumable(spark, path: str, config: str, build) -> DataFrame:
    """The table of ``build()``, written once for each configuration and reused after."""
    if not fold_done(spark, path, config):
        build().write.mode("overwrite").parquet(f"{path}/{config}")
    return spark.read.parquet(f"{path}/{config}")


def check_temporal_folds(folds: DataFrame, time: str, purge: int) -> None:
    """Every fold has both roles, what it trains on ends at least ``purge`` before what it predicts, and the purge is longer
    than zero, so that no tie of times stands on both sides; otherwise ValueError."""
    ends = folds.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col(time))).alias("last"), F.min(F.when(F.col("role") == "predict", F.col(time))).alias("first")).collect()
    bad = [r.fold for r in ends if r.last is None or r.first is None or r.first - r.last < max(1, purge)]
    if bad or purge < 1:
        raise ValueError(f"folds {sorted(bad)} leak or are empty")


def check_purge(df: DataFrame, time: str, purge_rows: int) -> None:
    """A purge counted in rows must be longer than the largest group of rows of one time; otherwise ValueError."""
    most = df.groupBy(time).count().agg(F.max("count")).first()[0] or 0
    if purge_rows <= most:
        raise ValueError(f"a purge of {purge_rows} rows is within a tie of {most}")


def check_coverage(source: DataFrame, scored_rows: DataFrame, keys: list[str]) -> None:
    """Every row of ``source`` is scored once and nothing else is; otherwise ValueError."""
    n = source.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = scored_rows.groupBy(*keys).agg(F.count("*").alias("_m"))
    if not n.join(m, keys, "full_outer").where("not (_n <=> _m)").isEmpty():
        raise ValueError("rows without a score, or scored twice")


def draw_candidates(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` different combinations of the values of ``space``, the same for one seed."""
    every = list(itertools.product(*space.values()))
    chosen = random.Random(seed).sample(every, min(n, len(every)))
    return [dict(zip(space, c, strict=True)) for c in chosen]


def features_per_node(strategy: str, n: int) -> int:
    """How many of ``n`` features a node of a forest looks at: strategies that give one number give one forest."""
    named = {"all": n, "auto": math.ceil(math.sqrt(n)), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n) if re.fullmatch(r"[0-9]+", strategy) else math.ceil(float(strategy) * n)


def search(df: DataFrame, numeric: list[str], candidates: list[dict], label: str = "label", folds: int = 3, parallelism: int = 4) -> DataFrame:
    """(candidate, its settings, mean of six metrics over the folds): precision, recall, F1, specificity, ROC-AUC and
    average precision of forests at one half.  ``df``, a table and not a plan that sorts, has a column ``fold``.  All fits of all candidates and folds share one pool
    of ``parallelism`` jobs and one assembled table, which is released at the end; what a model scores is counted and written as soon as it is fitted, so that
    the models of a search are not held together.  Candidates whose forests cannot differ share one fit a fold; beyond `FITTED_ROWS` rows fewer fits run at a time, as
    each holds its binned rows."""
    spark, rows = df.sparkSession, df.count()
    assemble = VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="error")
    # named classes spare each fit a pass that looks for them
    classes = F.col(label).cast("double").alias(label, metadata={"ml_attr": {"type": "nominal", "name": label, "vals": ["0", "1"]}})
    ready = assemble.transform(df).select("fold", classes, "features").coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))).persist()
    by = ["fit", "fold"]

    def counted(i: int, k: int) -> DataFrame:
        # deep trees: a row keeps its node instead of going down from the root at each level
        c = candidates[i]
        rf = forest(seed=42, labelCol=label, cacheNodeIds=c.get("maxDepth", 0) > 8)
        for name, v in c.items():
            rf.set(rf.getParam(name), v)
        model = Pipeline(stages=[rf]).fit(ready.where(F.col("fold") != k))
        part = scored(model, ready.where(F.col("fold") == k)).select("fold", label, "p", F.lit(i).alias("fit"))
        return written(evaluate.score_counts(part.withColumn("hit", F.col("p") > 0.5), [*by, "hit"], label=label, score="p", decimals=6), "search-scores")

    ready.count()  # held before the jobs that share it begin
    alike: dict[str, list[int]] = {}
    for i, c in enumerate(candidates):
        alike.setdefault(json.dumps(c | {"featureSubsetStrategy": features_per_node(str(c.get("featureSubsetStrategy", "0.5")), len(numeric))}, sort_keys=True), []).append(i)
    # the deepest take longest and come first
    firsts = sorted((group[0] for group in alike.values()), key=lambda i: -candidates[i].get("maxDepth", 24))
    parts = fitted([lambda i=i, k=k: counted(i, k) for i in firsts for k in range(folds)], min(parallelism, max(1, FITTED_ROWS // max(1, rows))), spark)
    settings = [(f"c{i:02d}", group[0], json.dumps(candidates[i], sort_keys=True)) for group in alike.values() for i in group]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    ready.unpersist()
    some = lambda side, hit: F.coalesce(F.sum(F.when(F.col("hit") == hit, F.col(side))), F.lit(0))
    rates = evaluate.rates(counts.groupBy(*by).agg(some("neg", False).alias("tn"), some("neg", True).alias("fp"), some("pos", False).alias("fn"), some("pos", True).alias("tp")))
    per_score = counts.groupBy(*by, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = rates.join(evaluate.ranking(per_score, by), by)
    means = both.groupBy("fit").agg(*(F.avg(x).alias(x) for x in ("precision", "recall", "f1", "specificity", "fpr", "roc_auc", "average_precision")))
    out = means.join(F.broadcast(spark.createDataFrame(settings, "candidate string, fit int, settings string")), "fit")  # a row a candidate
    return out.select("candidate", *(c for c in means.columns if c != "fit"), "settings")


def select_candidate(results: DataFrame, least_recall: float = 0.975, near_fpr: float = 0.001, near_recall: float = 0.002) -> DataFrame:
    """``results`` (candidate, recall, fpr, average_precision, f1) with rank, eligible and the selected one.

    Of those with enough recall and a false positive rate near their best, the best average precision, then F1, then
    the lowest rate, then recall.  If none has the recall: of those near the best recall the lowest rate, then average
    precision, F1, recall."""
    r = lambda c: F.round(c, 9)
    every = Window.partitionBy()  # a row a candidate
    d = results.withColumn("eligible", F.col("recall") >= least_recall)
    d = d.withColumns({"_target": F.max("eligible").over(every), "_fpr": F.min(F.when(F.col("eligible"), F.col("fpr"))).over(every), "_recall": F.max("recall").over(every)})
    pool = F.when(F.col("_target"), F.col("eligible") & (F.col("fpr") <= F.col("_fpr") + near_fpr)).otherwise(F.col("recall") >= F.col("_recall") - near_recall)
    first = F.when(F.col("_target"), -r("average_precision")).otherwise(r("fpr"))
    second = F.when(F.col("_target"), -r("f1")).otherwise(-r("average_precision"))
    third = F.when(F.col("_target"), r("fpr")).otherwise(-r("f1"))
    d = d.withColumn("selected", F.row_number().over(Window.orderBy(F.desc(pool), first, second, third, -r("recall"), "candidate")) == 1)
    rank = F.row_number().over(Window.orderBy(F.desc("eligible"), r("fpr"), -r("average_precision"), -r("f1"), -r("recall"), "candidate"))
    return d.withColumn("rank", rank).drop("_target", "_fpr", "_recall")
