"""Labelled evaluation: confusion metrics, threshold sweeps, ranking metrics, calibration.

Curves are built from counts by distinct score, aggregated first; sums along the order of scores run
over that small table.  Where a model gives as many scores as rows, `score_counts` takes a number
of decimals, so the table stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import n_if
from .prefix import running_sums


def _n_if(condition: Column, n: str | None) -> Column:
    """Rows that meet a condition, or the sum of their counts ``n``."""
    return n_if(condition) if n is None else F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0))


def confusion(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted", n: str | None = None) -> DataFrame:
    """Counts and rates; precision and F1 are 0 where undefined, rates of an absent class are null.  ``n``: a row stands for so many."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.groupBy(*by).agg(_n_if(~y & ~p, n).alias("tn"), _n_if(~y & p, n).alias("fp"), _n_if(y & ~p, n).alias("fn"), _n_if(y & p, n).alias("tp"))
    return rates(out)


def rates(out: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns(
        {
            "accuracy": F.try_divide(tn + tp, tn + fp + fn + tp),
            "precision": zero(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": zero(2 * tp, 2 * tp + fp + fn),
            "specificity": F.try_divide(tn, tn + fp),
            "fpr": F.try_divide(fp, tn + fp),
            "fnr": F.try_divide(fn, tp + fn),
            "fp_per_100k": F.try_divide(100000 * fp, tn + fp),
        }
    )


def score_counts(df: DataFrame, by: list[str], label: str = "label", score: str = "score", decimals: int | None = None, n: str | None = None) -> DataFrame:
    """Rows of each class by score; ``n``: a row stands for so many."""
    s = F.col(score) if decimals is None else F.round(score, decimals)
    return df.groupBy(*by, s.alias("s")).agg(_n_if(F.col(label) == 1, n).alias("pos"), _n_if(F.col(label) == 0, n).alias("neg"))


def threshold_sweep(counts: DataFrame, by: list[str], steps: range, scale: float = 100.0) -> DataFrame:
    """Rates at each threshold ``step / scale`` (alert at it or above), from `score_counts`.

    Each distinct score falls into the highest step it reaches; one sum down the steps gives all
    thresholds, so the cost does not grow with their number.
    """
    lo, hi = steps[0], steps[-1]
    step = F.floor(F.col("s") * scale + 1e-9).cast("int")
    put = F.when(step < lo, lo - steps.step).otherwise(F.least(F.lit(lo) + F.floor((step - lo) / steps.step).cast("int") * steps.step, F.lit(hi)))
    binned = counts.groupBy(*by, put.alias("step")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    groups = binned.select(*by).distinct() if by else binned.limit(1).select(F.lit(1).alias("_one")).select()
    grid = groups.withColumn("step", F.explode(F.sequence(F.lit(lo - steps.step), F.lit(hi), F.lit(steps.step))))
    full = grid.join(binned, [*by, "step"], "left").fillna(0, ["pos", "neg"])
    down = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    out = full.select(*by, "step", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    out = out.where(F.col("step") >= lo).select(*by, (F.col("step") / scale).alias("threshold"), (F.col("n") - F.col("fp")).alias("tn"), "fp", (F.col("p") - F.col("tp")).alias("fn"), "tp")
    return rates(out)


def select_threshold(sweep: DataFrame, least_recall: float, by: list[str] | None = None) -> DataFrame:
    """Enough recall, then fewest false, precision, F1 and the highest threshold; else most recall.  One row, or one a group of ``by``."""
    ok = F.col("recall") >= least_recall
    order = [F.desc("eligible"), F.when(ok, 0.0).otherwise(-F.col("recall")), "fp", F.desc("precision"), F.desc("f1"), F.desc("threshold")]
    out = sweep.withColumn("eligible", ok)
    if by is None:
        return out.orderBy(*order).limit(1)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def ranking(counts: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (sum of recall steps by precision)."""
    run = running_sums(counts, by, "s", ["pos", "neg"], descending=True)
    c = run.select(*by, "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    out = c.groupBy(*by).agg(area.alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return out.select(*by, F.try_divide("a", F.col("p") * F.col("n")).alias("roc_auc"), F.try_divide("ap", "p").alias("average_precision"))


def reliability(df: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Rows, mean score and observed rate by equal bins, left-closed, the last closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))


def error_kind(label: Column, predicted: Column) -> Column:
    return F.when(label == 1, F.when(predicted == 1, "TP").otherwise("FN")).otherwise(F.when(predicted == 1, "FP").otherwise("TN"))


def overlap_kind(label: Column, a: Column, b: Column) -> Column:
    """How two models agree on a row."""
    attack = F.when(a & b, "both_detected").when(a, "only_a_detected").when(b, "only_b_detected").otherwise("both_missed")
    benign = F.when(a & b, "both_false_positive").when(a, "only_a_false_positive").when(b, "only_b_false_positive").otherwise("both_true_negative")
    return F.when(label == 1, attack).otherwise(benign)


def blends(df: DataFrame, weights: list[float], a: str = "score", b: str = "score_b") -> DataFrame:
    """Long form: each row under every linear blend and the maximum of two scores."""
    mixed = [F.struct(F.lit(f"blend_{w:.2f}").alias("candidate"), (w * F.col(a) + (1 - w) * F.col(b)).alias("s")) for w in weights]
    return df.withColumn("_c", F.explode(F.array(*mixed, F.struct(F.lit("max").alias("candidate"), F.greatest(a, b).alias("s"))))).select("*", "_c.*").drop("_c")


def blend_counts(df: DataFrame, weights: list[float], label: str = "label", a: str = "score", b: str = "score_b") -> DataFrame:
    """`blends` of the distinct pairs of scores, with ``n``, the rows of each pair and label: rows are counted before they are multiplied."""
    return blends(df.groupBy(label, a, b).agg(F.count("*").alias("n")), weights, a, b)
