"""Queries of labelled evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import evaluate as ev
from ..operators.prefix import exact_quantiles
from ..sources.adapters import EV, LI, flows_ev, flows_li, table

RATES = ["accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "fp_per_100k"]
RATE_SQL = """round((tn + tp) / (tn + fp + fn + tp)::double, 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) "precision", round(tp / nullif(tp + fn, 0)::double, 6) recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) f1, round(tn / nullif(tn + fp, 0)::double, 6) specificity, round(fp / nullif(tn + fp, 0)::double, 6) fpr, round(fn / nullif(tp + fn, 0)::double, 6) fnr,
 round(100000 * fp / nullif(tn + fp, 0)::double, 6) fp_per_100k"""
COUNTS = """count(*) filter ("label" = 0 and not p) tn, count(*) filter ("label" = 0 and p) fp, count(*) filter ("label" = 1 and not p) fn, count(*) filter ("label" = 1 and p) tp"""


def rounded(df, columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns if c in df.columns})


def predicted(spark, sf_dir, threshold=0.4):
    return flows_li(spark, sf_dir).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def confusion(spark, sf_dir):
    return rounded(ev.confusion(predicted(spark, sf_dir), ["dport"]), RATES)


def confusion_default(spark, sf_dir):
    """The default classifier decides strictly above one half."""
    d = flows_li(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return rounded(ev.confusion(d, []), RATES)


def sweep(spark, sf_dir):
    return ev.threshold_sweep(ev.score_counts(flows_li(spark, sf_dir), ["dport"]), ["dport"], range(1, 100))


def threshold_sweep(spark, sf_dir):
    return rounded(sweep(spark, sf_dir), RATES)


SWEEP = f"""{LI}, c as (select dport, score s, count(*) filter ("label" = 1) pos, count(*) filter ("label" = 0) neg from li group by all),
 sw as (select dport, k / 100.0::double threshold, coalesce(sum(neg) filter (s < k / 100.0::double), 0)::bigint tn, coalesce(sum(neg) filter (s >= k / 100.0::double), 0)::bigint fp, coalesce(sum(pos) filter (s < k / 100.0::double), 0)::bigint fn,
  coalesce(sum(pos) filter (s >= k / 100.0::double), 0)::bigint tp from c, range(1, 100) r(k) group by all), sweep as (select *, {RATE_SQL} from sw)"""


def select_threshold(spark, sf_dir):
    """A threshold for every destination port, over all flows."""
    return rounded(ev.select_threshold(sweep(spark, sf_dir), 0.985, ["dport"]), RATES)


def roc_auc(spark, sf_dir):
    return ev.ranking(ev.score_counts(flows_li(spark, sf_dir), ["dport"]), ["dport"]).select("dport", F.round("roc_auc", 6).alias("roc_auc"))


def average_precision(spark, sf_dir):
    return ev.ranking(ev.score_counts(flows_li(spark, sf_dir), ["dport"]), ["dport"]).select("dport", F.round("average_precision", 6).alias("average_precision"))


RANK = f"""{LI}, c as (select dport, score s, count(*) filter ("label" = 1) pos, count(*) filter ("label" = 0) neg from li group by all),
 d as (select *, sum(pos) over w tp, sum(neg) over w fp from c window w as (partition by dport order by s desc))"""


def brier(spark, sf_dir):
    return flows_li(spark, sf_dir).groupBy("cat").agg(F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 6).alias("brier"))


def category_metrics(spark, sf_dir):
    d = predicted(spark, sf_dir).groupBy("cat").agg(F.count("*").alias("flows"), ev.n_if("predicted = 1").alias("alerts"), F.max("label").alias("attack"))
    return d.select("cat", "flows", "alerts", (F.col("flows") - F.col("alerts")).alias("missed"), F.when(F.col("attack") == 1, F.round(F.col("alerts") / F.col("flows"), 6)).alias("recall"), F.when(F.col("attack") == 0, F.round(F.col("alerts") / F.col("flows"), 6)).alias("fpr"))


def error_labels(spark, sf_dir):
    return predicted(spark, sf_dir).select("src", "t", ev.error_kind(F.col("label"), F.col("predicted")).alias("kind")).groupBy("src", "kind").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


def reliability(spark, sf_dir):
    return rounded(ev.reliability(flows_li(spark, sf_dir)), ["mean_score", "observed"])


def ece(spark, sf_dir):
    r = ev.reliability(flows_li(spark, sf_dir))
    return r.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n"), 6).alias("ece"))


def two_models(spark, sf_dir):
    kind = ev.overlap_kind(F.col("label"), F.col("score") >= 0.5, F.col("score_b") >= 0.5)
    return flows_li(spark, sf_dir).withColumns({"kind": kind, "delta": F.col("score_b") - F.col("score")})


OVER = f"""{LI}, o as (select *, score_b - score delta, case when "label" = 1 then case when score >= 0.5 and score_b >= 0.5 then 'both_detected' when score >= 0.5 then 'only_a_detected' when score_b >= 0.5 then 'only_b_detected' else 'both_missed' end
 else case when score >= 0.5 and score_b >= 0.5 then 'both_false_positive' when score >= 0.5 then 'only_a_false_positive' when score_b >= 0.5 then 'only_b_false_positive' else 'both_true_negative' end end kind from li)"""


def model_overlap(spark, sf_dir):
    return two_models(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"))


ATTACK_KINDS = ["both_detected", "both_missed", "only_a_detected", "only_b_detected"]


def overlap_crosstab(spark, sf_dir):
    d = two_models(spark, sf_dir).where("label = 1").withColumn("group", F.concat("cat", F.col("dport").cast("string")))
    wide = d.groupBy("group").pivot("kind", ATTACK_KINDS).count().fillna(0)
    return wide.withColumn("recovered_share", F.round(F.try_divide(F.col("only_b_detected"), F.col("only_b_detected") + F.col("both_missed")), 6))


def score_summary(spark, sf_dir):
    f = flows_li(spark, sf_dir)
    d = f.groupBy("cat").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg((F.col("score") >= 0.4).cast("int")).alias("share_alerting"))
    d = d.join(exact_quantiles(f, ["cat"], "score", [0.01, 0.25, 0.5, 0.75, 0.99]), "cat")
    d = d.select("cat", "n", "mean", "std", "low", "high", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q01", "q25", "q50", "q75", "q99"))), "share_alerting")
    return rounded(d, [c for c in d.columns if c not in ("cat", "n")])


def flow_metrics_hourly(spark, sf_dir):
    """Alerts (large values) of events by type, with hourly rates over the capture."""
    d = flows_ev(spark, sf_dir).withColumns({"sec": F.unix_seconds(F.col("ts").cast("timestamp")), "label": (F.col("proto") >= 50).cast("int"), "predicted": (F.col("bytes") >= 20).cast("int")})
    hours = d.agg(((F.max("sec") - F.min("sec") + 1) / 3600).alias("hours"))
    out = ev.confusion(d, ["dst"]).crossJoin(F.broadcast(hours))  # one row
    return rounded(out.select("dst", "tn", "fp", "fn", "tp", "precision", "recall", ((F.col("fp") + F.col("tp")) / F.col("hours")).alias("alerts_per_hour"), (F.col("fp") / F.col("hours")).alias("fp_per_hour")), ["precision", "recall", "alerts_per_hour", "fp_per_hour"])


def metric_deltas(spark, sf_dir):
    """Long table of metrics of two thresholds and their differences."""
    one = lambda t: ev.confusion(predicted(spark, sf_dir, t), []).unpivot([], RATES, "metric", "value")
    both = one(0.4).withColumnRenamed("value", "a").join(one(0.6).withColumnRenamed("value", "b"), "metric")
    return rounded(both.withColumn("delta", F.col("b") - F.col("a")), ["a", "b", "delta"])


def blend_grid(spark, sf_dir):
    """Alerts and errors of every blend of two scores, and of their maximum, at 0.5."""
    d = ev.blend_counts(flows_li(spark, sf_dir), [k / 20 for k in range(21)])
    # scores of three decimals times twentieths: five decimals, rounded before the decision
    d = d.withColumn("predicted", (F.round("s", 6) >= 0.5).cast("int"))
    return rounded(ev.confusion(d, ["candidate"], n="n"), RATES).select("candidate", "tn", "fp", "fn", "tp", "precision", "recall")


BLEND = f"""{LI}, w as (select k, case when k < 21 then 'blend_' || format('{{:.2f}}', k / 20.0::double) else 'max' end candidate from range(22) r(k)),
 bl as (select candidate, "label", round(case when k < 21 then k / 20.0::double * score + (1 - k / 20.0::double) * score_b else greatest(score, score_b) end, 6) s from li, w)"""


def ensemble_search(spark, sf_dir):
    """Each of 21 blends and the maximum with its selected threshold of 99; the best of those with enough recall is marked."""
    blended = ev.blend_counts(flows_li(spark, sf_dir), [k / 20 for k in range(21)])
    # the sweep and the ranking read one table
    counts = written(ev.score_counts(blended, ["candidate"], score="s", decimals=6, n="n"), "blends")
    chosen = ev.select_threshold(ev.threshold_sweep(counts, ["candidate"], range(1, 100)), 0.985, ["candidate"])
    out = rounded(chosen.join(ev.ranking(counts, ["candidate"]), "candidate"), ["precision", "recall", "f1", "roc_auc", "average_precision"])
    w = Window.orderBy(F.desc("eligible"), "fp", F.desc("average_precision"), F.desc("precision"), F.desc("f1"), F.desc("threshold"), "candidate")  # 22 rows
    out = out.withColumn("best", F.col("eligible") & (F.row_number().over(w) == 1))
    return out.select("candidate", "threshold", "tn", "fp", "fn", "tp", "precision", "recall", "f1", "roc_auc", "average_precision", "eligible", "best")


def score_shift(spark, sf_dir):
    """Scores of each class in two periods and whether they moved right by a tenth."""
    d = flows_li(spark, sf_dir).withColumn("period", F.when(F.col("t") < 11_600, "a").otherwise("b"))
    by = ["label", "period"]
    m = d.groupBy(*by).agg(F.avg("score").alias("mean"), F.avg((F.col("score") >= 0.4).cast("int")).alias("share")).join(exact_quantiles(d, by, "score", [0.5, 0.75]), by)
    m = m.select(*by, "mean", "share", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p75"))
    cols = ("mean", "median", "p75", "share")
    a, b = (m.where(F.col("period") == x).select("label", *(F.col(c).alias(f"{c}_{x}") for c in cols)) for x in "ab")
    out = a.join(b, "label").select("label", *(F.round(F.col(f"{c}_b") - F.col(f"{c}_a"), 6).alias(f"{c}_delta") for c in cols))
    return out.withColumn("right_shift", F.col("median_delta") >= 0.1)


def error_rows(spark, sf_dir):
    d = predicted(spark, sf_dir).where("label = 1 or predicted = 1")
    return d.select("src", "t", "label", "score", F.when(F.col("label") == 0, "false_positive").when(F.col("predicted") == 1, "detected").otherwise("missed").alias("status"))


def meta_features(spark, sf_dir):
    a, b = F.col("score"), F.col("score_b")
    return flows_li(spark, sf_dir).select("src", "t", "score", "score_b", F.round(a - b, 6).alias("difference"), F.greatest(a, b).alias("highest"), F.least(a, b).alias("lowest"), "packets")


def binary_label(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("binary_label"))


def relevant_rows(spark, sf_dir):
    """Attacks and alerts; the sizes of both and of their union must agree."""
    d = flows_li(spark, sf_dir)
    return d.groupBy("cat").agg(
        ev.n_if("label = 1 or score >= 0.4").alias("relevant"), ev.n_if("label = 1").alias("attacks"), ev.n_if("score >= 0.4").alias("alerts"), ev.n_if("label = 1 and score >= 0.4").alias("both")
    ).withColumn("agrees", F.expr("relevant = attacks + alerts - both"))


def scores_wide(spark, sf_dir):
    """One row an event, one column a score: publish several models' scores side by side."""
    d = table(spark, sf_dir, "events")
    long = d.select("event_id", F.explode(F.array(*(F.struct(F.lit(f"m{k}").alias("model"), ((F.col("event_id") * k + 7) % 100 / 100.0).alias("s")) for k in (3, 5, 7)))).alias("x")).select("event_id", "x.*")
    return long.groupBy("event_id").pivot("model", ["m3", "m5", "m7"]).agg(F.first("s"))


QUERIES = {
    f.__name__: f
    for f in (
        confusion, confusion_default, threshold_sweep, select_threshold, roc_auc, average_precision, brier, category_metrics, error_labels, reliability, ece, model_overlap, overlap_crosstab, score_summary, flow_metrics_hourly,
        metric_deltas, blend_grid, ensemble_search, score_shift, error_rows, meta_features, binary_label, relevant_rows, scores_wide,
    )
} | {"select_threshold_each": select_threshold, "ensemble_search_whole": ensemble_search}  # the names of round 1
LONG = ", ".join(f"('{m}', {m if m != 'precision' else chr(34) + 'precision' + chr(34)})" for m in RATES)
SQL = {
    "confusion": f"with {LI}, c as (select dport, {COUNTS} from (select *, score >= 0.4 p from li) group by all) select *, {RATE_SQL} from c",
    "confusion_default": f"with {LI}, c as (select {COUNTS} from (select *, score > 0.5 p from li)) select *, {RATE_SQL} from c",
    "threshold_sweep": f"with {SWEEP} select * from sweep",
    "select_threshold": f"""with {SWEEP} select *, recall >= 0.985 eligible from sweep qualify row_number() over (partition by dport order by tp / (tp + fn)::double >= 0.985 desc,
        case when tp / (tp + fn)::double >= 0.985 then 0 else -tp / (tp + fn)::double end, fp, "precision" desc, f1 desc, threshold desc) = 1""",
    "select_threshold_each": f"""with {SWEEP} select *, recall >= 0.985 eligible from sweep qualify row_number() over (partition by dport order by tp / (tp + fn)::double >= 0.985 desc,
        case when tp / (tp + fn)::double >= 0.985 then 0 else -tp / (tp + fn)::double end, fp, "precision" desc, f1 desc, threshold desc) = 1""",
    "roc_auc": f"with {RANK} select dport, round(sum(neg * (tp - pos / 2.0::double)) / (sum(pos) * sum(neg)), 6) roc_auc from d group by all",
    "average_precision": f"with {RANK} select dport, round(sum(pos * tp / (tp + fp)::double) / sum(pos), 6) average_precision from d group by all",
    "brier": f'with {LI} select cat, round(avg((score - "label") ** 2), 6) brier from li group by all',
    "category_metrics": f"""with {LI}, c as (select cat, count(*) flows, count(*) filter (score >= 0.4) alerts, max("label") a from li group by all)
        select cat, flows, alerts, flows - alerts missed, case when a = 1 then round(alerts / flows::double, 6) end recall, case when a = 0 then round(alerts / flows::double, 6) end fpr from c""",
    "error_labels": f"""with {LI} select src, case when "label" = 1 then case when score >= 0.4 then 'TP' else 'FN' end when score >= 0.4 then 'FP' else 'TN' end kind, count(*) n, min(t) first_t from li group by all""",
    "reliability": f"""with {LI} select least(floor(score * 10), 9)::int bin, count(*) n, round(avg(score), 6) mean_score, round(avg("label"), 6) observed from li group by all""",
    "ece": f"""with {LI}, r as (select least(floor(score * 10), 9)::int bin, count(*) n, avg(score) m, avg("label") o from li group by all) select round(sum(n * abs(m - o)) / sum(n), 6) ece from r""",
    "model_overlap": f"with {OVER} select kind, count(*) n, round(avg(delta), 6) mean_delta from o group by all",
    "overlap_crosstab": f"""with {OVER}, x as (select cat || dport "group", {', '.join(f"count(*) filter (kind = '{k}') {k}" for k in ATTACK_KINDS)} from o where "label" = 1 group by all)
        select *, round(only_b_detected / nullif(only_b_detected + both_missed, 0)::double, 6) recovered_share from x""",
    "score_summary": f"""with {LI} select cat, count(*) n, round(avg(score), 6) mean, round(stddev_pop(score), 6) std, min(score) low, max(score) high, {', '.join(f'round(quantile_cont(score, {int(q) / 100}), 6) q{q}' for q in ('01', '25', '50', '75', '99'))},
        round(avg((score >= 0.4)::int), 6) share_alerting from li group by all""",
    "flow_metrics_hourly": f"""with {EV}, h as (select (max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) + 1) / 3600 hrs from ev),
        c as (select dst, {COUNTS} from (select dst, (proto >= 50)::int "label", bytes >= 20 p from ev) group by all)
        select dst, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) "precision", round(tp / nullif(tp + fn, 0)::double, 6) recall, round((fp + tp) / hrs, 6) alerts_per_hour, round(fp / hrs, 6) fp_per_hour from c, h""",
    "metric_deltas": f"""with {LI}, c as (select th, {COUNTS} from (select li.*, th, score >= th p from li, (values (0.4::double), (0.6::double)) v(th)) group by all), r as (select th, {RATE_SQL.replace(', 6)', ', 15)')} from c),
        l as (select th, m.metric, m.v from r, lateral (values {LONG}) m(metric, v)) select a.metric, round(a.v, 6) a, round(b.v, 6) b, round(b.v - a.v, 6) delta from l a join l b on a.metric = b.metric and a.th = 0.4 and b.th = 0.6""",
    "blend_grid": f"with {BLEND}, c as (select candidate, {COUNTS} from (select *, s >= 0.5 p from bl) group by all), r as (select *, {RATE_SQL} from c) select candidate, tn, fp, fn, tp, \"precision\", recall from r",
    "ensemble_search_whole": f"""with {BLEND}, c as (select candidate, s, count(*) filter ("label" = 1) pos, count(*) filter ("label" = 0) neg from bl group by all),
        d as (select *, sum(pos) over w tp, sum(neg) over w fp from c window w as (partition by candidate order by s desc)),
        r as (select candidate, round(sum(neg * (tp - pos / 2.0::double)) / (sum(pos) * sum(neg)), 6) roc_auc, round(sum(pos * tp / (tp + fp)::double) / sum(pos), 6) average_precision from d group by all),
        sw as (select candidate, k / 100.0::double threshold, coalesce(sum(neg) filter (s < k / 100.0::double), 0)::bigint tn, coalesce(sum(neg) filter (s >= k / 100.0::double), 0)::bigint fp, coalesce(sum(pos) filter (s < k / 100.0::double), 0)::bigint fn,
         coalesce(sum(pos) filter (s >= k / 100.0::double), 0)::bigint tp from c, range(1, 100) x(k) group by all), q as (select *, {RATE_SQL}, tp / (tp + fn)::double >= 0.985 eligible from sw),
        f as (select * from q qualify row_number() over (partition by candidate order by eligible desc, case when eligible then 0 else -tp / (tp + fn)::double end, fp, "precision" desc, f1 desc, threshold desc) = 1)
        select candidate, threshold, tn, fp, fn, tp, "precision", recall, f1, roc_auc, average_precision, eligible,
         eligible and row_number() over (order by eligible desc, fp, average_precision desc, "precision" desc, f1 desc, threshold desc, candidate) = 1 best from f join r using (candidate)""",
    "ensemble_search": f"""with {BLEND}, c as (select candidate, s, count(*) filter ("label" = 1) pos, count(*) filter ("label" = 0) neg from bl group by all),
        d as (select *, sum(pos) over w tp, sum(neg) over w fp from c window w as (partition by candidate order by s desc)),
        r as (select candidate, round(sum(neg * (tp - pos / 2.0::double)) / (sum(pos) * sum(neg)), 6) roc_auc, round(sum(pos * tp / (tp + fp)::double) / sum(pos), 6) average_precision from d group by all),
        sw as (select candidate, k / 100.0::double threshold, coalesce(sum(neg) filter (s < k / 100.0::double), 0)::bigint tn, coalesce(sum(neg) filter (s >= k / 100.0::double), 0)::bigint fp, coalesce(sum(pos) filter (s < k / 100.0::double), 0)::bigint fn,
         coalesce(sum(pos) filter (s >= k / 100.0::double), 0)::bigint tp from c, range(1, 100) x(k) group by all), q as (select *, {RATE_SQL}, tp / (tp + fn)::double >= 0.985 eligible from sw),
        f as (select * from q qualify row_number() over (partition by candidate order by eligible desc, case when eligible then 0 else -tp / (tp + fn)::double end, fp, "precision" desc, f1 desc, threshold desc) = 1)
        select candidate, threshold, tn, fp, fn, tp, "precision", recall, f1, roc_auc, average_precision, eligible,
         eligible and row_number() over (order by eligible desc, fp, average_precision desc, "precision" desc, f1 desc, threshold desc, candidate) = 1 best from f join r using (candidate)""",
    "score_shift": f"""with {LI}, m as (select "label", t < 11600 first, avg(score) mean, median(score) med, quantile_cont(score, 0.75) p75, avg((score >= 0.4)::int) share from li group by all)
        select a."label", round(b.mean - a.mean, 6) mean_delta, round(b.med - a.med, 6) median_delta, round(b.p75 - a.p75, 6) p75_delta, round(b.share - a.share, 6) share_delta, round(b.med - a.med, 6) >= 0.1 right_shift
        from m a join m b on a."label" = b."label" and a.first and not b.first""",
    "error_rows": f"""with {LI} select src, t, "label", score, case when "label" = 0 then 'false_positive' when score >= 0.4 then 'detected' else 'missed' end status from li where "label" = 1 or score >= 0.4""",
    "meta_features": f"with {LI} select src, t, score, score_b, round(score - score_b, 6) difference, greatest(score, score_b) highest, least(score, score_b) lowest, packets from li",
    "binary_label": "select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 0 else 1 end binary_label from lineitem",
    "relevant_rows": f"""with {LI}, c as (select cat, count(*) filter ("label" = 1 or score >= 0.4) relevant, count(*) filter ("label" = 1) attacks, count(*) filter (score >= 0.4) alerts, count(*) filter ("label" = 1 and score >= 0.4) "both" from li group by all)
        select *, relevant = attacks + alerts - "both" agrees from c""",
    "scores_wide": "select event_id, (event_id * 3 + 7) % 100 / 100.0::double m3, (event_id * 5 + 7) % 100 / 100.0::double m5, (event_id * 7 + 7) % 100 / 100.0::double m7 from events",
}
