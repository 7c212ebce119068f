"""Queries of distribution drift; populations are two periods of the flows, or two groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import incidents as inc
from ..operators.prefix import quantiles_of, running_sums
from ..sources.adapters import EV, LI, flows_ev, flows_li, table

FEATURES = ["bytes", "packets", "score"]
TOP_FEATURES = ["bytes", "packets", "score_b"]
MIDDLE = 11_600


def periods(spark, sf_dir):
    return flows_li(spark, sf_dir).withColumn("population", F.when(F.col("t") < MIDDLE, "a").otherwise("b"))


def long(spark, sf_dir):
    return dr.long_form(periods(spark, sf_dir), FEATURES)


LONG = f"""{LI}, lp as (select *, case when t < {MIDDLE} then 'a' else 'b' end pop from li), lg as (select pop, 'bytes' feature, bytes v from lp union all select pop, 'packets', packets from lp union all select pop, 'score', score from lp)"""


def clip_sql(source: str = "sp", by: str = "feature") -> str:
    """Counts of at least 1e-10, then shares."""
    least = f"cl as (select * replace (greatest(na, 1e-10) as na, greatest(nb, 1e-10) as nb) from {source})"
    return f"{least}, c2 as (select * replace (na / sum(na) over (partition by {by}) as pa, nb / sum(nb) over (partition by {by}) as pb) from cl)"


PSI = "round(sum((pb - pa) * ln(pb / pa)), 6)"
JS = "round(sum((case when pa > 0 then pa * ln(2 * pa / (pa + pb)) else 0 end + case when pb > 0 then pb * ln(2 * pb / (pa + pb)) else 0 end) / 2), 6)"


def ks_stat(spark, sf_dir):
    return dr.ks_statistic(long(spark, sf_dir)).select("feature", F.round("ks", 6).alias("ks"))


def psi_numeric(spark, sf_dir):
    return dr.numeric_divergences(dr.running_counts(long(spark, sf_dir))).select("feature", F.round("psi", 6).alias("psi"))


def js_numeric(spark, sf_dir):
    return dr.numeric_divergences(dr.running_counts(long(spark, sf_dir))).select("feature", F.round("js", 6).alias("js"))


def psi_simple(spark, sf_dir):
    return dr.stability_index(dr.running_counts(long(spark, sf_dir))).select("feature", F.round("psi", 6).alias("psi"))


def categorical(spark, sf_dir):
    """Language and source of documents below and above the median length; type of events in two samples."""
    docs = table(spark, sf_dir, "documents").withColumn("population", F.when(F.col("n_chars") < 1500, "a").otherwise("b"))
    one = dr.long_form(docs, ["lang", "source"], kind="string")
    events = flows_ev(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("population"), F.lit("event_type").alias("feature"), F.col("dst").alias("value"))
    return dr.shares(one.unionByName(events).fillna("<NA>", ["value"]), ["feature"], "value")


CAT = f"""{EV}, cl0 as (select case when n_chars < 1500 then 'a' else 'b' end pop, 'lang' feature, coalesce(lang, '<NA>') v from documents union all select case when n_chars < 1500 then 'a' else 'b' end, 'source', coalesce(source, '<NA>') from documents
 union all select case when id % 3 = 0 then 'a' else 'b' end, 'event_type', coalesce(dst, '<NA>') from ev), cs as (select feature, v, count(*) filter (pop = 'a') na, count(*) filter (pop = 'b') nb from cl0 group by all),
 cp as (select *, na / sum(na) over (partition by feature)::double pa, nb / sum(nb) over (partition by feature)::double pb from cs)"""


def drift_categorical(spark, sf_dir):
    return dr.categorical_divergences(categorical(spark, sf_dir)).select("feature", *(F.round(c, 6).alias(c) for c in ("psi", "js", "total_variation")))


def js_bits(spark, sf_dir):
    return categorical(spark, sf_dir).groupBy("feature").agg(F.round(dr.js(bits=True), 6).alias("js_bits"))


def numeric_summary(spark, sf_dir):
    v, by = F.col("value"), ["feature", "population"]
    d = long(spark, sf_dir).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = dr.group_quantiles(d, by, [0.5, 0.9, 0.99]).join(d.groupBy(*by).agg(F.round(F.avg(v), 4).alias("mean")), by)
    return out.select(*by, "n", "mean", *(F.round(F.get("q", F.lit(i)), 6).alias(c) for i, c in enumerate(("median", "p90", "p99"))))


def unseen_levels(spark, sf_dir):
    """Sources with orders that the second period has and the whole first has not."""
    d = periods(spark, sf_dir).withColumn("level", F.concat_ws("-", "src", "okey"))
    known = d.where("population = 'a'").select("level").distinct()
    new = d.where("population = 'b'").select("level").distinct().join(known, "level", "left_anti")
    return new.groupBy(F.substring_index("level", "-", 1).alias("src")).agg(F.count("*").alias("n_unseen"), F.min("level").alias("example"))


def level_frequencies(spark, sf_dir):
    """The twenty most frequent levels of each column and period, with their shares."""
    d = periods(spark, sf_dir).withColumn("service", F.concat_ws("/", "proto", "sport"))
    long_ = dr.long_form(d, ["proto", "service"], kind="string").groupBy("feature", "population", "value").agg(F.count("*").alias("n"))
    every = Window.partitionBy("feature", "population")
    ranked = long_.withColumns({"share": F.round(F.col("n") / F.sum("n").over(every), 6), "rank": F.row_number().over(every.orderBy(F.desc("n"), "value"))})
    return ranked.where("rank <= 20")


def unseen_sample(spark, sf_dir):
    """Levels of two columns that only the second period has: how many, and the first hundred of them."""
    d = periods(spark, sf_dir).withColumn("service", F.concat_ws("/", "src", "pkey"))
    s = dr.shares(dr.long_form(d, ["proto", "service"], kind="string"), ["feature"], "value")
    return dr.unseen(s).select("feature", "n_unseen", F.coalesce(F.array_join("sample", ","), F.lit("")).alias("sample"))


def unseen_pairs(spark, sf_dir):
    """Sources with pairs of source and part that the second period has and the whole first has not."""
    d = periods(spark, sf_dir).withColumn("level", F.concat_ws("-", "src", "pkey"))
    known = d.where("population = 'a'").select("level").distinct()
    new = d.where("population = 'b'").select("level").distinct().join(known, "level", "left_anti")
    return new.groupBy(F.substring_index("level", "-", 1).alias("src")).agg(F.count("*").alias("n_unseen"), F.min("level").alias("example"))


def feature_drift(spark, sf_dir):
    """Over all rows and over normal rows: mean, median, KS and PSI of numeric features, PSI, JS and total variation
    of categorical ones, and the drift score: a feature's largest KS or total variation in any scope."""
    scopes = F.explode(F.when(F.col("label") == 0, F.array(F.lit("all"), F.lit("normal"))).otherwise(F.array(F.lit("all"))))
    d, by = periods(spark, sf_dir).withColumn("scope", scopes), ["scope", "feature"]
    numbers, text = dr.profile(d, FEATURES, ["proto", "dst"], ["scope"])
    n = dr.drift_of(running_sums(numbers, by, "value", ["na", "nb"]), by).drop("js").withColumnRenamed("ks", "distance").withColumn("kind", F.lit("numeric"))
    c = dr.categorical_divergences(dr.shared(text, by), by).withColumnRenamed("total_variation", "distance").withColumn("kind", F.lit("categorical"))
    out = n.unionByName(c, allowMissingColumns=True).withColumn("drift_score", F.max("distance").over(Window.partitionBy("feature")))
    return out.select(*by, "kind", *(F.round(x, 4).alias(x) for x in ("mean_a", "median_a", "mean_b", "median_b")), *(F.round(x, 6).alias(x) for x in ("distance", "psi", "js", "drift_score")))


def category_shift(spark, sf_dir):
    s = categorical(spark, sf_dir)
    return s.select("feature", F.col("value").alias("category"), "na", "nb", F.round("pa", 6).alias("share_a"), F.round("pb", 6).alias("share_b"), F.round(F.col("pb") - F.col("pa"), 6).alias("change"), (F.col("na") == 0).alias("unseen"))


def group_compare(spark, sf_dir):
    """False positives against true negatives over every feature."""
    d = flows_li(spark, sf_dir).where("label = 0").withColumn("population", F.when(F.col("score") >= 0.4, "a").otherwise("b"))
    out = dr.numeric_drift(dr.long_form(d, FEATURES))
    return out.select("feature", F.round("median_a", 4).alias("median_fp"), F.round("median_b", 4).alias("median_tn"), F.round("ks", 6).alias("ks"))


def drift_5pop(spark, sf_dir):
    """Quantiles of every feature in five populations, one row a feature and population."""
    pop = F.when(F.col("label") == 1, F.when(F.col("score") >= 0.4, "detected").otherwise("missed")).when(F.col("score") >= 0.4, "false_positive").otherwise("true_negative")
    d = flows_li(spark, sf_dir).withColumn("population", F.explode(F.array(F.lit("all"), pop)))
    out = dr.group_quantiles(dr.long_form(d, FEATURES), ["feature", "population"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.select("feature", "population", "n", *(F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))))


def category_profile(spark, sf_dir):
    d = periods(spark, sf_dir)
    out = d.groupBy("proto").agg(F.count_if(F.col("population") == "a").alias("n_a"), F.count_if(F.col("population") == "b").alias("n_b"), F.avg(F.when(F.col("label") == 0, (F.col("score") >= 0.4).cast("int"))).alias("f"))
    every = d.groupBy().agg(F.count_if(F.col("population") == "a").alias("ta"), F.count_if(F.col("population") == "b").alias("tb"))
    return out.crossJoin(F.broadcast(every)).select("proto", "n_a", "n_b", F.round(F.col("n_a") / F.col("ta"), 6).alias("share_a"), F.round(F.col("n_b") / F.col("tb"), 6).alias("share_b"), F.round("f", 6).alias("false_alert_rate"))


def fp_clusters(spark, sf_dir):
    d = flows_li(spark, sf_dir).where("label = 0").groupBy("proto", "dport", "dst").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.4).alias("fp"))
    total = d.agg(F.sum("fp").alias("total"))
    return d.crossJoin(F.broadcast(total)).select("proto", "dport", "dst", "n", "fp", (F.col("n") - F.col("fp")).alias("tn"), F.round(F.col("fp") / F.col("n"), 6).alias("fp_rate"), F.round(F.col("fp") / F.col("total"), 6).alias("share_of_fp"))


def miss_diagnosis(spark, sf_dir):
    """Within attacks of one category: detected against missed."""
    d = flows_li(spark, sf_dir).where("label = 1").withColumn("population", F.when(F.col("score") >= 0.5, "a").otherwise("b"))
    run = dr.running_counts(dr.long_form(d, FEATURES))
    out = dr.ks_of(run)
    for p, name in (("a", "detected"), ("b", "missed")):
        q = quantiles_of(run, ["feature"], "value", f"n{p}", [0.25, 0.5, 0.75])
        out = out.join(q.select("feature", *(F.round(F.get("q", F.lit(i)), 6).alias(f"q{x}_{name}") for i, x in enumerate((25, 50, 75)))), "feature", "left")
    return out.withColumn("ks", F.round("ks", 6))


def miss_categories(spark, sf_dir):
    """Attacks by the values of each column: detected, missed, miss rate, and the share of all misses."""
    d = flows_li(spark, sf_dir).where("label = 1").withColumn("missed", (F.col("score") < 0.5).cast("long"))
    columns = ["proto", "dst", "cat"]
    lf = d.select("missed", *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(["missed"], columns, "feature", "category")
    out = lf.groupBy("feature", "category").agg(F.count("*").alias("flows"), F.sum("missed").alias("missed"))
    share = F.try_divide("missed", F.sum("missed").over(Window.partitionBy("feature")))
    return out.select("feature", "category", "flows", (F.col("flows") - F.col("missed")).alias("detected"), "missed", F.round(F.col("missed") / F.col("flows"), 6).alias("miss_rate"), F.round(share, 6).alias("share_of_misses"))


def effect_sizes(spark, sf_dir):
    """Mean and median differences of the two classes, standardized by their pooled deviation."""
    d = dr.long_form(flows_li(spark, sf_dir).withColumn("population", F.when(F.col("label") == 1, "b").otherwise("a")), FEATURES)
    run = dr.running_counts(d)
    gap = F.col("mean_b") - F.col("mean_a")
    smd = F.try_divide(gap, F.sqrt((F.col("var_a") + F.col("var_b")) / 2))
    out = dr.moments(run).select("feature", F.round(gap, 4).alias("mean_difference"), F.round(smd, 6).alias("smd")).join(dr.drift_of(run), "feature")
    return out.select("feature", "mean_difference", F.round(F.col("median_b") - F.col("median_a"), 4).alias("median_difference"), "smd", F.round("ks", 6).alias("ks"))


def spearman(spark, sf_dir):
    d = dr.mean_ranks(flows_li(spark, sf_dir).select("cat", "packets", "score", "bytes"), ["cat"], ["packets", "score", "bytes"])
    return d.groupBy("cat").agg(F.round(F.corr("rank_packets", "rank_bytes"), 6).alias("packets_bytes"), F.round(F.corr("rank_packets", "rank_score"), 6).alias("packets_score"))


def share_map(spark, sf_dir):
    """Shares of each column's values as one ordered JSON object a column."""
    s = categorical(spark, sf_dir)
    pairs = F.array_sort(F.collect_list(F.struct("value", F.concat(F.lit('"'), F.col("value"), F.lit('":'), F.format_number(F.col("pa"), 6)).alias("said"))))
    return s.groupBy("feature").agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: x["said"]), ","), F.lit("}")).alias("shares"))


def period_drift(spark, sf_dir):
    """Two periods in one table: PSI of scores, of the features a model ranks first and of the evidence of
    incidents; JS of protocols and services."""
    d = periods(spark, sf_dir).withColumn("service", F.concat_ws("/", "proto", "dport"))
    found = inc.incidents(d, inc.Policy(0.4, 0.6, 30, ("src", "dst"))).withColumn("population", F.when(F.col("first_seen") < MIDDLE, "a").otherwise("b"))
    found = found.select("population", F.col("flows").alias("incident_flows"), F.col("max_score").alias("incident_max_score"), (F.col("last_seen") - F.col("first_seen")).alias("incident_duration"))
    numeric = dr.long_form(d, ["score", *TOP_FEATURES]).unionByName(dr.long_form(found, found.columns[1:]))
    n = dr.stability_index(dr.running_counts(numeric)).select("feature", F.round("psi", 6).alias("drift"), F.lit("psi").alias("measure"))
    c = dr.shares(dr.long_form(d, ["proto", "service"], kind="string"), ["feature"], "value").groupBy("feature").agg(F.round(dr.js(bits=True), 6).alias("drift")).withColumn("measure", F.lit("js_bits"))
    return n.unionByName(c)


def score_bin_drift(spark, sf_dir):
    """Twenty fixed bins of the score for each class: PSI, JS, TV, KS, and shifts of mean and median."""
    d = periods(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("score") * 20), F.lit(19)))
    both = dr.categorical_divergences(dr.shares(d, ["label"], "bin"), ["label"])
    shift = dr.numeric_drift(d.select("label", "population", F.col("score").alias("value")), ["label"])
    shift = shift.select("label", "ks", (F.col("mean_b") - F.col("mean_a")).alias("mean_shift"), (F.col("median_b") - F.col("median_a")).alias("median_shift"))
    out = both.join(shift, "label").withColumnRenamed("total_variation", "tv")
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("psi", "js", "tv", "ks", "mean_shift", "median_shift")))


QUERIES = {
    f.__name__: f
    for f in (
        ks_stat, psi_numeric, js_numeric, psi_simple, drift_categorical, js_bits, numeric_summary, unseen_levels, unseen_pairs, level_frequencies, unseen_sample, feature_drift, category_shift, group_compare, drift_5pop, category_profile, fp_clusters, miss_diagnosis, miss_categories,
        effect_sizes, spearman, share_map, period_drift, score_bin_drift,
    )
}


def ks_sql(source: str, by: str = "feature") -> str:
    return f"""kc as (select {by}, v, count(*) filter (pop = 'a') na, count(*) filter (pop = 'b') nb from {source} group by all),
     kr as (select {by}, abs(sum(na) over r / sum(na) over e - sum(nb) over r / sum(nb) over e) d from kc window r as (partition by {by} order by v), e as (partition by {by})), k as (select {by}, round(max(d), 6) ks from kr group by all)"""


def long_sql(pop: str, where: str = "true") -> str:
    return f"{LI}, lp as (select *, {pop} pop from li where {where}), lg as (" + " union all ".join(f"select pop, '{f}' feature, {f} v from lp" for f in FEATURES) + ")"


def bins_sql(source: str, by: str, plain: bool = False) -> str:
    """Deciles by ranks in whole numbers, then bins as a histogram with open ends has them."""
    two = "0" if plain else "(v >= ed[1] + (ed[2] - ed[1]) / 2)::int"
    return f"""rs as (select {by}, v, sum(case pop when 'a' then 1 else 0 end)::bigint n from {source} group by all), rr as (select {by}, v, (sum(n) over (partition by {by} order by v))::bigint upto, (sum(n) over (partition by {by}))::bigint total from rs),
     rk as (select distinct {by}, k, k * (total - 1) // 10 lo, k * (total - 1) % 10 part from rr, (select unnest(range(11)) k)),
     rv as (select {by}, k, part, min(v) filter (upto > lo) x, min(v) filter (upto > lo + 1) y from rk join rr using ({by}) group by {by}, k, part, lo),
     re as (select {by}, list_sort(list_distinct(list(case when part = 0 or x = y then x else x + (y - x) * (part / 10.0::double) end))) ed from rv group by {by}),
     bn as (select {by}, pop, len(ed) n_edges, case len(ed) when 1 then (sign(v - ed[1]) + 1)::int when 2 then {two} else len(list_filter(ed[2:-2], lambda x: x <= v)) end bin from {source} join re using ({by})),
     sh as (select {by}, n_edges, bin, count(*) filter (pop = 'a') na, count(*) filter (pop = 'b') nb from bn group by all),
     sp as (select *, na / sum(na) over (partition by {by})::double pa, nb / sum(nb) over (partition by {by})::double pb from sh)"""


SIMPLE = """round(case when any_value(n_edges) > 1 then sum((greatest(pb, 1e-6) - greatest(pa, 1e-6)) * ln(greatest(pb, 1e-6) / greatest(pa, 1e-6))) when sum(nb) filter (bin <> 1) > 0 then 'inf'::double else 0 end, 6)"""
PERIOD = f"case when t < {MIDDLE} then 'a' else 'b' end"
SQL = {
    "ks_stat": f"with {LONG}, {ks_sql('lg')} select feature, ks from k",
    "psi_numeric": f"with {LONG}, {bins_sql('lg', 'feature')}, {clip_sql()} select feature, {PSI} psi from c2 group by all",
    "js_numeric": f"with {LONG}, {bins_sql('lg', 'feature')}, {clip_sql()} select feature, {JS} js from c2 group by all",
    "psi_simple": f"with {LONG}, {bins_sql('lg', 'feature', True)} select feature, {SIMPLE} psi from sp group by all",
    "drift_categorical": f"with {CAT}, tv as (select feature, round(sum(abs(pa - pb)) / 2, 6) total_variation from cp group by all), {clip_sql('cp')} select feature, {PSI} psi, {JS} js, any_value(total_variation) total_variation from c2 join tv using (feature) group by feature",
    "js_bits": f"with {CAT} select feature, {JS.replace('ln(', 'log2(')} js_bits from cp group by all",
    "numeric_summary": f"with {LONG} select feature, pop population, count(*) n, round(avg(v), 4) mean, round(median(v), 6) median, round(quantile_cont(v, 0.9), 6) p90, round(quantile_cont(v, 0.99), 6) p99 from lg where isfinite(v) group by all",
    "unseen_levels": f"""with {LI}, d as (select src || '-' || okey lv, t, src from li), n as (select distinct lv, src from d where t >= {MIDDLE} and lv not in (select lv from d where t < {MIDDLE}))
        select src::varchar src, count(*) n_unseen, min(lv) example from n group by all""",
    "level_frequencies": f"""with {LI}, d as (select case when t < {MIDDLE} then 'a' else 'b' end population, proto::varchar proto, proto || '/' || sport service from li), c as (select feature, population, "value", count(*) n from (unpivot d on proto, service into name feature value "value") group by all),
        r as (select *, round(n / sum(n) over (partition by feature, population)::double, 6) share, row_number() over (partition by feature, population order by n desc, "value")::int rank from c) select * from r where rank <= 20""",
    "unseen_sample": f"""with {LI}, d as (select t >= {MIDDLE} late, proto::varchar proto, src || '/' || pkey service from li), c as (select feature, v, bool_and(late) fresh from (unpivot d on proto, service into name feature value v) group by all),
        f as (select feature, v, row_number() over (partition by feature order by v) r from c where fresh) select feature, count(*) filter (fresh) n_unseen, coalesce(any_value(s), '') sample from c left join (select feature, string_agg(v, ',' order by v) s from f where r <= 100 group by all) using (feature) group by feature""",
    "miss_categories": f"""with {LI}, d as (select proto::varchar proto, dst::varchar dst, cat, (score < 0.5)::int miss from li where "label" = 1), c as (select feature, category, count(*) flows, sum(miss)::bigint missed from (unpivot d on proto, dst, cat into name feature value category) group by all)
        select feature, category, flows, flows - missed detected, missed, round(missed / flows::double, 6) miss_rate, round(missed / nullif(sum(missed) over (partition by feature), 0)::double, 6) share_of_misses from c""",
    "unseen_pairs": f"""with {LI}, d as (select src || '-' || pkey lv, t, src from li), n as (select distinct lv, src from d where t >= {MIDDLE} and lv not in (select lv from d where t < {MIDDLE}))
        select src::varchar src, count(*) n_unseen, min(lv) example from n group by all""",
    "feature_drift": f"""with {long_sql(PERIOD)}, sc as (select pop, 'all|' || feature fs, v from lg union all select pop, 'normal|' || feature, v from (select pop, unnest(['bytes', 'packets', 'score']) feature, unnest([bytes, packets, score]) v from lp where "label" = 0)),
        {ks_sql('sc', 'fs')}, {bins_sql('sc', 'fs')}, {clip_sql(by='fs')}, p as (select fs, {PSI} psi from c2 group by all),
        m as (select fs, round(avg(v) filter (pop = 'a'), 4) mean_a, round(median(v) filter (pop = 'a'), 4) median_a, round(avg(v) filter (pop = 'b'), 4) mean_b, round(median(v) filter (pop = 'b'), 4) median_b from sc group by all),
        tx as (select pop, unnest(['all|proto', 'all|dst']) fs, unnest([proto::varchar, dst::varchar]) v from lp union all select pop, unnest(['normal|proto', 'normal|dst']), unnest([proto::varchar, dst::varchar]) from lp where "label" = 0),
        tc as (select fs, v, count(*) filter (pop = 'a') na, count(*) filter (pop = 'b') nb from tx group by all), ts as (select fs, na / sum(na) over (partition by fs)::double pa, nb / sum(nb) over (partition by fs)::double pb, na, nb from tc),
        tq as (select fs, round(sum(abs(pa - pb)) / 2, 6) distance from ts group by all), t1 as (select fs, greatest(na, 1e-10) na, greatest(nb, 1e-10) nb from ts), t2 as (select fs, na / sum(na) over (partition by fs) pa, nb / sum(nb) over (partition by fs) pb from t1),
        u as (select fs, 'numeric' kind, mean_a, median_a, mean_b, median_b, ks distance, psi, null::double js from m join k using (fs) join p using (fs)
         union all select fs, 'categorical', null, null, null, null, any_value(distance), {PSI}, {JS} from t2 join tq using (fs) group by fs)
        select split_part(fs, '|', 1) "scope", split_part(fs, '|', 2) feature, kind, mean_a, median_a, mean_b, median_b, distance, psi, js, max(distance) over (partition by split_part(fs, '|', 2)) drift_score from u""",
    "category_shift": f"with {CAT} select feature, v category, na, nb, round(pa, 6) share_a, round(pb, 6) share_b, round(pb - pa, 6) change, na = 0 unseen from cp",
    "group_compare": f"""with {long_sql("case when score >= 0.4 then 'a' else 'b' end", '"label" = 0')}, {ks_sql('lg')}, m as (select feature, round(median(v) filter (pop = 'a'), 4) median_fp, round(median(v) filter (pop = 'b'), 4) median_tn from lg group by all)
        select * from m join k using (feature)""",
    "drift_5pop": f"""with {long_sql('''unnest(['all', case when "label" = 1 then case when score >= 0.4 then 'detected' else 'missed' end when score >= 0.4 then 'false_positive' else 'true_negative' end])''')}
        select feature, pop population, count(*) n, {', '.join(f'round(quantile_cont(v, {int(q) / 100}), 6) q{q}' for q in ('05', '25', '50', '75', '95'))} from lg group by all""",
    "category_profile": f"""with {LI}, c as (select proto, count(*) filter (t < {MIDDLE}) n_a, count(*) filter (t >= {MIDDLE}) n_b, avg((score >= 0.4)::int) filter ("label" = 0) f from li group by all)
        select proto, n_a, n_b, round(n_a / sum(n_a) over ()::double, 6) share_a, round(n_b / sum(n_b) over ()::double, 6) share_b, round(f, 6) false_alert_rate from c""",
    "fp_clusters": f"""with {LI}, c as (select proto, dport, dst, count(*) n, count(*) filter (score >= 0.4) fp from li where "label" = 0 group by all)
        select *, n - fp tn, round(fp / n::double, 6) fp_rate, round(fp / sum(fp) over ()::double, 6) share_of_fp from c""",
    "miss_diagnosis": f"""with {long_sql("case when score >= 0.5 then 'a' else 'b' end", '"label" = 1')}, {ks_sql('lg')}, m as (select feature, {', '.join(f"round(quantile_cont(v, {x / 100}) filter (pop = '{p}'), 6) q{x}_{w}" for p, w in (('a', 'detected'), ('b', 'missed')) for x in (25, 50, 75))} from lg group by all)
        select * from m join k using (feature)""",
    "effect_sizes": f"""with {long_sql('''case when "label" = 1 then 'b' else 'a' end''')}, {ks_sql('lg')}, m as (select feature, round(avg(v) filter (pop = 'b') - avg(v) filter (pop = 'a'), 4) mean_difference,
        round(median(v) filter (pop = 'b') - median(v) filter (pop = 'a'), 4) median_difference, round((avg(v) filter (pop = 'b') - avg(v) filter (pop = 'a')) / sqrt((var_samp(v) filter (pop = 'a') + var_samp(v) filter (pop = 'b')) / 2), 6) smd from lg group by all)
        select * from m join k using (feature)""",
    "spearman": f"""with {LI}, r as (select cat, {', '.join(f'rank() over (partition by cat order by {c}) + (count(*) over (partition by cat, {c}) - 1) / 2 r_{c}' for c in ('packets', 'bytes', 'score'))} from li)
        select cat, round(corr(r_packets, r_bytes), 6) packets_bytes, round(corr(r_packets, r_score), 6) packets_score from r group by all""",
    "share_map": f"""with {CAT} select feature, '{{' || string_agg('"' || v || '":' || printf('%.6f', pa), ',' order by v) || '}}' shares from cp group by all""",
    "period_drift": f"""with {LI}, lp as (select *, {PERIOD} pop from li), al as (select src, dst, t, score, case when t - lag(t) over (partition by src, dst order by t) <= 30 then 0 else 1 end fresh from li where score >= 0.4),
        se as (select *, sum(fresh) over (partition by src, dst order by t) s from al), ic as (select case when min(t) < {MIDDLE} then 'a' else 'b' end pop, count(*)::double flows, max(score) top, (max(t) - min(t))::double took from se group by src, dst, s),
        lg as (select pop, unnest(['score', 'bytes', 'packets', 'score_b']) feature, unnest([score, bytes, packets, score_b]) v from lp union all select pop, unnest(['incident_flows', 'incident_max_score', 'incident_duration']), unnest([flows, top, took]) from ic),
        {bins_sql('lg', 'feature', True)}, ct as (select pop, 'proto' feature, proto::varchar v from lp union all select pop, 'service', proto || '/' || dport from lp),
        cs as (select feature, v, count(*) filter (pop = 'a') na, count(*) filter (pop = 'b') nb from ct group by all), cp as (select *, na / sum(na) over (partition by feature)::double pa, nb / sum(nb) over (partition by feature)::double pb from cs)
        select feature, {SIMPLE} drift, 'psi' measure from sp group by feature union all select feature, {JS.replace('ln(', 'log2(')}, 'js_bits' from cp group by feature""",
    "score_bin_drift": f"""with {LI}, lp as (select *, {PERIOD} pop, score v from li), sh as (select "label", least(floor(score * 20), 19) bin, count(*) filter (pop = 'a') na, count(*) filter (pop = 'b') nb from lp group by all),
        sp as (select *, na / sum(na) over (partition by "label")::double pa, nb / sum(nb) over (partition by "label")::double pb from sh), tv as (select "label", round(sum(abs(pa - pb)) / 2, 6) tv from sp group by all), {clip_sql(by='"label"')}, {ks_sql('lp', '"label"')},
        p as (select "label", {PSI} psi, {JS} js from c2 group by all), m as (select "label", round(avg(score) filter (pop = 'b') - avg(score) filter (pop = 'a'), 6) mean_shift, round(median(score) filter (pop = 'b') - median(score) filter (pop = 'a'), 6) median_shift from lp group by all)
        select * from p join tv using ("label") join k using ("label") join m using ("label")""",
}
