"""URL filters: host and path rules, and for the rest trust spread over the link graph.

A rule names a host and a path prefix; it fits the host and its subdomains, and the longest wins.
Pages that no rule fits are judged by their host.  Hosts with a page that a rule allows, and none
that a rule blocks, are trusted seeds; hosts of whose pages rules block more than half are blocked
seeds.  Trust is a personalised PageRank from the trusted seeds along links (host edges, weighted
by distinct linking pages); distrust is one from the blocked seeds along the reversed links: who
links to blocked hosts is suspect.  Both are scaled by the number of hosts, so 1 is what a host
would get evenly; a host is blocked if its distrust is at least ``threshold`` and above its trust.

All steps are joins and sums over the host graph, a page's html is read once for its links (with a scheme or
from ``//``), and each round is written to the shared folder.  Self links are left out.  Rounds end when no host's scaled
rank changes by ``tolerance``; a walk that has not settled after ``rounds`` is an error.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and is
allowed; null html has no links; repeated rows each get a verdict (and count as pages each); an empty table gives no rows;
columns of the pages that are named like a result are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, restored

NEW = ("host", "path", "rule", "verdict")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Index of the longest rule that fits, or null.  ``rules``: (allow or block, host/path)."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: -len(rules[i][1])):
        name, slash, rest = rules[i][1].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out if out is not None else F.lit(None).cast("int")


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links from one host's pages to another's; needs a column ``host``."""
    pattern = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
    found = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html_col, F.lit(pattern), 1), lambda h: F.translate(h, UPPER, LOWER)))).alias("dst"))
    return found.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 0.01, n: int | None = None) -> DataFrame:
    """(host, rank) with restarts at ``seeds`` (host, share); rank without a way on restarts as well.  ``n``: hosts."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = materialize(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "url-flow")
    rank = seeds.select("host", F.col("share").alias("rank"))
    if flow.isEmpty() or seeds.isEmpty():  # nowhere to go: every walk restarts at once
        return rank
    n = n or flow.select(F.explode(F.array("src", "dst"))).distinct().count()
    none = F.lit(0.0)
    for _ in range(rounds):
        moved = materialize(rank.join(flow, rank["host"] == flow["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * flow["share"])).alias("rank")), "url-moved")
        lost = 1.0 - moved.agg(F.coalesce(F.sum("rank"), none)).first()[0]
        again = seeds.select("host", (F.col("share") * lost).alias("rank"))
        both = moved.unionByName(again).withColumn("old", none).unionByName(rank.select("host", none.alias("rank"), F.col("rank").alias("old")))
        now = materialize(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.abs(F.sum("rank") - F.sum("old")).alias("change")), "url-rank")
        rank = now.select("host", "rank").where("rank > 0")
        if n * (now.agg(F.max("change")).first()[0] or 0.0) < tolerance:
            return rank
    raise RuntimeError("ranks have not settled")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", threshold: float = 1.0) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    work, column, kept = numbered(pages, NEW)
    host, path = host_and_path(F.col(column(url_col)).cast("string"))
    rule = F.array(*(F.lit(r[1]) for r in rules)) if rules else F.array().cast("array<string>")
    says = F.array(*(F.lit(r[0]) for r in rules)) if rules else F.array().cast("array<string>")
    judged = work.withColumns({"host": host, "path": path})
    judged = judged.withColumn("i", longest_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.get(rule, F.col("i")), "says": F.get(says, F.col("i"))})
    edges = materialize(host_links(judged, column(html_col)), "url-edges")
    counts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("says") == "allow").alias("allowed"), F.count_if(F.col("says") == "block").alias("blocked"))
    linked = edges.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"))
    hosts = materialize(counts.unionByName(linked).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "allowed", "blocked"))), "url-hosts")
    n, n_good, n_bad = hosts.agg(F.count("*"), F.count_if(F.expr("allowed > 0 and blocked = 0")), F.count_if(F.expr("2 * blocked > n"))).first()
    good = hosts.where("allowed > 0 and blocked = 0").select("host", F.lit(1.0 / max(1, n_good)).alias("share"))
    bad = hosts.where("2 * blocked > n").select("host", F.lit(1.0 / max(1, n_bad)).alias("share"))
    trust = personalised_pagerank(edges, good, n=n).withColumnRenamed("rank", "trust")
    distrust = personalised_pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), bad, n=n).withColumnRenamed("rank", "distrust")
    scores = hosts.join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce(F.col("trust") * n, F.lit(0.0)).alias("trust"), F.coalesce(F.col("distrust") * n, F.lit(0.0)).alias("distrust"))
    scores = scores.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")))
    out = judged.join(scores, "host", "left").withColumn("verdict", F.coalesce("says", F.when(F.col("distrust").isNotNull(), "block").otherwise("allow")))
    return restored(out, kept, NEW)
