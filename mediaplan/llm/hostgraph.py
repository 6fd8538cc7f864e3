"""URL filters by propagation over the link graph of hosts.

Rules decide the urls they fit. For the rest, trust flows from hosts whose pages the rules allow along links
(personalised PageRank), and distrust from hosts whose pages the rules block against them, each host being a
seed to the share of its pages that are decided so: who
links to a blocked host is suspect. A host with more distrust than trust, beyond a threshold, is
blocked. All of it is DataFrame work: pages are reduced to hosts and host pairs by partial sums
before they move, and a host with a large part of all pages is met in salted joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mediaplan.functions.skew import join_hot
from mediaplan.sources.tables import keep

DAMPING = 0.85
#: Distrust below this share of an even spread is noise.
LEAST = 0.1
#: Rounds stop when all further ones together hold less than this share of the least distrust that counts.
PRECISION = 0.01
#: Stored rounds that are summed into one table.
FLOWS = 20

# fixed values: (rule, verdict); a rule is a host and the start of a path
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_hosts(html: str = "html") -> Column:
    """Hosts of the absolute links of a page, with or without a scheme."""
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LINK), 1),
                       lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit(":"), u)).otherwise(u)))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and, longest first, the rules that fit it: its own and those of the domains above it."""
    label = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    split = rules.select(F.substring_index("rule", "/", 1).alias("domain"), "rule", "verdict",
                         F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"))
    fit = hosts.select("host", F.explode(above).alias("domain")).join(split, "domain")
    return fit.groupBy("host").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("rule").alias("n"), "start", "rule", "verdict")))).alias("rules"))


def graph_size(edges: DataFrame, seeds: DataFrame) -> int:
    """Hosts that have links or are seeds."""
    return edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct().count()


def spread_scores(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """Personalised PageRank: (host, score) over ``edges`` (src, dst, weight) from ``seeds`` (host, weight).

    What a host without links holds goes back to the seeds. So scores are, up to their sum, the seeds plus
    what flows from them over one link, two links and so on; a round adds one link. Rounds go on until all
    further ones together hold less than ``tolerance`` (by default of the size of the graph), or for ``rounds`` if a
    caller wants no more. Every round is stored, so no plan grows and a lost executor costs a round."""
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    flow = keep(seeds.filter("weight > 0").select("host", (F.col("weight") / F.lit(float(total))).alias("score")), "seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = keep(join_hot(edges, out, ["src"], "dst").select(F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all")).alias("share")), "shares")
    tolerance = tolerance or PRECISION * LEAST / graph_size(edges, seeds)
    after = damping / (1 - damping)  # further rounds hold this many times the last at most
    enough = 2 + math.ceil(math.log(tolerance / after) / math.log(damping))
    flows, rest = [flow], after
    for _ in range(enough if rounds is None else rounds):
        moved = join_hot(shares, flow, ["host"], "dst")
        flow = keep(moved.groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score")), "flow")
        flows.append(flow)
        rest = after * (flow.agg(F.sum("score")).first()[0] or 0.0)
        if rest < tolerance:
            break
        if len(flows) == FLOWS:
            flows = [keep(_summed(flows), "scores")]
    if rounds is None and rest >= tolerance:
        raise ArithmeticError(f"further rounds still hold {rest} after {enough}")
    scores = keep(_summed(flows), "scores")
    return scores.select("host", (F.col("score") / F.lit(scores.agg(F.sum("score")).first()[0])).alias("score"))


def _summed(flows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, flows).groupBy("host").agg(F.sum("score").alias("score"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, rounds: int | None = None, least: float = LEAST) -> DataFrame:
    """A row for each page (page_id, url, html): page_id, host, path, rule, verdict, trust and distrust of the host.

    Null urls and urls without ``://`` have an empty host and path; a host that neither rules nor
    links reach is allowed; equal trust and distrust allow; null html has no links; repeated pages are judged
    one by one (and count as often as seeds); other columns are ignored."""
    spark = pages.sparkSession
    if rules is None:
        pairs = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
        rules = spark.sql(f"SELECT * FROM VALUES {pairs} AS t(rule, verdict)")
    # of a page, only the hosts it links to are kept
    seen = keep(pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.array_distinct(link_hosts()).alias("links")), "page-hosts")
    hosts = keep(seen.select("host").distinct(), "hosts")
    fitting = keep(rules_of_hosts(hosts, rules), "host-rules")
    ruled = join_hot(seen.drop("links"), fitting, ["host"], "page_id", how="left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    ruled = keep(ruled.withColumn("best", F.try_element_at(fits, F.lit(1)))
                 .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("by_rule")), "ruled")
    counts = keep(ruled.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"),
                                            F.count_if(F.col("by_rule") == "block").alias("bad")), "host-counts")
    edges = keep(seen.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
                 .filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), "host-links")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    named = counts.filter("host <> ''")
    # a host is a seed to the share of its pages that the rules decide so
    good, bad = (named.filter(f"{c} > 0").select("host", (F.col(c) / F.col("n")).alias("weight")) for c in ("good", "bad"))
    share = least / max(1, graph_size(edges, good.union(bad)))
    trust, distrust = (spread_scores(e, s, rounds, tolerance=PRECISION * share) for e, s in ((edges, good), (back, bad)))
    scores = keep(trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full"), "host-scores")
    scores = scores.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    judged = join_hot(ruled, scores, ["host"], "page_id", how="left")
    suspect = (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))) & (F.coalesce("distrust", F.lit(0.0)) >= share)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(suspect, "block").otherwise("allow")).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
