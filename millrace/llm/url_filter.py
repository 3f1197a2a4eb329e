"""Operator 1 [native], URL filters: rules by host and path, and link-graph propagation where no rule fits.

Trust flows along links from trusted hosts and distrust flows against them from blocked hosts, each as a personalised
PageRank over host edges; a host whose distrust outweighs its trust is blocked. DataFrame operations only.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, read

#: (rule, verdict); a rule is a host, a slash and the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING, TOLERANCE = 0.85, 1e-6
#: A host is blocked if distrust makes up more than this share of its trust and distrust.
DISTRUST = 0.5


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/?[^?#]*)", 1)


def rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (of equals, the first), as a struct ``rule, verdict``; null if none does."""
    out = F.lit(None)
    for text, verdict in sorted(rules, key=lambda r: len(r[0])) if rules else []:
        rh, rp = text.split("/", 1)
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(f"/{rp}")
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def links(pages: DataFrame) -> DataFrame:
    """Host edges ``a, b, n`` of absolute links between different hosts; summed in each task before anything moves."""
    targets = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), 1))
    found = pages.where(F.contains("html", F.lit("//"))).select(host(F.col("url")).alias("a"), targets.alias("u"))
    found = found.select("a", host(F.when(F.col("u").startswith("//"), F.concat(F.lit("http:"), "u")).otherwise(F.col("u"))).alias("b"))
    return found.where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank ``h, score`` of ``edges(a, b, w)``, where w sums to 1 over each a, from ``seeds(h, s)``
    of total 1. A host without edges out gives its score to no one. What moves shrinks by ``damping`` every round, so
    that the rounds that bring it below ``tolerance`` are bounded; if they don't, it raises. Ranks are checkpointed
    every round; the driver sees one number a round."""
    base = seeds.select("h", (F.col("s") * (1 - damping)).alias("score"))
    rank = cut(base)
    for _ in range(ceil(log(tolerance) / log(damping)) + 2):
        sent = rank.join(edges, rank["h"] == edges["a"]).groupBy("b").agg(F.sum(F.col("score") * F.col("w") * damping).alias("score"))
        new = cut(base.unionByName(sent.select(F.col("b").alias("h"), "score")).groupBy("h").agg(F.sum("score").alias("score")))
        moved = new.select("h", "score").unionByName(rank.select("h", (-F.col("score")).alias("score"))).groupBy("h").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).first()[0]
        rank = new
        if not moved or moved < tolerance:
            return rank
    raise RuntimeError(f"ranks still move by {moved}")


def host_scores(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``h, trust, distrust`` of every host that either reaches. Blocked seeds are the hosts that a rule blocks whole;
    trusted seeds are the other hosts with urls that a rule allows. Seeds weigh as the pages they have."""
    h, p = host(F.col("url")), path(F.col("url"))
    whole = rule(h, F.lit("/"), rules)["verdict"] == "block"
    seen = pages.select(h.alias("h"), F.coalesce(whole, F.lit(False)).alias("bad"), F.coalesce(rule(h, p, rules)["verdict"] == "allow", F.lit(False)).alias("good")).where("h <> ''")
    per = cut(seen.groupBy("h", "bad").agg(F.count("*").alias("n"), F.count_if("good").alias("g")))

    def seeds(of: DataFrame, weight: str) -> DataFrame:
        total = of.agg(F.sum(weight)).first()[0]
        return of.select("h", (F.col(weight) / (total or 1)).alias("s"))

    # edges of a host are many but host pairs are summed already; only their weights need the host's total
    raw = cut(links(pages))
    out = raw.groupBy("a").agg(F.sum("n").alias("t"))
    back = raw.groupBy("b").agg(F.sum("n").alias("t"))
    ahead = cut(raw.join(out, "a").select("a", "b", (F.col("n") / F.col("t")).alias("w")))
    behind = cut(raw.join(back, "b").select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") / F.col("t")).alias("w")))
    trust = pagerank(ahead, seeds(per.where("not bad and g > 0"), "g")).withColumnRenamed("score", "trust")
    distrust = pagerank(behind, seeds(per.where("bad"), "n")).withColumnRenamed("score", "distrust")
    return trust.join(distrust, "h", "full").na.fill(0.0)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, distrust: float = DISTRUST) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: ``page_id, host, path, rule, verdict, trust, distrust``.

    A url that a rule fits has the rule's verdict. Else its host is blocked if distrust / (trust + distrust) is over
    the threshold, and allowed otherwise, so a host that neither seed reaches is allowed. Null urls and urls without
    ``://`` have an empty host and path, no scores, and are allowed; null html has no links; repeated rows are judged
    each; an empty table gives no rows; other columns are ignored."""
    rules = RULES if rules is None else rules
    pages = pages.select("page_id", "url", "html")
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    scores = host_scores(pages, rules).select(F.col("h").alias("host"), "trust", "distrust")
    got = urls.join(scores, "host", "left").withColumn("_r", rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("distrust") > distrust * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return got.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
