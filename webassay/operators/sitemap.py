"""Sitemaps as tables, and the order in which a crawl admits addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webassay.functions import urls as U

MAX_FILES, MAX_DEPTH = 50, 3


def kind(body: Column) -> Column:
    """urlset, sitemapindex, text or unknown, by the root's local name."""
    text = F.trim(F.coalesce(body, F.lit("")))
    root = F.lower(F.regexp_extract(F.regexp_replace(text, r"(?s)^(?:\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>))*\s*", ""), r"^<(?:[\w-]+:)?([\w-]+)", 1))
    return F.when(root.isin("urlset", "sitemapindex"), root).when(~text.startswith("<") & text.rlike(r"(?im)^\s*https?://"), "text").otherwise("unknown")


def _tag(block: Column, name: str) -> Column:
    from webassay.functions.html import unescape

    return F.trim(unescape(F.regexp_replace(F.regexp_extract(block, rf"(?is)<(?:[\w-]+:)?{name}\b[^>]*>(.*?)</(?:[\w-]+:)?{name}\s*>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


def entries(files: DataFrame) -> DataFrame:
    """(source, pos, loc, lastmod, changefreq, priority) of (url, body)."""
    typed = files.select(F.col("url").alias("source"), F.trim("body").alias("body"), kind(F.col("body")).alias("kind"))
    xml = typed.where("kind = 'urlset'").select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:[\w-]+:)?url\b[^>]*>.*?</(?:[\w-]+:)?url\s*>"), F.lit(0))).alias("pos", "b"))
    rows = xml.select("source", "pos", *[_tag(F.col("b"), n).alias(n) for n in ("loc", "lastmod", "changefreq", "priority")]).where("loc <> ''")
    plain = typed.where("kind = 'text'").select("source", F.posexplode(F.filter(F.transform(F.split("body", "\r\n|\n|\r"), F.trim), lambda x: x.rlike("(?i)^https?://"))).alias("pos", "loc"))
    return rows.unionByName(plain.select("source", "pos", "loc", *[F.lit("").alias(n) for n in ("lastmod", "changefreq", "priority")]))


def children(files: DataFrame) -> DataFrame:
    """(source, loc) of the files that index files name."""
    index = files.where(kind(F.col("body")) == "sitemapindex").select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:[\w-]+:)?sitemap\b[^>]*>.*?</(?:[\w-]+:)?sitemap\s*>"), F.lit(0))).alias("b"))
    return index.select("source", _tag(F.col("b"), "loc").alias("loc")).where("loc <> ''")


def load(seeds: DataFrame, landed: DataFrame, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Files reached from ``seeds`` (url) within the landed files (url, status, error, body): url, depth, fetched, reason, truncated.

    Index files are expanded level by level; each file counts once.
    """
    level = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    reached = level
    for d in range(max_depth):
        found = children(level.select("url").join(landed, "url")).select(F.col("loc").alias("url")).distinct().join(reached.select("url"), "url", "left_anti")
        level = found.withColumn("depth", F.lit(d + 1))
        reached = reached.unionByName(level)
    joined = reached.join(landed, "url", "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("status").isNull(), "not fetched").when(F.col("status") >= 300, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty body").when(kind(F.col("body")) == "unknown", "not a sitemap").otherwise("")
    ranked = joined.select("url", "depth", reason.alias("reason"), ((F.col("depth") == max_depth) & (kind(F.col("body")) == "sitemapindex")).alias("deeper"))
    if not max_files:
        return ranked.select("url", "depth", (F.col("reason") == "").alias("fetched"), "reason", F.col("deeper").alias("truncated"))
    first = ranked.orderBy("depth", "url").limit(max_files).select("url", F.lit(True).alias("first"))
    limited = ranked.join(F.broadcast(first), "url", "left").withColumn("over", F.col("first").isNull())
    return limited.select("url", "depth", ((F.col("reason") == "") & ~F.col("over")).alias("fetched"), F.when(F.col("over"), "over the limit of files").otherwise(F.col("reason")).alias("reason"), (F.col("deeper") | F.col("over")).alias("truncated"))


def admit(candidates: DataFrame, seen: DataFrame, target: str, max_depth: int, budget: int, **scope) -> DataFrame:
    """One round of the frontier: (url, norm, depth, reason), reason empty where admitted.

    Checks in order: seen, depth, scope, budget. Of equal addresses in a round
    the shallowest counts. The budget is filled in the order of depth, then
    address; only what passes the checks before is ranked.
    """
    norm = candidates.withColumn("norm", U.normalize(F.col("url")))
    first = norm.groupBy("norm").agg(F.min(F.struct("depth", "url")).alias("x")).select("norm", "x.*")
    known = first.join(seen.select("norm").distinct().withColumn("known", F.lit(True)), "norm", "left")
    why = F.when(F.col("known"), "seen").when(F.col("depth") > max_depth, "too deep").otherwise(U.reason_to_skip(F.col("norm"), target, **scope))
    judged = known.select("url", "norm", "depth", why.alias("reason"))
    open_ = judged.where("reason = ''").orderBy("depth", "norm").limit(budget).select("norm").withColumn("in", F.lit(True))
    return judged.join(open_, "norm", "left").select("url", "norm", "depth", F.when((F.col("reason") == "") & F.col("in").isNull(), "over budget").otherwise(F.col("reason")).alias("reason"))


def seeding(entries_: DataFrame, budget: int, share: int = 4) -> DataFrame:
    """Entries with ``now``: whether they are among the first quarter of the budget, or wait until links run out."""
    w = W.partitionBy("source").orderBy("pos")
    return entries_.withColumn("now", F.row_number().over(w) <= max(1, budget // share))
