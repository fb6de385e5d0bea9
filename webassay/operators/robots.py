"""robots.txt as tables: groups, rules, sitemaps, and who may fetch what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webassay.functions import urls as U

#: Crawler tokens by what they fetch for.
SEARCH = ("googlebot", "bingbot", "applebot", "duckduckbot", "qwantbot", "qwantify", "yandex", "baiduspider", "slurp")
ANSWERS = ("oai-searchbot", "chatgpt-user", "claude-searchbot", "claude-user", "perplexitybot", "perplexity-user")
TRAINING = ("gptbot", "google-extended", "claudebot", "applebot-extended", "ccbot", "bytespider")


def lines(files: DataFrame) -> DataFrame:
    """(host, pos, field, value) of the meaningful lines of (host, body)."""
    rows = files.select("host", F.posexplode(F.split("body", "\r\n|\n|\r")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    return rows.where(F.col("line").contains(":")).select("host", "pos", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def grouped(files: DataFrame) -> DataFrame:
    """Lines with the number of their group: a user-agent line after any other field than sitemap begins a new one."""
    w = W.partitionBy("host").orderBy("pos")
    marked = lines(files).where("field <> 'sitemap'").withColumn("agent", F.col("field") == "user-agent")
    starts = marked.withColumn("start", F.col("agent") & ~F.coalesce(F.lag("agent").over(w), F.lit(False)))
    return starts.withColumn("group", F.sum(F.col("start").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("group") > 0)


def agents(files: DataFrame) -> DataFrame:
    return grouped(files).where("agent").select("host", "group", F.lower("value").alias("agent"))


def rules(files: DataFrame) -> DataFrame:
    """(host, group, allow, path, pattern, specificity); empty paths rule nothing."""
    kept = grouped(files).where("field in ('allow', 'disallow') and value <> ''")
    return kept.select("host", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), pattern(F.col("value")).alias("pattern"), F.length("value").alias("specificity"))


def pattern(path: Column) -> Column:
    """Regular expression of a rule's path: * is any run, a trailing $ the end."""
    end, body = path.endswith("$"), F.regexp_replace(path, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|\-])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(end, "$").otherwise(""))


def sitemaps(files: DataFrame) -> DataFrame:
    return lines(files).where("field = 'sitemap' and value <> ''").select("host", F.col("value").alias("sitemap"))


def delays(files: DataFrame) -> DataFrame:
    """(host, group, delay): the last readable value, not below zero."""
    read = grouped(files).where("field = 'crawl-delay'").withColumn("delay", F.col("value").try_cast("double")).where("delay is not null")
    return read.groupBy("host", "group").agg(F.greatest(F.lit(0.0), F.max_by("delay", "pos")).alias("delay"))


def group_for(files: DataFrame, crawlers: DataFrame) -> DataFrame:
    """(host, crawler, group): the longest declared token that begins or is in the crawler's name, else the first * group."""
    declared = agents(files)
    pairs = crawlers.select("crawler").join(declared, F.expr("agent = '*' or instr(lower(crawler), agent) > 0"))
    best = F.max_by("group", F.when(F.col("agent") == "*", F.struct(F.lit(-1).alias("l"), (-F.col("group")).alias("g"))).otherwise(F.struct(F.length("agent").alias("l"), (-F.col("group")).alias("g"))))
    return pairs.groupBy("host", "crawler").agg(best.alias("group"))


def allowed(files: DataFrame, crawlers: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, crawler, allowed) of urls x crawlers: the longest matching rule decides, allow wins a tie, no match allows.

    Rules meet addresses by host, then by pattern; a host's rules are few.
    """
    targets = urls.select("url", U.host(F.col("url")).alias("host"), F.concat(F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url"))), F.when(U.query(F.col("url")) != "", F.concat(F.lit("?"), U.query(F.col("url")))).otherwise("")).alias("target")).distinct()
    chosen = group_for(files, crawlers).join(rules(files), ["host", "group"]).select("host", "crawler", "allow", "pattern", "specificity")
    hits = targets.join(chosen, "host").where("target rlike pattern").groupBy("url", "crawler").agg(F.max_by("allow", F.struct("specificity", "allow")).alias("allow"))
    every = targets.select("url").join(F.broadcast(crawlers.select("crawler")), F.lit(True))
    return every.join(hits, ["url", "crawler"], "left").select("url", "crawler", F.coalesce("allow", F.lit(True)).alias("allowed"))


def load_policy(status: Column, body: Column, error: Column) -> Column:
    """4xx: no rules; other failures: an error and no rules; else the body."""
    return F.when(error.isNotNull() | (status >= 500), F.struct(F.lit(False).alias("fetched"), F.coalesce(error, F.concat(F.lit("HTTP "), status.cast("string"))).alias("error"), F.lit("").alias("body"))).when(status >= 400, F.struct(F.lit(False).alias("fetched"), F.lit("").alias("error"), F.lit("").alias("body"))).otherwise(F.struct(F.lit(True).alias("fetched"), F.lit("").alias("error"), F.coalesce(body, F.lit("")).alias("body")))
