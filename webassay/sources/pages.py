"""Page records: landed tables, the fields that HTTP answers give, and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.functions import urls as U

#: What may be cached, for how long, and how large.
CACHEABLE = (200, 203, 301, 308, 404, 410)
MAX_CACHED = 2_000_000
#: Statuses with which challenges are answered.
CHALLENGES = (200, 202, 401, 403, 405, 429, 503)
#: Signs of a page that answers crawlers with a challenge.
BLOCK_HEADERS = {"cf-mitigated": "challenge", "x-datadome": "", "x-px-block": ""}
BLOCK_TEXTS = ("just a moment...", "attention required! | cloudflare", "access denied", "verify you are human", "px-captcha", "/cdn-cgi/challenge-platform/", "datadome")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


#: Fetch fields that the test tables lack, as SQL that Spark and DuckDB both read.
DERIVED = {
    "status": "CASE WHEN page_id % 23 = 0 THEN 404 WHEN page_id % 37 = 0 THEN 500 ELSE 200 END",
    "ttfb_ms": "CAST((page_id * 37) % 2500 AS DOUBLE)",
    "content_encoding": "CASE WHEN page_id % 3 = 0 THEN '' ELSE 'br' END",
    "meta_robots": "CASE WHEN page_id % 7 = 0 THEN 'noindex' ELSE '' END",
}


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table with stand-ins for its fetch fields."""
    pages = read(spark, sf_dir).select("*", *[F.expr(v).alias(k) for k, v in DERIVED.items()])
    headers = F.map_filter(F.create_map(F.lit("content-encoding"), F.col("content_encoding"), F.lit("x-robots-tag"), F.col("meta_robots")), lambda k, v: v != "")
    return pages.withColumn("headers", headers).withColumn("site", U.host(F.col("url")))


def content_type(value: Column) -> Column:
    """(mime, charset) of a content-type header, lower-cased, without quotes."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.struct(F.trim(F.split_part(low, F.lit(";"), F.lit(1))).alias("mime"), F.regexp_extract(low, r";\s*charset\s*=\s*[\"']?([^;\"'\s]+)", 1).alias("charset"))


def set_cookies(values: Column) -> Column:
    """Names and values of Set-Cookie headers; of equal names the last counts."""
    first = F.transform(F.filter(values, lambda v: v.contains("=")), lambda v: F.split_part(v, F.lit(";"), F.lit(1)))
    pairs = F.transform(first, lambda v: F.struct(F.trim(F.split_part(v, F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_replace(v, "^[^=]*=", "")).alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    return F.map_from_entries(F.filter(named, lambda p: p == F.element_at(F.filter(named, lambda q: q["k"] == p["k"]), -1)))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait, from seconds or an HTTP date; never below zero, null if unreadable."""
    at = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    seconds = F.coalesce(F.trim(value).try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def decode_body(body: Column, header_charset: Column) -> Column:
    """(text, charset, source): byte order mark, then header, then meta, then UTF-8 if valid, else Windows-1252."""
    meta = F.lower(F.regexp_extract(F.decode(F.substring(body, 1, 2048), "ISO-8859-1"), r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", 1))
    bom = F.when(F.hex(F.substring(body, 1, 3)) == "EFBBBF", "utf-8").when(F.hex(F.substring(body, 1, 2)) == "FFFE", "utf-16le").when(F.hex(F.substring(body, 1, 2)) == "FEFF", "utf-16be")
    known = ("utf-8", "utf8", "iso-8859-1", "latin1", "us-ascii", "utf-16", "utf-16le", "utf-16be", "windows-1252", "cp1252")
    source = F.when(bom.isNotNull(), "bom").when(header_charset.isin(*known), "header").when(meta.isin(*known), "meta").when(F.is_valid_utf8(body), "utf-8").otherwise("fallback")
    charset = F.when(bom.isNotNull(), bom).when(header_charset.isin(*known), header_charset).when(meta.isin(*known), meta).when(F.is_valid_utf8(body), "utf-8").otherwise("windows-1252")
    as_latin = F.decode(body, "ISO-8859-1")
    text = F.when(charset.isin("utf-8", "utf8"), F.make_valid_utf8(body.cast("string"))).when(charset.isin("utf-16", "utf-16le", "utf-16be"), F.when(charset == "utf-16be", F.decode(body, "UTF-16BE")).when(charset == "utf-16le", F.decode(body, "UTF-16LE")).otherwise(F.decode(body, "UTF-16"))).otherwise(as_latin)
    return F.struct(F.regexp_replace(text, "^﻿", "").alias("text"), charset.alias("charset"), source.alias("source"))


def looks_blocked(headers: Column, html: Column) -> Column:
    """Why an answer looks like a challenge; empty if it doesn't."""
    start = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 4096))
    out = F.lit("")
    for text in reversed(BLOCK_TEXTS):
        out = F.when(start.contains(text), f"page: {text}").otherwise(out)
    for name, value in BLOCK_HEADERS.items():
        got = F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))
        out = F.when((got != "") & got.contains(value), f"header: {name}").otherwise(out)
    return out


def record(answers: DataFrame) -> DataFrame:
    """Raw answers (page_id, requested_url, final_url, status, headers, body, error, ...) as page records.

    Types that aren't text have no html. An answer that looks like a challenge
    has the error "blocked". Cookies come from set-cookie, one to a line.
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    header = lambda n: F.coalesce(F.try_element_at("headers", F.lit(n)), F.lit(""))
    kind = content_type(header("content-type"))
    failed = F.col("error").isNotNull()
    typed = answers.withColumn("headers", lower).withColumn("__kind", kind).withColumn("mime", F.when(failed, "").when(F.col("__kind.mime") == "", "text/html").otherwise(F.col("__kind.mime")))
    textual = ~failed & (F.col("mime").startswith("text/") | F.col("mime").isin("application/xhtml+xml", "application/xml", "application/json", "application/javascript", "application/ld+json"))
    read_ = typed.withColumn("__text", F.when(textual, decode_body(F.coalesce("body", F.lit(b"")), F.col("__kind.charset"))))
    cookies = set_cookies(F.filter(F.split(header("set-cookie"), "\n"), lambda x: x != ""))
    shown = read_.withColumns({"html": F.when(textual, F.col("__text.text")), "charset": F.coalesce(F.col("__text.charset"), F.lit("")), "charset_source": F.coalesce(F.col("__text.source"), F.lit("")), "decoded_bytes": F.octet_length("body").cast("long"), "cookies": cookies, "url": F.coalesce("final_url", "requested_url")})
    blocked = F.col("status").isin(*CHALLENGES) & (looks_blocked(F.col("headers"), F.col("html")) != "")
    return shown.withColumn("error", F.when(F.col("error").isNull() & F.coalesce(blocked, F.lit(False)), "blocked").otherwise(F.col("error"))).drop("__kind", "__text", "body")


def cacheable(answers: DataFrame) -> DataFrame:
    """Answers (url, status, headers, size, fetched_at) that may be kept."""
    control = F.lower(F.coalesce(F.try_element_at("headers", F.lit("cache-control")), F.lit("")))
    return answers.where(F.col("status").isin(*CACHEABLE) & ~control.rlike("no-store|private") & (F.col("size") <= MAX_CACHED))


def upsert(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache (url, stored_at, ...) with the latest answer of each url; a 304 only renews its time."""
    renewed = answers.where("status = 304").groupBy("url").agg(F.max("stored_at").alias("renewed"))
    fresh = cacheable(answers.where("status <> 304")) if "headers" in answers.columns else answers.where("status <> 304")
    rows = cache.unionByName(fresh.select(*cache.columns))
    latest = rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "url"]), "stored_at").alias("x")).select("url", "x.*")
    return latest.join(renewed, "url", "left").withColumn("stored_at", F.greatest("stored_at", F.coalesce("renewed", "stored_at"))).drop("renewed")


def fresh(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("stored_at") < ttl_seconds)


def bundles(pages: DataFrame, scripts: DataFrame, most: int = 3_000_000) -> DataFrame:
    """(url, bundles): each page's own scripts joined in order, as far as their running size allows."""
    from pyspark.sql import Window as W

    wanted = pages.select("url", F.posexplode("doc.scripts").alias("pos", "s")).select("url", "pos", F.col("s.url").alias("script")).where(U.netloc(F.col("script")) == U.netloc(F.col("url")))
    got = wanted.join(scripts.select(F.col("url").alias("script"), "body"), "script")
    run = got.withColumn("upto", F.sum(F.length("body")).over(W.partitionBy("url").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    return run.where(F.col("upto") <= most).groupBy("url").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "body")))["body"], "\n").alias("bundles"))
