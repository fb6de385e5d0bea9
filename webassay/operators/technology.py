"""Technology detection: a catalogue of signals, matched in one pass, combined by noisy-or."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webassay.operators import catalogue as C
from webassay.operators.catalogue import Catalogue, Signal
from webassay.session import checkpoint

DECAY, MIN_CONFIDENCE = 0.9, 0.5


def _found(value: Column, s: Signal) -> Column:
    """The version (maybe empty) that a pattern finds in one text, null if it doesn't match; case counts where the signal says so."""
    p = s.pattern if s.case else f"(?i){s.pattern}"
    return F.when(value.rlike(p), F.coalesce(F.regexp_extract(value, p, s.version), F.lit("")) if s.version else F.lit(""))


def _first(values: Column, s: Signal) -> Column:
    return F.get(F.filter(F.transform(values, lambda v: _found(v, s)), lambda x: x.isNotNull()), 0)


def check(s: Signal, prefilter: bool = True) -> Column:
    """Version (maybe empty) if the signal is there, else null. Needs html, url, doc, headers, cookies, bundles, js_globals."""
    match s.type:
        case "header":
            return _found(F.coalesce(F.try_element_at("headers", F.lit(s.key)), F.lit("")), s)
        case "cookie":
            names = F.filter(F.map_keys(F.coalesce("cookies", F.create_map().cast("map<string,string>"))), lambda k: k.rlike(f"(?i){s.key}"))
            return F.when(F.size(names) > 0, "")
        case "js":
            return F.when(F.array_contains(F.coalesce("js_globals", F.array().cast("array<string>")), s.key), "")
        case "url":
            return _found(F.col("url"), s)
        case "meta":
            return _first(F.transform(F.filter(F.col("doc")["metas"], lambda m: m["name"] == s.key), lambda m: m["content"]), s)
        case "bundle":
            return _found(F.coalesce("bundles", F.lit("")), s)
        case "script":
            return _first(F.transform(F.col("doc")["scripts"], lambda x: x["src"]), s)
        case "stylesheet":
            return _first(F.col("doc")["stylesheets"], s)
        case "dom":
            return _found(F.col("html"), replace(s, pattern=f"<{s.key or '[a-z][a-z0-9-]*'}(?=[\\s>])[^>]*?{s.pattern}"))
    found = _found(F.col("html"), s)
    return F.when(F.col("__low").contains(s.needs), found) if prefilter and s.needs else found


def signals(pages: DataFrame, catalogue: Catalogue | None = None, prefilter: bool = True) -> DataFrame:
    """(site?, url, technology, category, confidence, version, evidence): one row per signal that a page shows."""
    c = catalogue or C.build()
    extra = {"headers": "map<string,string>", "cookies": "map<string,string>", "bundles": "string", "js_globals": "array<string>"}
    full = pages.withColumns({k: F.lit(None).cast(t) for k, t in extra.items() if k not in pages.columns} | {"__low": F.lower("html")})
    full = full.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    keys = [k for k in ("site", "url") if k in pages.columns]
    one = lambda s: F.transform(F.array(check(s, prefilter)), lambda v: F.when(v.isNotNull(), F.struct(F.lit(s.technology).alias("technology"), F.lit(c.category[s.technology]).alias("category"), F.lit(s.confidence).alias("confidence"), v.alias("version"), F.lit(f"{s.type} {s.key or s.pattern}"[:60]).alias("evidence"))))[0]
    return full.select(*keys, F.explode(F.array_compact(F.array(*[one(s) for s in c.signals]))).alias("s")).select(*keys, "s.*")


def combine(shown: DataFrame, by: list[str], least: float = MIN_CONFIDENCE) -> DataFrame:
    """Detections: noisy-or over the signals of each technology, and the version of the surest one that has it."""
    confidence = F.round(1 - F.product(1 - F.col("confidence")), 3)
    best = F.max_by("version", F.struct((F.col("version") != "").alias("has"), "confidence", "version"))
    return shown.groupBy(*by, "technology", "category").agg(confidence.alias("confidence"), best.alias("version"), F.array_sort(F.collect_set("evidence")).alias("evidence")).where(F.col("confidence") >= least)


def implied(direct: DataFrame, by: list[str], catalogue: Catalogue | None = None) -> DataFrame:
    """Detections with what they imply, at DECAY per step; the greater confidence stays. There are as many steps as the catalogue's longest chain has."""
    c = catalogue or C.build()
    spark = direct.sparkSession
    edges = F.broadcast(spark.createDataFrame([(a, b, c.category[b]) for a, b in c.implies] or [("", "", "")], "technology string, implied string, implied_category string"))
    every = direct.select(*by, "technology", "category", "confidence", "version", F.lit("").alias("implied_by"))
    last = every
    for _ in range(C.longest_chain(c.implies)):
        last = last.join(edges, "technology").select(*by, F.col("implied").alias("technology"), F.col("implied_category").alias("category"), F.round(F.col("confidence") * DECAY, 3).alias("confidence"), F.lit("").alias("version"), F.col("technology").alias("implied_by"))
        every = every.unionByName(last)
    best = F.struct("confidence", (F.col("implied_by") == "").alias("direct"), "implied_by")
    grouped = every.groupBy(*by, "technology", "category").agg(F.max("confidence").alias("confidence"), F.max("version").alias("version"), F.bool_or(F.col("implied_by") == "").alias("direct"), F.max_by("implied_by", best).alias("by"))
    return grouped.select(*by, "technology", "category", "confidence", "version", F.when(F.col("direct"), "").otherwise(F.col("by")).alias("implied_by"))


def detect(pages: DataFrame, by: list[str], catalogue: Catalogue | None = None) -> DataFrame:
    return implied(checkpoint(combine(signals(pages, catalogue), by).drop("evidence")), by, catalogue)


def merged(detections: DataFrame, by: list[str]) -> DataFrame:
    """One row per technology of a site from rows per page: the surest, ties by version."""
    return detections.groupBy(*by, "technology", "category").agg(F.max("confidence").alias("confidence"), F.max_by("version", F.struct("confidence", "version")).alias("version"))


def js_globals(catalogue: Catalogue | None = None) -> list[str]:
    """Globals that a renderer should probe."""
    return sorted({s.key for s in (catalogue or C.build()).signals if s.type == "js"})
