"""Scores: explainable deductions by category, overall and by lens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points by severity, weights, lenses, grades.
CATEGORY_POINTS = {"critical": 85.0, "warning": 30.0, "notice": 10.0, "info": 0.0}
OVERALL_POINTS = {"critical": 45.0, "warning": 15.0, "notice": 1.0, "info": 0.0}
WEIGHTS = {
    "indexability": 3.0, "technical": 2.5, "canonical": 2.0, "title": 2.0, "content": 2.0, "structure": 1.5, "duplicate": 1.5, "description": 1.0, "headings": 1.0, "images": 1.0,
    "links": 1.0, "sitemap": 1.0, "robots": 1.0, "render": 1.0, "url": 0.5, "i18n": 0.5, "social": 0.5, "structured": 0.5, "crawl": 0.5, "external": 0.5,
}
ALWAYS = ("title", "description", "indexability", "canonical", "headings", "images", "links", "social", "structured", "i18n", "technical", "content", "url")
CRAWLED = ("sitemap", "robots", "structure", "duplicate", "crawl")
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"), (50, "E"))
LENSES = ("seo", "aio", "performance")
CATEGORY_LENSES = {
    "title": ("seo", "aio"), "description": ("seo",), "indexability": ("seo", "aio"), "canonical": ("seo",), "headings": ("seo", "aio"), "images": ("seo",), "links": ("seo", "aio"), "social": ("seo",), "structured": ("seo", "aio"), "i18n": ("seo",), "content": ("seo", "aio"),
    "url": ("seo",), "technical": ("seo",), "sitemap": ("seo", "aio"), "robots": ("seo", "aio"), "duplicate": ("seo",), "structure": ("seo", "aio"), "crawl": ("seo",), "external": ("seo",), "render": ("seo", "aio"), "vitals": ("performance",),
}
FINDING_LENSES = {
    "technical.ttfb_slow": ("performance", "seo"), "technical.ttfb_very_slow": ("performance", "seo"), "technical.no_compression": ("performance",), "technical.large_html": ("performance",), "technical.http1": ("performance",), "technical.render_blocking_scripts": ("performance",), "technical.no_cache_validators": ("performance",),
    "images.missing_dimensions": ("performance",), "images.no_lazy_loading": ("performance",), "content.empty": ("aio", "seo"), "content.js_rendered": ("aio", "seo"), "render.content_requires_js": ("aio", "seo"), "render.links_require_js": ("aio", "seo"), "render.some_links_require_js": ("aio",), "render.title_requires_js": ("aio", "seo"),
    "render.description_requires_js": ("aio", "seo"), "robots.blocks_answer_engines": ("aio",), "robots.blocks_ai_training": ("aio",), "robots.no_llms_txt": ("aio",),
}


def _map(d: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)]), key), default)


def evaluated(crawled: bool = True, rendered: bool = False, external: bool = False, vitals: bool = False) -> list[str]:
    return [*ALWAYS, *(CRAWLED if crawled else ()), *(["render"] if rendered else []), *(["external"] if external else []), *(["vitals"] if vitals else [])]


def lenses(finding_id: Column, category: Column) -> Column:
    """Every lens that a finding bears on; the first is the one it is listed under."""
    joined = lambda d: {k: " ".join(v) for k, v in d.items()}
    return F.split(_map(joined(FINDING_LENSES), finding_id, _map(joined(CATEGORY_LENSES), category, F.lit("seo"))), " ")


def grade(score: Column) -> Column:
    out = F.lit("F")
    for floor, letter in reversed(GRADES):
        out = F.when(score >= floor, letter).otherwise(out)
    return out


def deductions(findings: DataFrame, pages: DataFrame, categories: list[str] | None = None, by: list[str] = []) -> DataFrame:
    """(by..., category, finding_id, severity, affected_pages, share, points, overall_points).

    ``findings`` has finding_id, category, severity, url (null for the site)
    and, if it is there, affected; ``pages`` has by... and pages, the size of
    each crawl. One deduction per id, by its worst severity and the share of
    pages it affects.
    """
    f = findings.where(F.col("category").isin(*(categories or evaluated())))
    if "affected" not in f.columns:
        f = f.withColumn("affected", F.lit(0))
    rank = _map({"critical": 4, "warning": 3, "notice": 2, "info": 1}, F.col("severity"), F.lit(0))
    grouped = f.groupBy(*by, "category", "finding_id").agg(F.max_by("severity", rank).alias("severity"), F.count_distinct("url").alias("urls"), F.bool_and(F.col("url").isNull()).alias("site_level"), F.count_if(F.col("url").isNull()).alias("unplaced"), F.max("affected").alias("scope"))
    sized = grouped.join(pages, by) if by else grouped.join(F.broadcast(pages.agg(F.max("pages").alias("pages"))), F.lit(True))
    n = F.greatest(F.col("pages"), F.lit(1))
    count = F.when(F.col("site_level"), F.least(F.when(F.coalesce("scope", F.lit(0)) > 0, F.col("scope")).otherwise(n), n)).otherwise(F.col("urls") + (F.col("unplaced") > 0).cast("int"))
    share = F.least(F.lit(1.0), count / n)
    return sized.select(*by, "category", "finding_id", "severity", count.cast("long").alias("affected_pages"), share.alias("share"), (_map(CATEGORY_POINTS, F.col("severity"), F.lit(0.0)) * share).alias("points"), (_map(OVERALL_POINTS, F.col("severity"), F.lit(0.0)) * share * _map(WEIGHTS, F.col("category"), F.lit(1.0))).alias("overall_points")).where("severity <> 'info'")


def _left(points: str) -> Column:
    return F.round(F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.sum(points), F.lit(0.0))), 1)


def by_category(found: DataFrame, sites: DataFrame, categories: list[str] | None = None, by: list[str] = []) -> DataFrame:
    """Every evaluated category of every site with its score; clean ones have 100."""
    every = sites.select(*by, F.explode(F.array(*[F.lit(c) for c in (categories or evaluated())])).alias("category"))
    return every.join(found, [*by, "category"], "left").groupBy(*by, "category").agg(_left("points").alias("score"), F.count("finding_id").alias("issues")).withColumn("weight", _map(WEIGHTS, F.col("category"), F.lit(1.0)))


def overall(found: DataFrame, sites: DataFrame, by: list[str] = []) -> DataFrame:
    kept = sites.select(*by, "pages")
    joined = kept.join(found, by, "left") if by else kept.join(found, F.lit(True), "left")
    scored = joined.groupBy(*by, "pages").agg(_left("overall_points").alias("overall"))
    return scored.withColumn("grade", grade(F.col("overall")))


def by_lens(found: DataFrame, sites: DataFrame, by: list[str] = []) -> DataFrame:
    every = sites.select(*by, F.explode(F.array(*[F.lit(x) for x in LENSES])).alias("lens"))
    tagged = found.select(*by, F.explode(lenses(F.col("finding_id"), F.col("category"))).alias("lens"), "overall_points")
    return every.join(tagged, [*by, "lens"], "left").groupBy(*by, "lens").agg(_left("overall_points").alias("score"))
