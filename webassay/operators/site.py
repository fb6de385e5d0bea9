"""Site-level findings: each an aggregate over the whole crawl that gives no row or one.

Tables of a crawl: ``pages`` (page records with doc), ``outlinks`` (url,
target), ``sitemap`` (url), ``robots`` (host, fetched, error, body), and so
on; a rule takes what it needs. Every finding row has finding_id, severity,
category, evidence, affected and a null url.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webassay.functions import text as T
from webassay.functions import urls as U
from webassay.operators import duplicates, robots
from webassay.operators.rules import CRITICAL, INFO, NOTICE, WARNING

#: Most of the addresses that an evidence text names; they are the least, so the text doesn't depend on order.
SAMPLE = 5


def finding(rows: DataFrame, finding_id: str, severity: str, evidence: Column | None = None, least: int = 1, by: list[str] = []) -> DataFrame:
    """One finding for a table of affected rows, none if there are fewer than ``least``.

    Evidence is the first few values in order, by a bounded aggregate.
    """
    source = rows if evidence is None else rows.withColumn("__e", evidence)
    if evidence is not None:
        each = source.select(*by, "__e").distinct()
        rank = F.row_number().over(W.partitionBy(*by).orderBy("__e")) if by else None
        few = each.orderBy("__e").limit(SAMPLE) if rank is None else each.withColumn("__r", rank).where(F.col("__r") <= SAMPLE)
        sample = few.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("__e")), ", ").alias("evidence"))
    counted = source.groupBy(*by).agg(F.count("*").alias("affected")).where(F.col("affected") >= least)
    out = counted.join(sample, by) if by and evidence is not None else counted.join(sample, F.lit(True)) if evidence is not None else counted.withColumn("evidence", F.lit(""))
    return out.select(*by, F.lit(finding_id).alias("finding_id"), F.lit(severity).alias("severity"), F.lit(finding_id.split(".")[0]).alias("category"), "evidence", F.col("affected").cast("long").alias("affected"), F.lit(None).cast("string").alias("url"))


def _flag(spark: SparkSession, found: bool | Column, source: DataFrame | None, finding_id: str, severity: str, evidence: str = "") -> DataFrame:
    rows = source.where(found) if source is not None else spark.range(1 if found else 0)
    return rows.limit(1).select(F.lit(finding_id).alias("finding_id"), F.lit(severity).alias("severity"), F.lit(finding_id.split(".")[0]).alias("category"), F.lit(evidence).alias("evidence"), F.lit(0).cast("long").alias("affected"), F.lit(None).cast("string").alias("url"))


def robots_health(files: DataFrame, sitemaps_declared: DataFrame | None = None) -> list[DataFrame]:
    """Rules on robots.txt files (host, fetched, error, body)."""
    read = files.where("fetched")
    star = robots.agents(read).where("agent = '*'")
    closed = robots.rules(read).where("not allow and path = '/'").join(star, ["host", "group"], "left_semi")
    bare = read.join(robots.sitemaps(read).select("host").distinct(), "host", "left_anti")
    return [
        finding(files.where("error <> ''"), "robots.unreachable", WARNING, F.col("host")),
        finding(files.where("not fetched and error = ''"), "robots.missing", NOTICE, F.col("host")),
        finding(closed.select("host").distinct(), "robots.blocks_everything", CRITICAL, F.col("host")),
        finding(bare, "robots.no_sitemap_declared", NOTICE, F.col("host")),
    ]


def crawler_access(files: DataFrame, targets: DataFrame) -> list[DataFrame]:
    """Search engines, answer engines and training crawlers that robots.txt shuts out of the target addresses (url)."""
    spark = files.sparkSession
    crawlers = spark.createDataFrame([(c, kind) for kind, names in (("search", robots.SEARCH), ("answer", robots.ANSWERS), ("training", robots.TRAINING)) for c in names], "crawler string, kind string")
    shut = robots.allowed(files.where("fetched"), crawlers, targets).where("not allowed").join(F.broadcast(crawlers), "crawler")
    return [finding(shut.where(F.col("kind") == k).select("crawler").distinct(), i, s, F.col("crawler")) for k, i, s in (("search", "robots.blocks_search_engine", CRITICAL), ("answer", "robots.blocks_answer_engines", WARNING), ("training", "robots.blocks_ai_training", INFO))]


def blocked_resources(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Styles and scripts of pages that the search engine may not fetch."""
    resources = pages.select(F.explode(F.concat(F.slice("doc.stylesheets", 1, 8), F.slice(F.filter(F.transform("doc.scripts", lambda s: s["url"]), lambda u: u != ""), 1, 8))).alias("url")).distinct()
    googlebot = files.sparkSession.createDataFrame([("googlebot",)], "crawler string")
    return finding(robots.allowed(files.where("fetched"), googlebot, resources).where("not allowed"), "robots.blocks_resources", WARNING, F.col("url"))


def sitemap_health(files: DataFrame) -> list[DataFrame]:
    """Rules on sitemap files (url, fetched, reason, truncated)."""
    spark = files.sparkSession
    none = files.where("fetched").isEmpty()
    return [_flag(spark, none, None, "sitemap.missing", WARNING)] + ([] if none else [finding(files.where("not fetched"), "sitemap.partly_unreadable", WARNING, F.concat_ws(": ", "url", "reason")), finding(files.where("truncated"), "sitemap.truncated", INFO, F.col("url"))])


def listed(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages that the sitemap (url) lists, with what is wrong with each entry."""
    urls = sitemap.select(U.normalize(F.col("url")).alias("norm")).distinct()
    own = pages.withColumn("norm", U.normalize(F.col("url"))).join(urls, "norm", "left_semi")
    directives = T.directives(F.concat(F.col("doc.robots_all"), F.array(F.coalesce(F.try_element_at("headers", F.lit("x-robots-tag")), F.lit("")))))
    canonical = F.coalesce(F.get("doc.canonicals", 0), F.lit(""))
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return own.select(
        "url", (F.col("error").isNotNull() | (F.col("status") >= 400)).alias("broken"), (F.size("redirects") > 0).alias("redirecting"),
        F.arrays_overlap(directives, F.array(F.lit("noindex"), F.lit("none"))).alias("noindexed"), ((canonical != "") & (bare(canonical) != bare(F.col("url")))).alias("non_canonical"),
    )


def sitemap_entries(pages: DataFrame, sitemap: DataFrame) -> list[DataFrame]:
    rows = listed(pages, sitemap)
    return [
        finding(rows.where("broken"), "sitemap.broken_entries", WARNING, F.col("url")), finding(rows.where("redirecting and not broken"), "sitemap.redirecting_entries", NOTICE, F.col("url")),
        finding(rows.where("noindexed and not broken"), "sitemap.noindexed_entries", WARNING, F.col("url")), finding(rows.where("non_canonical and not broken"), "sitemap.non_canonical_entries", NOTICE, F.col("url")),
    ]


def crawl_shape(pages: DataFrame, skipped: DataFrame, max_pages: int) -> list[DataFrame]:
    """Rules on a crawl's reach; skipped has (url, reason)."""
    few = pages.where("error is null").limit(2).count() <= 1 and max_pages > 1  # two rows at most are counted
    return [finding(skipped.where("reason = 'blocked by robots.txt'"), "crawl.blocked_by_robots", NOTICE, F.col("url")), _flag(pages.sparkSession, few, None, "crawl.no_pages_discovered", WARNING)]


def measurement(pages: DataFrame, detections: DataFrame) -> list[DataFrame]:
    """Analytics that are absent, or that only run after consent."""
    kinds = detections.agg(F.bool_or(F.col("category").isin("analytics", "tag-manager")).alias("measured"), F.bool_or(F.col("category") == "consent").alias("asked"))
    any_page = pages.where("error is null").limit(1).select(F.lit(True).alias("p"))
    rows = any_page.join(kinds, F.lit(True)).select(F.coalesce("measured", F.lit(False)).alias("measured"), F.coalesce("asked", F.lit(False)).alias("asked"))
    return [_flag(pages.sparkSession, F.expr("not measured and asked"), rows, "technical.analytics_behind_consent", INFO), _flag(pages.sparkSession, F.expr("not measured and not asked"), rows, "technical.no_analytics", NOTICE)]


def llms_txt(probe: DataFrame) -> list[DataFrame]:
    """Found: a successful answer with text that isn't HTML (status, body)."""
    found = F.coalesce((F.col("status").between(200, 299)) & (F.trim("body") != "") & ~F.lower(F.ltrim("body")).rlike("^<(?:!doctype|html)"), F.lit(False))
    return [_flag(probe.sparkSession, found, probe, "robots.llms_txt_found", INFO), _flag(probe.sparkSession, ~found, probe, "robots.no_llms_txt", NOTICE)]


def reachability(per_node: DataFrame, root: str, deepest: int = 3) -> list[DataFrame]:
    """Rules on graph metrics (node, depth, inlinks, outlinks, ok)."""
    return [
        finding(per_node.where((F.col("inlinks") == 0) & (F.col("node") != root) & F.col("ok")), "structure.orphan_pages", WARNING, F.col("node")),
        finding(per_node.where(F.col("depth") > deepest), "structure.deep_pages", NOTICE, F.col("node")),
        finding(per_node.where("outlinks = 0"), "structure.dead_ends", NOTICE, F.col("node")),
    ]


def link_targets(pages: DataFrame, outlinks: DataFrame) -> DataFrame:
    """(target, status, error, redirected, sources) of fetched link targets; of pages alike in normal form the last counts."""
    by_url = pages.select(U.normalize(F.col("url")).alias("target"), "status", "error", (F.size("redirects") > 0).alias("redirected"), "page_id")
    last = by_url.groupBy("target").agg(F.max_by(F.struct("status", "error", "redirected"), "page_id").alias("x")).select("target", "x.*")
    links = outlinks.select("url", U.normalize(F.col("target")).alias("target")).distinct()
    return links.join(last, "target").groupBy("target", "status", "error", "redirected").agg(F.count_distinct("url").alias("sources"))


def internal_links(pages: DataFrame, outlinks: DataFrame) -> list[DataFrame]:
    rows = link_targets(pages, outlinks)
    broken = F.col("error").isNotNull() | (F.col("status") >= 400)
    return [finding(rows.where(broken), "structure.broken_internal_links", CRITICAL, F.col("target")), finding(rows.where(~broken & F.col("redirected")), "structure.links_to_redirects", NOTICE, F.col("target"))]


def soft_404(pages: DataFrame, probes: DataFrame, threshold: float = T.NEAR) -> DataFrame:
    """Pages that look like the answers to addresses that can't exist; probes are two answers (status, text).

    The fingerprint of the probes is one row, so it is broadcast.
    """
    ok = probes.where("status between 200 and 299").select(T.sketch(F.col("text")).alias("s"))
    both = ok.agg(F.collect_list("s").alias("l"), F.count("*").alias("n")).where("n >= 2").select(F.col("l")[0].alias("a"), F.col("l")[1].alias("b"))
    print_ = both.where(T.similarity(F.col("a"), F.col("b")) >= threshold).select(F.col("a").alias("probe"))
    alike = pages.where("status between 200 and 299 and error is null").join(F.broadcast(print_), F.lit(True)).where(T.similarity(T.sketch(F.col("doc.text")), F.col("probe")) >= threshold)
    return finding(alike, "structure.soft_404", WARNING, F.col("url"))


def parameter_explosion(pages: DataFrame, least: int = 5) -> DataFrame:
    """(host, path, variants) of paths with many query strings."""
    parts = pages.select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), U.query(F.col("url")).alias("query")).where("query <> ''")
    return parts.groupBy("host", "path").agg(F.count_distinct("query").alias("variants")).where(F.col("variants") >= least)


def external_links(probed: DataFrame, outlinks: DataFrame) -> list[DataFrame]:
    """probed: (target, status, error); outlinks: (url, target)."""
    first = outlinks.groupBy("target").agg(F.min("url").alias("source"))
    bad = probed.where("error is not null or status >= 400").join(first, "target", "left").withColumn("source", F.coalesce("source", F.lit("?")))
    return [finding(probed, "external.checked", INFO), finding(bad, "external.broken_links", WARNING, F.concat("target", F.lit(" from "), "source"))]


def duplicate_metadata(pages: DataFrame) -> list[DataFrame]:
    """pages: url, cluster (null outside language clusters), title, description, h1. Evidence is the three values of most pages."""
    out = []
    for name in ("title", "description", "h1"):
        found = duplicates.groups(pages, name, cluster="cluster")
        top = found.orderBy(F.desc("members"), "value").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("members")).alias("m"), "value"))), lambda x: x["value"]), " | ").alias("evidence"))
        total = found.agg(F.sum("members").alias("affected")).where("affected > 0")
        out.append(total.join(F.broadcast(top), F.lit(True)).select(F.lit(f"duplicate.{name}").alias("finding_id"), F.lit(WARNING).alias("severity"), F.lit("duplicate").alias("category"), "evidence", F.col("affected").cast("long").alias("affected"), F.lit(None).cast("string").alias("url")))
    return out


def duplicate_content(hashed: DataFrame) -> list[DataFrame]:
    """hashed: url, cluster, content_hash. Exact copies of several pages, and variants of one page that nobody translated."""
    found = duplicates.content_groups(hashed, cluster="cluster")
    total = found.groupBy("finding_id").agg(F.sum("members").alias("affected"), F.min("first").alias("evidence"))
    return [total.select("finding_id", F.lit(WARNING).alias("severity"), F.lit("duplicate").alias("category"), "evidence", F.col("affected").cast("long").alias("affected"), F.lit(None).cast("string").alias("url"))]


def near_content(pairs: DataFrame, clusters: DataFrame) -> list[DataFrame]:
    """Near-duplicate pairs (a, b) inside a language cluster are partly translated, others are near copies."""
    c = lambda side: clusters.select(F.col("url").alias(side), F.col("cluster").alias(f"c{side}"))
    tagged = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left").withColumn("inside", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
    partly = tagged.where("inside").agg((2 * F.count("*")).alias("affected")).where("affected > 0").select(F.lit("duplicate.partly_translated").alias("finding_id"), F.lit(NOTICE).alias("severity"), F.lit("duplicate").alias("category"), F.lit("").alias("evidence"), F.col("affected").cast("long").alias("affected"), F.lit(None).cast("string").alias("url"))
    urls = tagged.where("not inside").select(F.explode(F.array("a", "b")).alias("u")).distinct()
    return [partly, finding(urls, "duplicate.near_content", WARNING, F.col("u"))]


@dataclass(frozen=True)
class SiteRule:
    """A check of a whole crawl: the tables it needs, and a function of them that gives finding tables."""

    name: str
    needs: tuple[str, ...]
    check: Callable[..., list[DataFrame]]


REGISTRY: list[SiteRule] = []


def site_rule(name: str, *needs: str):
    """Register a function of the named tables as a site rule: the extension point for further checks."""

    def add(check):
        REGISTRY.append(SiteRule(name, needs, check))
        return check

    return add


for _name, _needs, _check in (
    ("robots_health", ("robots",), robots_health),
    ("crawler_access", ("robots", "targets"), crawler_access),
    ("blocked_resources", ("robots", "pages"), lambda files, pages: [blocked_resources(files, pages)]),
    ("sitemap_health", ("sitemap_files",), sitemap_health),
    ("sitemap_entries", ("pages", "sitemap"), sitemap_entries),
    ("crawl_shape", ("pages", "skipped"), lambda pages, skipped: crawl_shape(pages, skipped, 2)),
    ("measurement", ("pages", "detections"), measurement),
    ("llms_txt", ("llms_txt",), llms_txt),
    ("reachability", ("nodes", "root"), lambda nodes, root: reachability(nodes, root)),
    ("internal_links", ("pages", "outlinks"), internal_links),
    ("soft_404", ("pages", "probes"), lambda pages, probes: [soft_404(pages, probes)]),
    ("crawl_waste", ("pages",), lambda pages: [finding(parameter_explosion(pages), "crawl.parameter_explosion", WARNING, F.concat("host", "path"))]),
    ("external_links", ("probed", "outlinks"), external_links),
    ("duplicate_metadata", ("metadata",), duplicate_metadata),
    ("duplicate_content", ("hashed",), duplicate_content),
    ("near_content", ("pairs", "clusters"), near_content),
):
    site_rule(_name, *_needs)(_check)


def broken_rule(spark: SparkSession, name: str, error: Exception) -> DataFrame:
    """The finding that stands in for a rule that fails: one bad check must not sink a report."""
    return _flag(spark, True, None, "analyzer.error", INFO, f"{name}: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")


def site_findings(spark: SparkSession, crawl: dict, rules: list[SiteRule] | None = None) -> DataFrame:
    """All site findings of a crawl, by name of its tables; rules whose tables aren't there are left out."""
    found: list[DataFrame] = []
    for r in rules or REGISTRY:
        if all(crawl.get(k) is not None for k in r.needs):
            try:
                found += r.check(*[crawl[k] for k in r.needs])
            except Exception as e:  # noqa: BLE001  a rule that can't be planned is a finding, not a crash
                found.append(broken_rule(spark, r.name, e))
    return reduce(DataFrame.unionByName, found) if found else _flag(spark, False, None, "", INFO)
