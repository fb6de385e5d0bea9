"""What lies between fetching and judging: links by scope, rendering, lookups, and the orders in which a report lists things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webassay.functions import text as T
from webassay.functions import urls as U

#: External addresses that are probed, and signs of an address that a table shows.
PROBED, SHOWN = 500, 68


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("page_id", "url") if c in df.columns]


def links(pages: DataFrame, target: str | None = None, include_subdomains: bool = False) -> DataFrame:
    """(page_id if there is one, url, target, pos, internal) of the links of page records, in normal form and each once a page, at its first place.

    Several pages may have one url. Internal is what lies in the target's site; without a target, on the page's own host.
    """
    keys = _keys(pages)
    each = pages.select(*keys, F.posexplode("doc.links").alias("pos", "x")).select(*keys, "pos", U.normalize(F.col("x.url")).alias("target")).where(U.scheme(F.col("target")).isin("http", "https"))
    inside = U.same_site(F.col("target"), target, include_subdomains) if target else U.base_host(U.host(F.col("target"))) == U.base_host(U.host(F.col("url")))
    return each.groupBy(*keys, "target").agg(F.min("pos").alias("pos")).withColumn("internal", inside)


def outlinks(found: DataFrame) -> DataFrame:
    """(page_id if there is one, url, outlinks, external_links): arrays in the order of the page."""
    item = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct("pos", "target"))))["target"]  # noqa: E731  a page's own links
    return found.groupBy(*_keys(found)).agg(item(F.col("internal")).alias("outlinks"), item(~F.col("internal")).alias("external_links"))


def external_targets(found: DataFrame, most: int = PROBED) -> DataFrame:
    """Distinct external addresses to probe: the first in order, as a probe costs a request each."""
    return found.where("not internal").select("target").distinct().orderBy("target").limit(most)


def render_diff(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """``pages`` with render_diff from ``rendered`` (url, doc, error): both documents side by side, null where nothing was rendered."""
    after = rendered.select(F.col("url").alias("__url"), F.col("error").alias("__error"), F.col("doc").alias("__after"))
    both = lambda name, before, later: [before.alias(f"{name}_before"), later.alias(f"{name}_after")]
    a, b = F.col("doc"), F.col("__after")
    diff = F.struct(F.col("__error").alias("error"), *both("words", a["word_count"], b["word_count"]), *both("links", F.size(a["links"]), F.size(b["links"])), *both("title", a["title"], b["title"]), *both("description", a["description"], b["description"]))
    return pages.drop("render_diff").join(after, F.col("url") == F.col("__url"), "left").withColumn("render_diff", F.when(F.col("__url").isNotNull(), diff)).drop("__url", "__error", "__after")


def indexable(pages: DataFrame) -> DataFrame:
    """Pages that a search engine would consider: answered well, HTML, not noindex, and canonical for themselves."""
    header = F.coalesce(F.try_element_at("headers", F.lit("x-robots-tag")), F.lit(""))
    asked = T.directives(F.array(header, F.col("doc.robots")))
    canonical = F.coalesce(F.get("doc.canonicals", 0), F.lit(""))
    own = (canonical == "") | (U.normalize(canonical) == U.normalize(F.col("url")))
    return pages.where(F.col("error").isNull() & F.col("status").between(200, 299) & F.col("mime").isin("text/html", "application/xhtml+xml") & ~F.arrays_overlap(asked, F.array(F.lit("noindex"), F.lit("none"))) & own)


def metadata(pages: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(url, cluster, title, description, h1, content_hash) of indexable pages; ``clusters`` has url, cluster of language variants."""
    rows = indexable(pages).select("url", F.col("doc.title").alias("title"), F.col("doc.description").alias("description"), F.coalesce(F.get("doc.h1s", 0), F.lit("")).alias("h1"), T.content_hash(F.col("doc.text")).alias("content_hash"))
    if clusters is None:
        return rows.withColumn("cluster", F.lit(None).cast("string"))
    return rows.join(clusters.select("url", F.col("cluster").cast("string").alias("cluster")), "url", "left")


def page_for(pages: DataFrame, url: str) -> DataFrame:
    """The first page, by page_id, that was asked for at this address in normal form."""
    wanted = U.normalize(F.lit(url))
    return pages.where(U.normalize(F.coalesce("requested_url", "url") if "requested_url" in pages.columns else F.col("url")) == wanted).orderBy("page_id").limit(1)


def known_nodes(pages: DataFrame) -> DataFrame:
    """(url, page_id): addresses asked for and landed at, in normal form; of several pages the first counts, and asking counts before landing."""
    each = F.explode(F.array(F.struct(F.lit(0).alias("rank"), U.normalize(F.col("requested_url")).alias("url")), F.struct(F.lit(1).alias("rank"), U.normalize(F.col("final_url")).alias("url"))))
    return pages.select("page_id", each.alias("x")).groupBy("x.url").agg(F.min_by("page_id", F.struct(F.col("x.rank"), F.col("page_id"))).alias("page_id"))


def topped_up(entries: DataFrame, seen: DataFrame, room: int) -> DataFrame:
    """Sitemap entries (source, pos, loc) that weren't seen (norm), as many as there is room for once links run out, in their order."""
    fresh = entries.withColumn("norm", U.normalize(F.col("loc"))).join(seen.select("norm").distinct(), "norm", "left_anti")
    first = fresh.groupBy("norm").agg(F.min(F.struct("source", "pos", "loc")).alias("x")).select("norm", "x.*")
    return first.orderBy("source", "pos").limit(room)


def quota(entries: DataFrame, budget: int, share: int = 4) -> DataFrame:
    """Entries (source, pos, admitted) with ``now``: accepted while fewer than the quota of admitted ones came before them; others wait."""
    before = F.coalesce(F.sum(F.col("admitted").cast("int")).over(W.partitionBy("source").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("now", before < max(1, budget // share))


# Orders of reports


def shortened(url: Column, most: int = SHOWN) -> Column:
    """An address without scheme and host, cut with an ellipsis."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    path = F.when(bare == "", "/").otherwise(bare)
    return F.when(F.length(path) > most, F.concat(F.left(path, F.lit(most - 1)), F.lit("…"))).otherwise(path)


def detections_in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("confidence"), "category", "technology")


def by_category(found: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., category, technologies): names in order."""
    return found.groupBy(*by, "category").agg(F.array_sort(F.collect_set("technology")).alias("technologies"))


def categories_in_order(scores: DataFrame) -> DataFrame:
    """Categories of a score, the worst first; of equal ones the weightier first."""
    return scores.orderBy("score", F.desc("weight"), "category")


def deductions_in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("points"), "finding_id")


def measured_first(ranks: DataFrame, k: int) -> DataFrame:
    """The k pages (one at least) of the highest rank, whose vitals are worth the time."""
    return ranks.orderBy(F.desc("pagerank"), "node").limit(max(1, k))


def deepest_first(per_node: DataFrame, deepest: int = 3) -> DataFrame:
    return per_node.where(F.col("depth") > deepest).orderBy(F.desc("depth"), "node")


def worst_paths(variants: DataFrame) -> DataFrame:
    """Paths (host, path, variants) with the most query strings first."""
    return variants.orderBy(F.desc("variants"), "host", "path")


def findings_in_order(found: DataFrame) -> DataFrame:
    """The order of a report: graver first, then by category, id and address, those of the site before those of pages."""
    from webassay.operators.rules import severity_rank

    return found.orderBy(severity_rank(F.col("severity")), "category", "finding_id", F.col("url").asc_nulls_first())


def grouped_findings(found: DataFrame, most: int = 10) -> DataFrame:
    """(finding_id, severity, message, fix, n, site_wide, urls): one row an id, with its first addresses by name; a bounded list."""
    ranked = found.withColumn("__r", F.row_number().over(W.partitionBy("finding_id").orderBy(F.col("url").asc_nulls_first())))
    return ranked.groupBy("finding_id").agg(
        F.min_by("severity", "__r").alias("severity"), F.min_by("message", "__r").alias("message"), F.min_by("fix", "__r").alias("fix"), F.count("*").alias("n"), F.bool_or(F.col("url").isNull()).alias("site_wide"),
        F.array_sort(F.collect_list(F.when((F.col("__r") <= most) & F.col("url").isNotNull(), F.col("url")))).alias("urls"),
    )


def headers_of(json: Column) -> Column:
    """Headers that a cache keeps as JSON."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def utc_text(at: Column) -> Column:
    """A time as ISO 8601 text in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
