"""Queries over pages: extraction, findings, addresses, links, hosts, duplicates, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.functions import html as H
from webassay.functions import text as T
from webassay.functions import urls as U
from webassay.operators import compare, duplicates, rules, score, site
from webassay.plans import oracle as O
from webassay.plans.registry import query
from webassay.sources import pages as S


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages with doc: the one scan that everything else starts from."""
    return rules.with_defaults(S.fetched(spark, sf_dir))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(S.fetched(spark, sf_dir))


@query(f"""WITH {O.DOCS} SELECT page_id, titles[1] AS title, length(titles[1])::INT AS title_length, lang, charset, len(h1s)::INT AS h1_count, h1s[1] AS h1, words::INT AS word_count, len(hrefs)::INT AS links_total,
  bytes::INT AS bytes, markup_bytes::INT AS markup_bytes FROM d""")
def page_extract(spark, sf_dir):
    d = H.document(S.read(spark, sf_dir), fields=("title", "lang", "charset_meta", "h1s", "word_count", "links", "bytes", "markup_bytes"))
    return d.select("page_id", "doc.title", F.length("doc.title").alias("title_length"), "doc.lang", F.col("doc.charset_meta").alias("charset"), F.size("doc.h1s").alias("h1_count"), F.get("doc.h1s", 0).alias("h1"), F.col("doc.word_count").alias("word_count"), F.size("doc.links").alias("links_total"), F.col("doc.bytes").cast("int").alias("bytes"), F.col("doc.markup_bytes").cast("int").alias("markup_bytes"))


@query(f"WITH {O.DOCS} SELECT page_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM d")
def page_text(spark, sf_dir):
    return H.document(S.read(spark, sf_dir), fields=("text",)).select("page_id", F.md5("doc.text").alias("text_md5"), F.length("doc.text").cast("long").alias("n_chars"))


#: What fires on the test pages, rule by rule; the other branches are tested on inline pages.
_FIRES = {
    ("title.missing", "critical"): "len(list_filter(titles, lambda t: t <> '')) = 0", ("title.multiple", "warning"): "len(titles) > 1", ("title.too_long", "warning"): "length(titles[1]) > 60", ("title.too_short", "notice"): "titles[1] <> '' AND length(titles[1]) < 30",
    ("description.missing", "warning"): "NOT regexp_matches(markup, '<meta\\b[^>]*name=\"description\"', 'is')", ("indexability.noindex", "critical"): "meta_robots = 'noindex'", ("canonical.missing", "warning"): "NOT regexp_matches(markup, 'rel=\"canonical\"', 'is')",
    ("headings.none", "warning"): "len(levels) = 0", ("headings.no_h1", "warning"): "len(levels) > 0 AND len(h1s) = 0", ("headings.multiple_h1", "notice"): "len(h1s) > 1", ("headings.empty", "notice"): "list_contains(h1s, '')",
    ("links.none", "warning"): "len(hrefs) = 0", ("links.excessive", "notice"): "len(hrefs) > 150", ("links.empty_anchor", "notice"): "list_contains(anchors, '')", ("links.generic_anchor", "notice"): "len(list_filter(anchors, lambda a: lower(a) IN ('here', 'more', 'this', 'link', 'view', 'go', 'click', 'details', 'ver', 'mais', 'aqui'))) > 0",
    ("social.og_missing", "notice"): "NOT regexp_matches(markup, 'property=\"og:', 'is')", ("social.twitter_missing", "info"): "NOT regexp_matches(markup, 'name=\"twitter:card\"', 'is')", ("structured.none", "notice"): "NOT regexp_matches(html, 'application/ld', 'is')",
    ("i18n.missing_lang", "warning"): "lang = ''", ("i18n.invalid_lang", "notice"): "lang <> '' AND NOT regexp_matches(lang, '^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$', 'i')",
    ("content.empty", "critical"): "words = 0", ("content.very_thin", "warning"): "words > 0 AND words < 100", ("content.thin", "notice"): "words >= 100 AND words < 300", ("content.low_text_ratio", "notice"): "words > 0 AND words < 300 AND length(text) < 0.10 * markup_bytes",
    ("technical.server_error", "critical"): "status >= 500", ("technical.client_error", "critical"): "status >= 400 AND status < 500", ("technical.not_https", "critical"): "scheme <> 'https'", ("technical.no_hsts", "notice"): "scheme = 'https'", ("technical.no_viewport", "critical"): "NOT regexp_matches(markup, 'name=\"viewport\"', 'is')",
    ("technical.no_charset", "warning"): "charset = ''", ("technical.ttfb_very_slow", "warning"): "ttfb_ms > 1800", ("technical.ttfb_slow", "notice"): "ttfb_ms > 800 AND ttfb_ms <= 1800", ("technical.no_compression", "warning"): "content_encoding = ''", ("technical.large_html", "notice"): "bytes > 150000",
    ("technical.no_cache_validators", "notice"): "true", ("technical.no_favicon", "notice"): "NOT regexp_matches(markup, '<link\\b', 'is')",
    ("url.too_long", "notice"): "length(url) > 115", ("url.too_deep", "notice"): "len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 4", ("url.uppercase", "notice"): "regexp_matches(path, '\\p{Lu}')", ("url.underscores", "notice"): "contains(path, '_')", ("url.many_parameters", "notice"): "len(list_filter(string_split(query, '&'), lambda s: s <> '')) > 2",
}
_APPEARANCE = "(regexp_matches(finding_id, '^(title|description|social|structured|canonical|url)\\.') OR finding_id LIKE 'i18n.hreflang%' OR finding_id IN ('content.thin', 'content.very_thin', 'content.low_text_ratio'))"
FINDINGS = f"""{O.DOCS}, f AS (SELECT *, {O.FETCHED} FROM d),
g AS ({" UNION ALL ".join(f"SELECT page_id, url, host, meta_robots, '{i}' AS finding_id, '{s}' AS severity FROM f WHERE {w}" for (i, s), w in _FIRES.items())}),
findings AS (SELECT page_id, url, host AS site, finding_id, severity, split_part(finding_id, '.', 1) AS category FROM g WHERE NOT (meta_robots = 'noindex' AND {_APPEARANCE}))"""


@query(f"WITH {FINDINGS} SELECT page_id, site, finding_id, severity, category FROM findings")
def page_findings(spark, sf_dir):
    return all_findings(spark, sf_dir).select("page_id", "site", "finding_id", "severity", "category")


@query(f"""WITH {FINDINGS} SELECT coalesce(severity, '') AS severity, coalesce(category, '') AS category, coalesce(finding_id, '') AS finding_id, count(*) AS findings, count(DISTINCT page_id) AS pages
  FROM findings GROUP BY GROUPING SETS ((), (severity), (category), (finding_id))""")
def findings_summary(spark, sf_dir):
    f = all_findings(spark, sf_dir).select("page_id", "severity", "category", "finding_id")
    sets = f.groupingSets([[], ["severity"], ["category"], ["finding_id"]], "severity", "category", "finding_id").agg(F.count("*").alias("findings"), F.count_distinct("page_id").alias("pages"))
    return sets.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("severity", "category", "finding_id")], "findings", "pages")


@query(f"""WITH {FINDINGS} SELECT site, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'notice') AS notice, count(*) FILTER (severity = 'info') AS info FROM findings GROUP BY site""")
def findings_by_host(spark, sf_dir):
    return all_findings(spark, sf_dir).groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])


@query(f"""WITH {FINDINGS}, c AS (SELECT url, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning FROM findings GROUP BY url)
  SELECT url, critical, warning, row_number() OVER (ORDER BY critical DESC, warning DESC, url) AS position FROM c ORDER BY critical DESC, warning DESC, url LIMIT 25""")
def worst_pages(spark, sf_dir):
    """The 25 pages of the report's table with the most serious findings; a top-k report."""
    c = all_findings(spark, sf_dir).groupBy("url").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))
    from pyspark.sql import Window as W

    top = c.orderBy(F.desc("critical"), F.desc("warning"), "url").limit(25)
    return top.withColumn("position", F.row_number().over(W.orderBy(F.desc("critical"), F.desc("warning"), "url")).cast("long"))


_LENS = "CASE " + " ".join(f"WHEN finding_id = '{k}' THEN '{' '.join(v)}'" for k, v in score.FINDING_LENSES.items()) + " " + " ".join(f"WHEN category = '{k}' THEN '{' '.join(v)}'" for k, v in score.CATEGORY_LENSES.items()) + " ELSE 'seo' END"


@query(f"WITH {FINDINGS} SELECT split_part({_LENS}, ' ', 1) AS lens, finding_id, count(*) AS findings, count(DISTINCT page_id) AS pages FROM findings GROUP BY ALL")
def findings_by_lens(spark, sf_dir):
    f = all_findings(spark, sf_dir).withColumn("lens", score.lenses(F.col("finding_id"), F.col("category"))[0])
    return f.groupBy("lens", "finding_id").agg(F.count("*").alias("findings"), F.count_distinct("page_id").alias("pages"))


def _points(d: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in d.items()) + " ELSE 1.0::DOUBLE END"


_EVALUATED = ", ".join(f"('{c}')" for c in score.evaluated())
SCORES = f"""{FINDINGS}, sites AS (SELECT host AS site, count(*) AS pages FROM u GROUP BY host), evaluated(category) AS (VALUES {_EVALUATED}),
k AS (SELECT site, category, finding_id, severity, count(DISTINCT url) AS affected FROM findings WHERE severity <> 'info' AND category IN (SELECT category FROM evaluated) GROUP BY ALL),
deductions AS (SELECT k.*, least(1.0::DOUBLE, affected::DOUBLE / pages) AS share, {_points(score.CATEGORY_POINTS, "severity")} * least(1.0::DOUBLE, affected::DOUBLE / pages) AS points, {_points(score.OVERALL_POINTS, "severity")} * least(1.0::DOUBLE, affected::DOUBLE / pages) * {_points(score.WEIGHTS, "category")} AS overall_points FROM k JOIN sites USING (site))"""


def _scored(spark, sf_dir):
    sites = S.fetched(spark, sf_dir).groupBy("site").agg(F.count("*").alias("pages"))
    return score.deductions(all_findings(spark, sf_dir), sites, by=["site"]), sites


@query(f"WITH {SCORES} SELECT site, category, finding_id, severity, affected AS affected_pages, round(share, 4) AS share, round(points, 2) AS points, round(overall_points, 2) AS overall_points FROM deductions")
def score_deductions(spark, sf_dir):
    found, _ = _scored(spark, sf_dir)
    return found.select("site", "category", "finding_id", "severity", "affected_pages", F.round("share", 4).alias("share"), F.round("points", 2).alias("points"), F.round("overall_points", 2).alias("overall_points"))


@query(f"""WITH {SCORES} SELECT site, pages, round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) AS overall,
  CASE WHEN round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) >= 90 THEN 'A' WHEN round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) >= 80 THEN 'B' WHEN round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) >= 70 THEN 'C'
  WHEN round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) >= 60 THEN 'D' WHEN round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) >= 50 THEN 'E' ELSE 'F' END AS grade FROM sites LEFT JOIN deductions USING (site) GROUP BY site, pages""")
def score_overall(spark, sf_dir):
    found, sites = _scored(spark, sf_dir)
    return score.overall(found, sites, by=["site"])


@query(f"""WITH {SCORES} SELECT site, category, round(greatest(0.0, 100.0 - coalesce(sum(points), 0.0)), 1) AS score, count(finding_id) AS issues FROM (SELECT site, category FROM sites, evaluated) LEFT JOIN deductions USING (site, category) GROUP BY site, category""")
def score_by_category(spark, sf_dir):
    found, sites = _scored(spark, sf_dir)
    return score.by_category(found, sites, by=["site"]).select("site", "category", "score", "issues")


@query(f"""WITH {SCORES} SELECT site, lens, round(greatest(0.0, 100.0 - coalesce(sum(overall_points), 0.0)), 1) AS score FROM (SELECT site, unnest(['seo', 'aio', 'performance']) AS lens FROM sites)
  LEFT JOIN (SELECT site, unnest(string_split({_LENS}, ' ')) AS lens, overall_points FROM deductions) USING (site, lens) GROUP BY site, lens""")
def score_by_lens(spark, sf_dir):
    found, sites = _scored(spark, sf_dir)
    return score.by_lens(found, sites, by=["site"])


CATEGORY_SCORES = f"{SCORES}, cs AS (SELECT site, category, round(greatest(0.0, 100.0 - coalesce(sum(points), 0.0)), 1) AS score FROM (SELECT site, category FROM sites, evaluated) LEFT JOIN deductions USING (site, category) GROUP BY site, category), t AS (SELECT min(site) AS target FROM sites)"


def _target(scores: DataFrame) -> str:
    return scores.agg(F.min("site")).first()[0]


@query(f"""WITH {CATEGORY_SCORES}, mine AS (SELECT category, score AS mine FROM cs, t WHERE site = target), ahead AS (SELECT cs.*, mine FROM cs JOIN mine USING (category), t WHERE site <> target AND score > mine + 5)
  SELECT category, mine, max(score) AS theirs, arg_max(site, (score, site)) AS rival, round(max(score) - mine, 1) AS difference FROM ahead GROUP BY category, mine""")
def category_gap(spark, sf_dir):
    found, sites = _scored(spark, sf_dir)
    scores = score.by_category(found, sites, by=["site"])
    return compare.category_gaps(scores, _target(sites)).withColumn("difference", F.round("difference", 1))


@query(f"""WITH {CATEGORY_SCORES}, mine AS (SELECT category, score AS mine FROM cs, t WHERE site = target), others AS (SELECT category, max(score) AS best_rival FROM cs, t WHERE site <> target GROUP BY category)
  SELECT category, mine, best_rival FROM mine JOIN others USING (category) WHERE mine > best_rival + 5""")
def strengths(spark, sf_dir):
    found, sites = _scored(spark, sf_dir)
    return compare.strengths(score.by_category(found, sites, by=["site"]), _target(sites))


# Addresses

@query(rf"""WITH {O.URLS}, q AS (SELECT page_id, scheme, host, path, list_sort(list_filter(string_split(query, '&'), lambda s: s <> '' AND NOT regexp_matches(lower(s), '^(utm_|pk_|mtm_|gclid=|fbclid=|ref_src=|ref_url=)'))) AS kept FROM u)
  SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS norm FROM q""")
def url_normalize(spark, sf_dir):
    return S.read(spark, sf_dir).select("page_id", U.normalize(F.col("url")).alias("norm"))


@query(f"WITH {O.URLS} SELECT page_id, scheme, host, regexp_replace(host, '^www\\.', '') AS base_host, path, query, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::INT AS depth FROM u")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return S.read(spark, sf_dir).select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.base_host(U.host(u)).alias("base_host"), U.path(u).alias("path"), U.query(u).alias("query"), U.path_depth(u).alias("depth"))


@query(rf"""WITH {O.URLS} SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported scheme' WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'off-site' WHEN regexp_matches(url, '/de/') THEN 'excluded by pattern' WHEN NOT regexp_matches(url, '/(en|fr)/') THEN 'not matched by include' ELSE '' END AS reason FROM u""")
def url_scope_reason(spark, sf_dir):
    return S.read(spark, sf_dir).select("page_id", U.reason_to_skip(F.col("url"), "https://www.example.com/", True, ["/(en|fr)/"], ["/de/"]).alias("reason"))


@query(f"WITH {O.URLS} SELECT host, regexp_extract(path, '^/[^/]*', 0) AS section, count(DISTINCT path || '?' || query) AS variants FROM u GROUP BY ALL HAVING count(DISTINCT path || '?' || query) >= 5")
def url_parameter_explosion(spark, sf_dir):
    sections = S.read(spark, sf_dir).select(F.concat(F.lit("https://"), U.host(F.col("url")), F.regexp_extract(U.path(F.col("url")), "^/[^/]*", 0), F.lit("?p="), F.md5(F.concat(U.path(F.col("url")), F.lit("?"), U.query(F.col("url"))))).alias("url"))
    return site.parameter_explosion(sections).select("host", F.col("path").alias("section"), "variants")


@query(f"""WITH {O.DOCS} SELECT page_id, pos::INT AS pos, scheme || '://' || host || hrefs[pos] AS target, anchors[pos] AS anchor FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS pos FROM d)""")
def link_extract(spark, sf_dir):
    d = H.document(S.read(spark, sf_dir), fields=("links",))
    return d.select("page_id", F.posexplode("doc.links").alias("p", "l")).select("page_id", (F.col("p") + 1).alias("pos"), F.col("l.url").alias("target"), F.col("l.anchor").alias("anchor"))


@query(f"""WITH {O.DOCS}, x AS (SELECT host, lower(anchors[pos]) AS a, hrefs[pos] AS h FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS pos FROM d))
  SELECT host AS site, count(*) AS links, round(count(*) FILTER (h LIKE '/%')::DOUBLE / count(*), 3) AS internal_share, count(*) FILTER (a IN ('here', 'more', 'this', 'link', 'view', 'go', 'click', 'details', 'ver', 'mais', 'aqui')) AS generic FROM x GROUP BY host""")
def link_shares(spark, sf_dir):
    d = H.document(S.read(spark, sf_dir), fields=("links",))
    links = d.select(U.host(F.col("url")).alias("site"), F.explode("doc.links").alias("l"))
    return links.groupBy("site").agg(F.count("*").alias("links"), compare.share(F.col("l.internal")).alias("internal_share"), F.count_if(rules.generic_anchor(F.col("l"))).alias("generic"))


# Hosts

METRICS = f"""{O.DOCS}, f AS (SELECT *, {O.FETCHED} FROM d),
metrics AS (SELECT host AS site, count(*) AS pages_crawled, round(coalesce(median(words), 0), 1) AS median_words, round(count(*) FILTER (words < 300)::DOUBLE / count(*), 3) AS thin_share, round(count(*) FILTER (titles[1] = '')::DOUBLE / count(*), 3) AS missing_title_share,
  round(coalesce(median(length(titles[1])) FILTER (titles[1] <> ''), 0), 1) AS median_title_length, round(sum(len(hrefs))::DOUBLE / count(*), 1) AS links_per_page, round(count(*) FILTER (scheme = 'https')::DOUBLE / count(*), 3) AS https_share,
  round(count(*) FILTER (content_encoding <> '')::DOUBLE / count(*), 3) AS compression_share, round(median(ttfb_ms), 1) AS median_ttfb_ms, round(median(bytes / 1024.0), 1) AS median_html_kb FROM f GROUP BY host)"""
_METRIC_NAMES = ("pages_crawled", "median_words", "thin_share", "missing_title_share", "median_title_length", "links_per_page", "https_share", "compression_share", "median_ttfb_ms", "median_html_kb")


def _metrics(spark, sf_dir):
    d = H.document(S.fetched(spark, sf_dir).withColumn("http_version", F.lit("")), fields=("word_count", "title", "description", "links", "bytes", "json_ld"))
    rows = d.select("site", F.col("doc.word_count").alias("words"), "doc.title", "doc.description", F.size("doc.links").alias("links"), F.lit(0).alias("inlinks"), F.lit(0).alias("depth"), F.lit(False).alias("orphan"), (U.scheme(F.col("url")) == "https").alias("https"), F.coalesce(F.try_element_at("headers", F.lit("content-encoding")), F.lit("")).alias("encoding"), "http_version", "ttfb_ms", F.col("doc.bytes").alias("bytes"), F.size("doc.json_ld").alias("schema"))
    return compare.site_metrics(rows).select("site", *_METRIC_NAMES)


@query(f"WITH {METRICS} SELECT * FROM metrics")
def host_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(f"""WITH {METRICS}, long AS ({" UNION ALL ".join(f"SELECT site, '{m}' AS metric, {m}::DOUBLE AS value, {str(dict((x[0], x[2]) for x in compare.METRICS)[m]).lower()} AS higher FROM metrics" for m in _METRIC_NAMES)}), w AS (SELECT *, max(value) OVER (PARTITION BY metric) AS hi, min(value) OVER (PARTITION BY metric) AS lo FROM long)
  SELECT site, metric, value, hi <> lo AND value = CASE WHEN higher THEN hi ELSE lo END AS best FROM w""")
def host_metric_table(spark, sf_dir):
    return compare.metric_table(_metrics(spark, sf_dir))


# Duplicates

@query(f"WITH {O.DOCS} SELECT trim(titles[1]) AS value, count(*) AS members, count(DISTINCT url) AS distinct_pages, min(url) AS first FROM d WHERE trim(titles[1]) <> '' GROUP BY 1 HAVING count(DISTINCT url) > 1")
def duplicate_titles(spark, sf_dir):
    return duplicates.groups(H.document(S.read(spark, sf_dir), fields=("title",)).select("url", F.col("doc.title").alias("title")), "title")


@query(f"WITH {O.DOCS} SELECT trim(h1s[1]) AS value, count(*) AS members, count(DISTINCT host) AS distinct_pages, min(url) AS first FROM d WHERE trim(h1s[1]) <> '' GROUP BY 1 HAVING count(DISTINCT host) > 1")
def duplicate_h1_collapsed(spark, sf_dir):
    """First headings that several clusters share; a host stands for a cluster."""
    return duplicates.groups(H.document(S.read(spark, sf_dir), fields=("h1s",)).select("url", F.get("doc.h1s", 0).alias("h1"), U.host(F.col("url")).alias("cluster")), "h1", cluster="cluster")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_NORM = r"md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
SKETCH = rf"""w AS (SELECT doc_id AS key, {_NORM} AS content_hash, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
sk AS (SELECT key, content_hash, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 2, 2)), lambda i: substr(md5(array_to_string(words[i:i+3], ' ')), 1, 16))))[1:128] AS sketch FROM w WHERE len(words) >= 25)"""


@query(rf"WITH w AS (SELECT doc_id AS key, {_NORM} AS content_hash, {_WORDS} AS words FROM documents) SELECT content_hash, count(*) AS members, min(key) AS first FROM w WHERE len(words) >= 25 GROUP BY content_hash HAVING count(*) > 1")
def duplicate_content_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return duplicates.content_groups(docs, key="doc_id").select("content_hash", "members", "first")


@query(f"WITH {SKETCH} SELECT key, content_hash, len(sketch)::INT AS n, sketch[1] AS least, sketch[-1] AS greatest, md5(array_to_string(sketch, ',')) AS digest FROM sk")
def doc_sketch(spark, sf_dir):
    s = duplicates.sketches(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return s.select("key", "content_hash", F.size("sketch").alias("n"), F.get("sketch", 0).alias("least"), F.element_at("sketch", -1).alias("greatest"), F.md5(F.array_join("sketch", ",")).alias("digest"))


PAIRS = f"""{SKETCH}, one AS (SELECT min(key) AS key, arg_min(sketch, key) AS sketch FROM sk GROUP BY content_hash), h AS (SELECT key, unnest(sketch) AS hash FROM one),
c AS (SELECT x.key AS a, y.key AS b FROM h x JOIN h y ON x.hash = y.hash AND x.key < y.key GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT a, b, p.sketch AS sa, q.sketch AS sb, list_sort(list_distinct(list_concat(p.sketch, q.sketch)))[1:128] AS u FROM c JOIN one p ON p.key = a JOIN one q ON q.key = b),
pairs AS (SELECT a, b, len(list_intersect(u, list_intersect(sa, sb)))::DOUBLE / len(u) AS similarity FROM s WHERE len(list_intersect(u, list_intersect(sa, sb)))::DOUBLE / len(u) >= 0.6)"""


@query(f"WITH {PAIRS} SELECT a, b, round(similarity, 4) AS similarity FROM pairs")
def near_duplicate_pairs(spark, sf_dir):
    pairs = duplicates.near_pairs(duplicates.sketches(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
    return pairs.withColumn("similarity", F.round("similarity", 4))


@query(f"""WITH RECURSIVE {PAIRS}, both_ways AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), r(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, l.y FROM r JOIN both_ways l ON r.y = l.x)
  SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def near_duplicate_clusters(spark, sf_dir):
    return duplicates.near_clusters(duplicates.sketches(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
