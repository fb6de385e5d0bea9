"""Queries over a crawl: link graph, redirects, robots, sitemaps, technologies, runs, cache, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.functions import urls as U
from webassay.operators import compare, graph, robots, rules, sitemap, technology
from webassay.plans import oracle as O
from webassay.plans.registry import query
from webassay.session import checkpoint
from webassay.sources import pages as S
from webassay.streaming import rates

def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The derived link graph of the pages table: nodes and distinct edges without loops."""
    pages = S.read(spark, sf_dir).select("page_id")
    n = pages.count()
    first = pages.where("page_id % 5 <> 0").select(F.col("page_id").alias("src"), F.expr(f"(page_id * 7 + 1) % {n}").alias("dst"))
    second = pages.where("page_id % 3 <> 0").select(F.col("page_id").alias("src"), F.expr(f"(page_id * 13 + 5) % {n}").alias("dst"))
    edges = checkpoint(first.unionByName(second).where("src <> dst").distinct())
    return pages.withColumnRenamed("page_id", "node"), edges


#: Each step of the recursion sees the ranks of the round before; it ends as the operator does.
RANKS = f"""{O.EDGES}, deg AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src),
every_round(round, node, rank, old) AS (SELECT 0, page_id, 1.0::DOUBLE / (SELECT n FROM n), 1e9::DOUBLE FROM pages UNION ALL
  SELECT r.round + 1, r.node, 0.15 / (SELECT n FROM n) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM every_round WHERE node NOT IN (SELECT src FROM e)) / (SELECT n FROM n) + 0.85 * coalesce(g.got, 0), r.rank
  FROM every_round r LEFT JOIN (SELECT dst, sum(rank / k) AS got FROM every_round JOIN deg ON src = node JOIN e USING (src) GROUP BY dst) g ON g.dst = r.node
  WHERE (SELECT sum(abs(rank - old)) FROM every_round) >= {graph.CONVERGED}),
ranks AS (SELECT node, round(rank, 6) AS pagerank FROM every_round WHERE round = (SELECT max(round) FROM every_round))"""
DEPTHS = "depths(node, depth) USING KEY (node) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, min(d.depth) + 1 FROM depths d JOIN e ON e.src = d.node WHERE e.dst NOT IN (SELECT node FROM recurring.depths) GROUP BY e.dst)"


@query(f"WITH RECURSIVE {RANKS} SELECT node, pagerank FROM ranks")
def pagerank(spark, sf_dir):
    return graph.pagerank(*_graph(spark, sf_dir)).select("node", F.round("pagerank", 6).alias("pagerank"))


@query(f"WITH RECURSIVE {RANKS} SELECT node, pagerank FROM ranks ORDER BY pagerank DESC, node LIMIT 10")
def pagerank_top(spark, sf_dir):
    ranks = graph.pagerank(*_graph(spark, sf_dir)).select("node", F.round("pagerank", 6).alias("pagerank"))
    return graph.top(ranks)


@query(f"WITH RECURSIVE {O.EDGES}, {DEPTHS} SELECT node, depth FROM depths")
def click_depth(spark, sf_dir):
    """The search runs until no page is new."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.click_depth(nodes, edges, root=1)


@query(f"WITH {O.EDGES} SELECT page_id AS node, page_id NOT IN (SELECT dst FROM e) AS orphan, page_id NOT IN (SELECT src FROM e) AS dead_end FROM pages WHERE (page_id <> 1 AND page_id NOT IN (SELECT dst FROM e)) OR page_id NOT IN (SELECT src FROM e)")
def orphans_and_dead_ends(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    marked = nodes.join(edges.select(F.col("dst").alias("node")).distinct().withColumn("into", F.lit(True)), "node", "left").join(edges.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True)), "node", "left")
    return marked.select("node", F.col("into").isNull().alias("orphan"), F.col("out").isNull().alias("dead_end")).where("(node <> 1 and orphan) or dead_end")


@query(f"""WITH RECURSIVE {RANKS}, {DEPTHS},
  per AS (SELECT page_id AS node, pagerank, depth, (SELECT count(*) FROM e WHERE dst = page_id) AS inlinks, (SELECT count(*) FROM e WHERE src = page_id) AS outlinks FROM pages LEFT JOIN depths ON depths.node = page_id JOIN ranks r ON r.node = page_id),
  ordered AS (SELECT list_sort(list(pagerank)) AS l FROM per)
  SELECT count(*) AS nodes, sum(outlinks)::BIGINT AS edges, count(*) FILTER (inlinks = 0 AND node <> 1) AS orphans, count(*) FILTER (depth IS NULL) AS unreachable, count(*) FILTER (outlinks = 0) AS dead_ends, max(depth) AS max_click_depth,
  round(max(pagerank) / (SELECT l[(len(l) // 2 + 1)::INT] FROM ordered), 2) AS authority_spread FROM per""")
def graph_summary(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    per = graph.metrics(nodes, edges, graph.pagerank(nodes, edges), graph.click_depth(nodes, edges, root=1))
    return graph.summary(checkpoint(per), 1)


_SPARSE = "SELECT page_id AS src, page_id + 3 AS dst FROM pages WHERE page_id % 7 < 3 AND page_id + 3 IN (SELECT page_id FROM pages)"


@query(f"WITH RECURSIVE s AS ({_SPARSE}), l AS (SELECT src AS x, dst AS y FROM s UNION ALL SELECT dst, src FROM s), r(x, y) AS (SELECT page_id, page_id FROM pages UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x) SELECT x AS node, min(y) AS component FROM r GROUP BY x")
def connected_components(spark, sf_dir):
    pages = S.read(spark, sf_dir).select("page_id")
    ids = pages.select((F.col("page_id") - 3).alias("page_id"))
    edges = pages.where("page_id % 7 < 3").join(ids, "page_id", "left_semi").select(F.col("page_id").alias("src"), (F.col("page_id") + 3).alias("dst"))
    return graph.components(pages.withColumnRenamed("page_id", "node"), edges)


@query("WITH RECURSIVE h AS (SELECT page_id AS url, page_id // 2 AS final FROM pages WHERE page_id % 4 = 0 AND page_id > 0), w(url, spot, k) AS (SELECT url, final, 1 FROM h UNION ALL SELECT w.url, h.final, k + 1 FROM w JOIN h ON h.url = w.spot) SELECT url, arg_max(spot, k) AS final FROM w GROUP BY url")
def redirect_resolution(spark, sf_dir):
    """Chains of redirects (each fourth page lands on half its number) followed to their end."""
    hops = S.read(spark, sf_dir).where("page_id % 4 = 0 and page_id > 0").select(F.col("page_id").alias("url"), F.expr("page_id div 2").alias("final"))
    return graph.resolve_redirects(hops)


_ALT = "SELECT page_id, page_id // 4 AS g, page_id % 4 AS i FROM pages"


@query(f"""WITH RECURSIVE a AS ({_ALT}), declared AS (SELECT x.page_id AS src, y.page_id AS dst FROM a x JOIN a y USING (g) WHERE x.page_id <> y.page_id AND NOT (x.i = 3 AND x.g % 2 = 0)), edges AS (SELECT d.src, d.dst FROM declared d JOIN declared b ON b.src = d.dst AND b.dst = d.src),
  r(x, y) AS (SELECT src, src FROM edges UNION SELECT r.x, e.dst FROM r JOIN edges e ON e.src = r.y) SELECT x AS page, min(y) AS cluster FROM r GROUP BY x""")
def lang_alternate_clusters(spark, sf_dir):
    """Groups of four pages that name each other; in each other group the last doesn't return it."""
    a = S.read(spark, sf_dir).selectExpr("page_id", "page_id div 4 as g", "page_id % 4 as i")
    name = lambda c: F.concat(F.lit("https://a.example/"), F.lpad(c.cast("string"), 9, "0"))
    pairs = a.alias("x").join(a.alias("y"), F.expr("x.g = y.g and not (x.i = 3 and x.g % 2 = 0 and x.page_id <> y.page_id)"))
    alternates = pairs.groupBy(F.col("x.page_id").alias("page_id")).agg(F.collect_list(F.struct(F.concat(F.lit("l"), F.col("y.i").cast("string")).alias("lang"), name(F.col("y.page_id")).alias("url"))).alias("hreflangs"))
    rows = alternates.select(name(F.col("page_id")).alias("url"), "hreflangs")
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    return graph.hreflang_clusters(rows).select(number(F.col("url")).alias("page"), number(F.col("cluster")).alias("cluster"))


# Links, sitemaps, arrivals

_PAGES = f"f AS (SELECT page_id, url, {O.FETCHED} FROM pages)"


@query(f"WITH {O.EDGES}, {_PAGES} SELECT e.dst AS target, status, count(DISTINCT e.src) AS sources FROM e JOIN f ON f.page_id = e.dst WHERE status >= 400 GROUP BY ALL")
def broken_links(spark, sf_dir):
    from webassay.operators import site

    _, edges = _graph(spark, sf_dir)
    address = lambda c: F.concat(F.lit("https://s.example/"), c.cast("string"))
    pages = S.fetched(spark, sf_dir).select("page_id", address(F.col("page_id")).alias("url"), "status", F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("redirects"))
    found = site.link_targets(pages, edges.select(address(F.col("src")).alias("url"), address(F.col("dst")).alias("target")))
    return found.where("status >= 400").select(F.regexp_extract("target", "([0-9]+)$", 1).cast("long").alias("target"), "status", "sources")


@query(f"WITH {_PAGES} SELECT page_id, status >= 400 AS broken, meta_robots = 'noindex' AS noindexed FROM f WHERE page_id % 2 = 0")
def sitemap_entry_status(spark, sf_dir):
    from webassay.operators import site

    pages = rules.with_defaults(S.fetched(spark, sf_dir).withColumn("url", F.concat(F.lit("https://s.example/"), F.col("page_id").cast("string"))))
    listed = site.listed(pages, pages.where("page_id % 2 = 0").select("url"))
    return listed.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "broken", "noindexed")


@query(r"WITH x AS (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) || regexp_extract(url, '^[^:]+://[^/?#]*(/[^/?#]*)', 1) AS final FROM pages), m AS (SELECT final, min(page_id) AS first FROM x GROUP BY final) SELECT page_id, CASE WHEN first <> page_id THEN first END AS duplicate_of FROM x JOIN m USING (final)")
def first_arrival_dedup(spark, sf_dir):
    """Pages that land where an earlier one did (host and first segment), with the first."""
    final = F.concat(U.host(F.col("url")), F.regexp_extract(U.path(F.col("url")), "^/[^/]*", 0))
    return compare.first_arrivals(S.read(spark, sf_dir), final, "page_id").select("page_id", "duplicate_of")


@query(rf"""WITH {O.URLS}, c AS (SELECT min(page_id % 6) AS depth, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS norm FROM u WHERE query = '' GROUP BY ALL), s AS (SELECT DISTINCT scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS norm FROM u WHERE query = '' AND page_id % 10 = 0),
  j AS (SELECT norm, depth, CASE WHEN norm IN (SELECT norm FROM s) THEN 'seen' WHEN depth > 4 THEN 'too deep' WHEN NOT (split_part(split_part(norm, '://', 2), '/', 1) = 'example.com' OR split_part(split_part(norm, '://', 2), '/', 1) LIKE '%.example.com') THEN 'off-site' ELSE '' END AS reason FROM c),
  k AS (SELECT norm FROM j WHERE reason = '' ORDER BY depth, norm LIMIT 20) SELECT CASE WHEN reason = '' AND norm NOT IN (SELECT norm FROM k) THEN 'over budget' ELSE reason END AS reason, count(*) AS urls FROM j GROUP BY 1""")
def frontier_admission(spark, sf_dir):
    pages = S.read(spark, sf_dir).where(U.query(F.col("url")) == "")
    seen = pages.where("page_id % 10 = 0").select(U.normalize(F.col("url")).alias("norm"))
    out = sitemap.admit(pages.select("url", (F.col("page_id") % 6).alias("depth")), seen, "https://example.com", 4, 20, include_subdomains=True)
    return out.groupBy("reason").agg(F.count("*").alias("urls"))


# robots.txt

ROBOTS = "User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*?utm_\nDisallow: /fr/2*3$\n\nUser-agent: googlebot\nUser-agent: bingbot\nDisallow: /es/\nCrawl-delay: 2\nSitemap: https://x.example/map.xml\n\nUser-agent: gptbot\nDisallow: /\n"
_LIT = ROBOTS.replace("'", "''")
_RULES = "r(grp, allow, pattern, spec) AS (VALUES (1, false, '^/de/', 4), (1, true, '^/de/1', 5), (1, false, '^/.*\\?utm_', 7), (1, false, '^/fr/2.*3$', 8), (2, false, '^/es/', 4), (3, false, '^/', 1)), c(crawler, grp) AS (VALUES ('googlebot', 2), ('bingbot', 2), ('gptbot', 3), ('duckduckbot', 1))"


def _files(spark, sf_dir):
    return S.read(spark, sf_dir).select(U.host(F.col("url")).alias("host")).distinct().withColumn("body", F.lit(ROBOTS))


def _crawlers(spark):
    return spark.createDataFrame([(c,) for c in ("googlebot", "bingbot", "gptbot", "duckduckbot")], "crawler string")


_ACCESS = rf"""{O.URLS}, {_RULES}, t AS (SELECT DISTINCT url, host, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS target FROM u),
  m AS (SELECT t.url, t.host, c.crawler, arg_max(allow, (spec, allow)) AS allow FROM t CROSS JOIN c LEFT JOIN r ON r.grp = c.grp AND regexp_matches(t.target, r.pattern) GROUP BY ALL)"""


@query(f"WITH {_ACCESS} SELECT url, crawler, coalesce(allow, true) AS allowed FROM m")
def robots_allowed(spark, sf_dir):
    return robots.allowed(_files(spark, sf_dir), _crawlers(spark), S.read(spark, sf_dir))


@query(f"WITH {_ACCESS} SELECT host, crawler, count(*) FILTER (coalesce(allow, true)) AS allowed, count(*) FILTER (NOT coalesce(allow, true)) AS refused FROM m GROUP BY host, crawler")
def crawler_access_matrix(spark, sf_dir):
    access = robots.allowed(_files(spark, sf_dir), _crawlers(spark), S.read(spark, sf_dir))
    return access.groupBy(U.host(F.col("url")).alias("host"), "crawler").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


_HEADERS = "CASE page_id % 4 WHEN 0 THEN 'nginx/1.' || (page_id % 9) WHEN 1 THEN 'Apache' WHEN 2 THEN 'cloudflare' ELSE '' END"
_POWERED = "CASE WHEN page_id % 5 = 0 THEN 'PHP/8.' || (page_id % 3) WHEN page_id % 5 = 1 THEN 'Next.js' ELSE '' END"
_GENERATOR = "CASE WHEN page_id % 6 = 0 THEN 'WordPress 6.' || (page_id % 4) ELSE '' END"


def _technical(spark, sf_dir):
    """Pages of the table with headers and a generator made from their number."""
    pages = S.read(spark, sf_dir).select("page_id", F.concat(F.lit("https://s.example/"), F.col("page_id").cast("string")).alias("url"), F.when(F.expr(_GENERATOR) != "", F.concat(F.lit('<html><head><meta name="generator" content="'), F.expr(_GENERATOR), F.lit('"></head><body><p>text</p></body></html>'))).otherwise("<html><body><p>text</p></body></html>").alias("html"),
                                          F.map_filter(F.create_map(F.lit("server"), F.expr(_HEADERS), F.lit("x-powered-by"), F.expr(_POWERED)), lambda k, v: v != "").alias("headers"))
    return rules.with_defaults(pages)


_TECH = f"""raw AS (SELECT page_id, {_HEADERS} AS server, {_POWERED} AS powered, {_GENERATOR} AS generator FROM pages),
direct AS (SELECT page_id, 'nginx' AS technology, 'server' AS category, 1.0::DOUBLE AS confidence, split_part(server, '/', 2) AS version FROM raw WHERE server LIKE 'nginx%' UNION ALL SELECT page_id, 'Apache', 'server', 1.0, '' FROM raw WHERE server = 'Apache' UNION ALL SELECT page_id, 'Cloudflare', 'cdn', 1.0, '' FROM raw WHERE server = 'cloudflare'
  UNION ALL SELECT page_id, 'PHP', 'language', 1.0, split_part(powered, '/', 2) FROM raw WHERE powered LIKE 'PHP/%' UNION ALL SELECT page_id, 'Next.js', 'framework', 1.0, '' FROM raw WHERE powered = 'Next.js' UNION ALL SELECT page_id, 'WordPress', 'cms', 1.0, split_part(generator, ' ', 2) FROM raw WHERE generator <> '')"""


@query(f"WITH {_TECH} SELECT page_id, technology, category, confidence, version FROM direct")
def tech_detect(spark, sf_dir):
    shown = technology.combine(technology.signals(_technical(spark, sf_dir)), ["url"])
    return shown.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "technology", "category", "confidence", "version")


@query(f"""WITH {_TECH}, implied AS (SELECT page_id, 'PHP' AS technology, 'language' AS category, 0.9::DOUBLE AS confidence, '' AS version, 'WordPress' AS implied_by FROM direct WHERE technology = 'WordPress' UNION ALL SELECT page_id, 'React', 'framework', 0.9, '', 'Next.js' FROM direct WHERE technology = 'Next.js'),
  a AS (SELECT page_id, technology, category, confidence, version, '' AS implied_by FROM direct UNION ALL SELECT * FROM implied) SELECT page_id, technology, category, max(confidence) AS confidence, max(version) AS version, CASE WHEN bool_or(implied_by = '') THEN '' ELSE max(implied_by) END AS implied_by FROM a GROUP BY page_id, technology, category""")
def tech_implied(spark, sf_dir):
    found = technology.detect(_technical(spark, sf_dir), ["url"])
    return found.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "technology", "category", "confidence", "version", "implied_by")


@query(f"WITH {_TECH}, s AS (SELECT DISTINCT 'host' || (page_id % 4) AS site, technology AS label FROM direct) SELECT label, string_agg(site, ',' ORDER BY site) AS rivals FROM s WHERE site <> 'host3' AND label NOT IN (SELECT label FROM s WHERE site = 'host3') GROUP BY label")
def tech_gap(spark, sf_dir):
    found = tech_detect(spark, sf_dir).select(F.concat(F.lit("host"), (F.col("page_id") % 4).cast("string")).alias("site"), F.col("technology").alias("label")).distinct()
    return compare.gaps(found, "host3")


# Runs and cache

_RUN = "SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END AS severity, 'rule.' || (page_id % 11) AS finding_id, 'u' || (page_id % 40) AS url FROM pages WHERE page_id % 2 = {p} OR page_id % 5 = 0"


def _run(spark, sf_dir, p):
    return S.read(spark, sf_dir).where(f"page_id % 2 = {p} or page_id % 5 = 0").selectExpr("case page_id % 3 when 0 then 'critical' when 1 then 'warning' else 'notice' end as severity", "concat('rule.', page_id % 11) as finding_id", "concat('u', page_id % 40) as url")


@query(f"SELECT * FROM ({_RUN.format(p=1)}) EXCEPT SELECT * FROM ({_RUN.format(p=0)})")
def run_diff_introduced(spark, sf_dir):
    return compare.run_diff(_run(spark, sf_dir, 1), _run(spark, sf_dir, 0))[0]


@query(f"SELECT * FROM ({_RUN.format(p=0)}) EXCEPT SELECT * FROM ({_RUN.format(p=1)})")
def run_diff_resolved(spark, sf_dir):
    return compare.run_diff(_run(spark, sf_dir, 1), _run(spark, sf_dir, 0))[1]


@query("WITH r AS (SELECT 'site' || (page_id % 9) AS target, page_id AS run_id, ((page_id * 17) % 101)::DOUBLE AS score FROM pages), w AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY run_id DESC) AS rank, round(score - lead(score) OVER (PARTITION BY target ORDER BY run_id DESC), 1) AS score_change FROM r) SELECT target, run_id, score, rank::INT AS rank, score_change FROM w WHERE rank <= 2")
def latest_two_runs(spark, sf_dir):
    runs = S.read(spark, sf_dir).selectExpr("concat('site', page_id % 9) as target", "page_id as run_id", "cast((page_id * 17) % 101 as double) as score")
    return compare.latest_runs(runs)


@query("WITH a AS (SELECT event_id, user_id AS url, ts AS stored_at, CASE WHEN event_id % 7 = 0 THEN 500 WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN event_id % 11 = 0 THEN 'private' ELSE 'max-age=60' END AS cc FROM events), k AS (SELECT * FROM a WHERE status IN (200, 203, 301, 308, 404, 410) AND cc <> 'private') SELECT url, max(stored_at) AS stored_at, max(stored_at) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY AS fresh FROM k GROUP BY url")
def cache_freshness(spark, sf_dir):
    answers = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as url", "ts as stored_at", "case when event_id % 7 = 0 then 500 when event_id % 5 = 0 then 404 else 200 end as status", "map('cache-control', case when event_id % 11 = 0 then 'private' else 'max-age=60' end) as headers", "100 as size")
    empty = answers.limit(0).select("url", "stored_at")
    cache = S.upsert(empty, answers)
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return cache.select("url", "stored_at", (F.unix_timestamp(now) - F.unix_timestamp("stored_at") < 86400).alias("fresh"))


# Vitals and rendering, made from the page's number

_VITALS = "page_id, (page_id * 131) % 6000 AS lcp_ms, ((page_id * 7) % 50) / 100.0 AS cls, (page_id * 37) % 2500 AS ttfb_ms"


@query(f"""WITH v AS (SELECT {_VITALS} FROM pages), l AS (SELECT page_id, 'lcp' AS metric, lcp_ms::DOUBLE AS x, 2500::DOUBLE AS good, 4000::DOUBLE AS poor, true AS core FROM v UNION ALL SELECT page_id, 'cls', cls::DOUBLE, 0.1, 0.25, true FROM v UNION ALL SELECT page_id, 'ttfb', ttfb_ms::DOUBLE, 800, 1800, false FROM v)
  SELECT page_id, 'vitals.' || metric AS finding_id, CASE WHEN core AND x > poor THEN 'warning' ELSE 'notice' END AS severity FROM l WHERE x > good""")
def vitals_findings(spark, sf_dir):
    v = S.read(spark, sf_dir).selectExpr("cast(page_id as string) as url", *[x.strip() for x in ("(page_id * 131) % 6000 AS lcp_ms", "((page_id * 7) % 50) / 100.0 AS cls", "(page_id * 37) % 2500 AS ttfb_ms")])
    return rules.vitals_findings(v).select(F.col("url").cast("long").alias("page_id"), "finding_id", "severity")


# Events

@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rate_windows(spark, sf_dir):
    return rates.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    return rates.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "30 minutes")


#: Requests of hosts derived from events, in order, and the chain of their states one request after the other.
PACED = """WITH RECURSIVE q AS (SELECT 'host' || (user_id % 20) AS host, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 97 = 0 THEN 'blocked' ELSE 'ok' END AS outcome, ((event_id * 37) % 5000)::DOUBLE AS ms FROM events),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS i FROM q),
r(host, i, delay, blocks, errors, fine, tripped, ms) AS (
  SELECT host, 0::BIGINT, 0.25::DOUBLE, 0, 0, 0, false, []::DOUBLE[] FROM (SELECT DISTINCT host FROM o)
  UNION ALL
  SELECT host, i, CASE WHEN outcome = 'ok' AND slow OR outcome = 'error' AND errors > 0 THEN least(30, greatest(delay, 0.25) * 1.5) WHEN outcome = 'blocked' THEN least(30, greatest(delay, 0.25) * 2) WHEN eased THEN greatest(0.25, delay * 0.8) ELSE delay END,
    CASE outcome WHEN 'ok' THEN 0 WHEN 'blocked' THEN blocks + 1 ELSE blocks END, CASE outcome WHEN 'ok' THEN 0 WHEN 'error' THEN errors + 1 ELSE errors END,
    CASE WHEN outcome <> 'ok' OR eased THEN 0 ELSE fine + 1 END, tripped OR outcome = 'blocked' AND blocks >= 4, kept
  FROM (SELECT *, outcome = 'ok' AND NOT slow AND fine >= 4 AND delay > 0.25 AS eased FROM (SELECT *, len(kept) >= 5 AND list_sort(kept)[len(kept) // 2 + 1] > 3000 AS slow
    FROM (SELECT r.* EXCLUDE (i, ms), o.i, o.outcome, CASE WHEN o.outcome = 'ok' THEN list_append(r.ms, o.ms)[-10:] ELSE r.ms END AS kept FROM r JOIN o ON o.host = r.host AND o.i = r.i + 1))))
SELECT host, round(delay, 6) AS delay, blocks, errors, tripped, i AS requests FROM r QUALIFY row_number() OVER (PARTITION BY host ORDER BY i DESC) = 1"""


@query(PACED)
def host_backoff_state(spark, sf_dir):
    """Delay and breaker of each host after its requests in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('host', user_id % 20) as host", "event_id as seq", "case when event_type = 'error' then 'error' when event_id % 97 = 0 then 'blocked' else 'ok' end as outcome", "cast((event_id * 37) % 5000 as double) as ttfb_ms")
    return rates.host_states(events)
