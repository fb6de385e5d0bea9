import gzip
import json
import os
import random
import re
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from webassay.functions import text as T
from webassay.operators import catalogue, compare, duplicates, graph, robots, rules, score, site, sitemap, structured, technology
from webassay.plans import crawl, job, report
from webassay.settings import Settings
from webassay.sources import http
from webassay.sources import pages as S
from webassay.streaming.rates import Pace, host_states

import cases


def test_pagerank_sums_to_one_and_orders(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "b"), ("b", "a")], "src string, dst string")
    got = {r.node: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-6) and max(got, key=got.get) == "b"
    assert {r.node: r.depth for r in graph.click_depth(nodes, edges, "a").collect()} == {"a": 0, "b": 1}
    assert {r.node for r in graph.orphans(nodes, edges, "a").collect()} == {"c", "d"}


def test_click_depth_has_no_bound(spark):
    nodes = spark.createDataFrame([(i,) for i in range(64)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(62)] + [(60, 3)], "src long, dst long")
    assert {r.node: r.depth for r in graph.click_depth(nodes, edges, 0).collect()} == {i: i for i in range(63)}


def derived(spark, sf_dir):
    """The pages and links of the derived graph, in plain Python."""
    ids = [r.page_id for r in S.read(spark, sf_dir).select("page_id").collect()]
    n = len(ids)
    return ids, {(p, q) for p in ids for q, m in (((p * 7 + 1) % n, 5), ((p * 13 + 5) % n, 3)) if p % m and q != p}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_click_depth_query_against_plain_search(spark):
    _, edges = derived(spark, "/root/testdata/sf0.01")
    want, edge = {1: 0}, {1}
    while edge:
        edge = {b for a, b in edges if a in edge} - set(want)
        want |= dict.fromkeys(edge, max(want.values()) + 1)
    got = {r.node: r.depth for r in crawl.click_depth(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and max(got.values()) > 14


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pagerank_queries_against_plain_iteration(spark):
    ids, edges = derived(spark, "/root/testdata/sf0.001")
    n, out = len(ids), {p: [b for a, b in edges if a == p] for p in ids}
    rank, gap = dict.fromkeys(ids, 1 / n), 1.0
    for _ in range(60):
        base = (0.15 + 0.85 * sum(rank[p] for p in ids if not out[p])) / n
        new = dict.fromkeys(ids, base)
        for p in ids:
            for q in out[p]:
                new[q] += 0.85 * rank[p] / len(out[p])
        gap, rank = sum(abs(new[p] - rank[p]) for p in ids), new
        if gap < 1e-6:
            break
    got = {r.node: r.pagerank for r in crawl.pagerank(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == rank.keys() and max(abs(got[p] - rank[p]) for p in ids) < 6e-7
    first = sorted(got, key=lambda p: (-got[p], p))[:10]
    assert [(r.node, r.pagerank) for r in crawl.pagerank_top(spark, "/root/testdata/sf0.001").collect()] == [(p, got[p]) for p in first]


def test_redirects_and_cycles(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, final string")
    got = {r.url: r.final for r in graph.resolve_redirects(hops).collect()}
    assert got["a"] == got["b"] == "c" and (got["x"], got["y"]) == ("x", "y")
    r = random.Random(3)
    hops = {f"n{i}": f"n{r.randrange(80)}" for i in range(60)}

    def chase(at):
        seen = set()
        while at in hops and at not in seen and hops[at] != at:
            seen.add(at)
            at = hops[at]
        return at

    rows = graph.resolve_redirects(spark.createDataFrame(list(hops.items()), "url string, final string")).collect()
    assert {x.url: x.final for x in rows} == {k: chase(k) for k, v in hops.items() if v != k}


def test_hreflang_needs_reciprocity_unless_unknown(spark):
    a, b, c, z = (f"https://e.example/{x}" for x in "abcz")
    rows = [(a, [("en", a), ("de", b), ("fr", c), ("x-default", a)]), (b, [("en", a)]), (c, [("it", z)])]
    got = {r.url: r.cluster for r in graph.hreflang_clusters(spark.createDataFrame(rows, "url string, hreflangs array<struct<lang:string,url:string>>")).collect()}
    assert got[a] == got[b] and got[c] == got[z] != got[a]


ROBOTS = "Disallow: /early\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: GoogleBot # name\nUser-agent: bingbot\nDisallow:\nCrawl-delay: x\nCrawl-delay: 3\nSitemap: /map.xml\nDisallow: /g"


def test_robots(spark):
    files = spark.createDataFrame([("e.example", ROBOTS)], "host string, body string")
    crawlers = spark.createDataFrame([("googlebot",), ("other",), ("googlebot-news",)], "crawler string")
    urls = spark.createDataFrame([(f"https://e.example{p}",) for p in ("/private/x", "/private/open/1", "/a.pdf", "/a.pdf?x", "/g/1", "/early")], "url string")
    got = {(r.crawler, r.url[17:]): r.allowed for r in robots.allowed(files, crawlers, urls).collect()}
    assert got["other", "/private/x"] is False and got["other", "/private/open/1"] and got["other", "/a.pdf"] is False and got["other", "/a.pdf?x"]
    assert got["googlebot", "/private/x"] and got["googlebot", "/g/1"] is False and got["googlebot-news", "/g/1"] is False and got["other", "/early"]
    assert robots.delays(files).first().delay == 3.0 and robots.sitemaps(files).first().sitemap == "/map.xml"


def test_sitemaps(spark):
    index = '<?xml version="1.0"?><sitemapindex><sitemap><loc>https://e.example/b.xml</loc></sitemap></sitemapindex>'
    urlset = '<urlset xmlns:x="y"><url><loc>https://e.example/1</loc><lastmod>2024-01-01</lastmod></url><url><loc> https://e.example/2?a=1&amp;b=2 </loc></url></urlset>'
    landed = spark.createDataFrame([("https://e.example/a.xml", 200, None, index), ("https://e.example/b.xml", 200, None, urlset), ("https://e.example/c.txt", 200, None, "https://e.example/3\nnothing"), ("https://e.example/d", 404, None, "")], "url string, status int, error string, body string")
    assert sorted(r.loc for r in sitemap.entries(landed).collect()) == ["https://e.example/1", "https://e.example/2?a=1&b=2", "https://e.example/3"]
    got = {r.url[-5:]: r.fetched for r in sitemap.load(landed.where("url like '%a.xml' or url like '%/d'").select("url"), landed).collect()}
    assert got == {"a.xml": True, "b.xml": True, "ple/d": False}


def a_match(r, pattern):
    """A random text that the pattern matches."""
    kinds = {"CATEGORY_DIGIT": "07", "CATEGORY_WORD": "aZ9_", "CATEGORY_SPACE": " "}

    def walk(parsed):
        out = ""
        for op, v in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(v)
            elif name == "ANY":
                out += r.choice("xy")
            elif name == "IN":
                kind, x = r.choice(v)
                out += chr(x) if str(kind) == "LITERAL" else chr(r.randint(*x)) if str(kind) == "RANGE" else r.choice(kinds[str(x)])
            elif name == "BRANCH":
                out += walk(r.choice(v[1]))
            elif name == "SUBPATTERN":
                out += walk(v[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(walk(v[2]) for _ in range(r.randint(v[0], min(v[1], v[0] + 2))))
            else:
                assert name == "AT", name
        return out

    found = walk(re._parser.parse(pattern))
    assert re.search(pattern, found)
    return found


def test_technology(spark):
    one = catalogue.Signal("html", "", "abc")
    for bad in ("nothing", (), (one,)), ("cms", ("Y",), (one,)), ("cms", (), (replace(one, pattern="a(b"),)), ("cms", (), ()), ("cms", (), (replace(one, version=1),)), ("cms", (), (replace(one, type="smell"),)), ("cms", ("X",), (one,)):
        with pytest.raises(catalogue.CatalogueError):
            catalogue.build((("X", *bad),))
    from webassay.functions import html as H

    page = '<html data-wf-site="1"><head><meta name="generator" content="WordPress 6.4"><link rel="stylesheet" href="/bootstrap-5.1.min.css"></head><body><img src="/wp-content/uploads/x.png"><script id="__NEXT_DATA__">{}</script></body></html>'
    pages = H.document(spark.createDataFrame([("https://e.example/", page)], "url string, html string"))
    got = {r.technology: r for r in technology.detect(pages, ["url"]).collect()}
    assert got["WordPress"].version == "6.4" and got["PHP"].implied_by == "WordPress" and got["PHP"].confidence == 0.9 and got["React"].implied_by == "Next.js" and "Webflow" in got and got["Bootstrap"].version == "5.1"
    on, off = (sorted(map(tuple, technology.signals(pages, prefilter=p).collect())) for p in (True, False))
    assert on == off


def test_own_rules_and_case(spark):
    from webassay.functions import html as H

    rules_ = '[{"name": "Acme", "category": "cms", "implies": ["PHP"], "signals": [{"type": "html", "pattern": "ACME v([0-9]+)", "version": 1, "case": true}]}, {"name": "nginx", "category": "server", "signals": [{"type": "header", "key": "server", "pattern": "^only"}]}]'
    own = catalogue.read_json(rules_)
    pages = H.document(spark.createDataFrame([("https://e.example/1", "<p>ACME v7</p>"), ("https://e.example/2", "<p>acme v8</p>")], "url string, html string"))
    got = technology.detect(pages, ["url"], own).collect()
    assert sorted((r.url[-1], r.technology, r.version) for r in got) == [("1", "Acme", "7"), ("1", "PHP", "")]
    assert [s.pattern for s in own.signals if s.technology == "nginx"] == ["^only"]
    for bad in ("{", '[{"name": "A"}]', '[{"name": "A", "category": "cms", "signals": [{"type": "html", "pattern": "a("}]}]'):
        with pytest.raises(catalogue.CatalogueError):
            catalogue.read_json(bad)


@pytest.mark.parametrize("signal", [s for s in catalogue.build().signals if s.type == "html"], ids=lambda s: s.technology)
def test_required_texts_are_in_every_match(signal):
    r = random.Random(1)
    for _ in range(5):
        assert signal.needs in a_match(r, signal.pattern).lower()


def test_cases_cover_every_rule():
    assert {r.id for r in rules.REGISTRY} == {i for _, i, _ in cases.expected()} and {r.id: r.severity for r in rules.REGISTRY}.items() >= cases.SEVERITY.items() - {("images.control_without_name", "warning")}


def scored(spark, rows, pages=100):
    found = score.deductions(spark.createDataFrame(rows, "finding_id string, severity string, category string, url string"), spark.createDataFrame([(pages,)], "pages int"))
    return score.overall(found, spark.createDataFrame([(pages,)], "pages int")).first().overall


def test_score_calibration(spark):
    every = lambda i, s: [(i, s, i.split(".")[0], f"u{k}") for k in range(100)]
    assert scored(spark, [("x.y", "info", "x", "u")]) == 100
    assert scored(spark, every("indexability.noindex", "critical")) == 0
    assert scored(spark, [("title.missing", "critical", "title", "u1")]) == pytest.approx(99, abs=1)
    assert scored(spark, every("title.missing", "critical")) == pytest.approx(10, abs=1)
    assert scored(spark, every("description.missing", "warning")) == pytest.approx(85, abs=1)


def test_sketches(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:200] + ["x"] + words[200:])), (4, " ".join(f"v{i}" for i in range(400))), (5, "too short")]
    sk = duplicates.sketches(spark.createDataFrame(texts, "id long, text string"), "id")
    got = {(r.a, r.b): r.similarity for r in duplicates.near_pairs(sk).collect()}
    assert set(got) == {(1, 3)} and got[1, 3] > 0.9 and sk.count() == 4
    T.register(spark)
    sk.createOrReplaceTempView("sk")
    assert spark.sql("select min(kmv_similarity(sketch, sketch)) s from sk").first().s == 1.0


def test_soft_404_and_links(spark):
    from webassay.operators import rules

    missing = "sorry nothing lives here " * 20
    pages = rules.with_defaults(spark.createDataFrame([(1, "https://e.example/a", f"<p>{missing}</p>", 200), (2, "https://e.example/b", "<p>" + "real words about oak " * 30 + "</p>", 200), (3, "https://e.example/c", "", 404)], "page_id long, url string, html string, status int"))
    probes = spark.createDataFrame([(200, missing), (200, missing)], "status int, text string")
    assert site.soft_404(pages, probes).first().affected == 1
    links = spark.createDataFrame([("https://e.example/a", "https://e.example/c#x"), ("https://e.example/b", "https://e.example/c")], "url string, target string")
    assert [(r.finding_id, r.affected) for f in site.internal_links(pages, links) for r in f.collect()] == [("structure.broken_internal_links", 1)]


def test_fields_of_answers(spark):
    row = spark.createDataFrame([("Text/HTML; Charset=\"UTF-8\"", ["a=1; Path=/", "b=2", "a=3"], "120", "Wed, 21 Oct 2026 07:28:10 GMT")], "ct string, sc array<string>, ra string, rd string")
    got = row.select(S.content_type(F.col("ct")).alias("ct"), S.set_cookies(F.col("sc")).alias("sc"), S.retry_after(F.col("ra"), F.lit("2026-10-21 07:28:00").cast("timestamp")).alias("a"), S.retry_after(F.col("rd"), F.lit("2026-10-21 07:28:00").cast("timestamp")).alias("b")).first()
    assert tuple(got.ct) == ("text/html", "utf-8") and got.sc == {"a": "3", "b": "2"} and got.a == 120 and got.b == 10
    bodies = [(b"\xef\xbb\xbfh\xc3\xa9", ""), (b"h\xe9", ""), (b"h\xe9", "iso-8859-1"), ("hé".encode(), "")]
    out = [tuple(r[0]) for r in spark.createDataFrame(bodies, "b binary, c string").select(S.decode_body(F.col("b"), F.col("c"))).collect()]
    assert [o[0] for o in out] == ["hé"] * 4 and [o[2] for o in out] == ["bom", "fallback", "header", "utf-8"]


def paced(outcomes, base=0.25, most=5):
    """The rules of pacing, written as one function of the whole list."""
    delay, blocks, errors, fine, tripped, waits = base, 0, 0, 0, False, []
    for outcome, ms in outcomes:
        slower = lambda by: min(30.0, max(delay, base, 0.1) * by)
        if outcome == "ok":
            blocks = errors = 0
            fine += 1
            waits += [ms] if ms is not None else []
            last = sorted(waits[-10:])
            if len(last) >= 5 and last[len(last) // 2] > 3000:
                delay = slower(1.5)
            elif fine >= 5 and delay > base:
                delay, fine = max(base, delay * 0.8), 0
        else:
            fine = 0
            if outcome == "blocked":
                blocks, delay = blocks + 1, slower(2.0)
                tripped = tripped or blocks >= most
            else:
                errors += 1
                delay = slower(1.5) if errors >= 2 else delay
    return delay, blocks, errors, tripped, len(outcomes)


def test_host_pace(spark):
    h = Pace()
    for _ in range(5):
        h.see("blocked", None)
    assert h.tripped and h.delay == 8.0
    quick = Pace(0.0)
    quick.see("blocked", None)
    assert quick.delay == 0.2  # from no delay at all, a tenth of a second is doubled
    upper = Pace()
    for ms in (1000, 1000, 1000, 4000, 4000, 4000):
        upper.see("ok", ms)
    assert upper.delay > 0.25  # of six answers the fourth counts
    r = random.Random(3)
    runs = {f"h{i}": [(r.choices(("ok", "blocked", "error"), (0.8, 0.1, 0.1))[0], r.choice([None, 100.0, 2900.0, 3100.0, 9000.0])) for _ in range(r.randint(1, 60))] for i in range(40)}
    for outcomes in runs.values():
        p = Pace()
        for x in outcomes:
            p.see(*x)
        assert (p.delay, p.blocks, p.errors, p.tripped) == paced(outcomes)[:4]
    rows = [(k, i, *x) for k, v in runs.items() for i, x in enumerate(v)]
    r.shuffle(rows)
    got = {x.host: (x.delay, x.blocks, x.errors, x.tripped, x.requests) for x in host_states(spark.createDataFrame(rows, "host string, seq long, outcome string, ttfb_ms double")).collect()}
    assert got == {k: (round(paced(v)[0], 6), *paced(v)[1:]) for k, v in runs.items()}


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([("title.missing", "critical", "title", "No <title>", "", "Add it", "https://e.example/"), ("robots.missing", "notice", "robots", "none", "", "", None)], "finding_id string, severity string, category string, message string, evidence string, fix string, url string")
    report.write_csv(f, "https://e.example/", str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("url = 'https://e.example/'").count() == 2
    assert "No &lt;title&gt;" in report.html_report("t", f)
    assert report.exit_code(f, f) == 1 and report.exit_code(f.where("severity = 'notice'"), f) == 0
    run = spark.createDataFrame([(1, "e", 90.0)], "run_id long, target string, score double")
    report.append_run(f, run, str(tmp_path / "runs"))
    assert compare.latest_runs(spark.read.parquet(str(tmp_path / "runs/runs"))).count() == 1


class Handler(BaseHTTPRequestHandler):
    tries = {}

    def answer(self, body):
        path = self.path
        Handler.tries[path] = Handler.tries.get(path, 0) + 1
        status = {"/a": 302, "/gone": 404, "/loop": 301}.get(path, 200)
        if path == "/busy" and Handler.tries[path] == 1:
            status = 503
        if path == "/nohead" and self.command == "HEAD":
            status = 405
        if path == "/same" and self.headers.get("If-None-Match") == "tag":
            status = 304
        self.send_response(status)
        for k, v in {"/a": {"Location": "/b"}, "/loop": {"Location": "/loop"}, "/busy": {"Retry-After": "7"}, "/same": {"ETag": "tag"}}.get(path, {}).items():
            self.send_header(k, v)
        self.send_header("Content-Type", "application/pdf" if path == "/pdf" else "text/html")
        self.send_header("Set-Cookie", "a=1")
        self.send_header("Set-Cookie", "b=2")
        self.end_headers()
        if body and status != 304:
            self.wfile.write(gzip.compress(b"<p>zipped</p>") if path == "/zip" else b"" if path == "/a" else b"<p>hi</p>")

    def do_GET(self):
        self.answer(True)

    def do_HEAD(self):
        self.answer(False)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch_against_a_local_server(spark, server):
    http.register(spark)
    read = lambda paths, **options: {r.requested_url.removeprefix(server): r for r in spark.read.format("webfetch").options(urls="\n".join(server + p for p in paths), delay="0", **options).load().collect()}
    rows = read(("/a", "/gone", "/zip", "/pdf", "/loop"))
    assert rows["/a"].status == 200 and rows["/a"].final_url.endswith("/b") and len(rows["/a"].redirects) == 1 and rows["/gone"].status == 404
    assert bytes(rows["/zip"].body) == b"<p>zipped</p>" and rows["/pdf"].body is None and rows["/loop"].error == "redirect_loop"
    assert rows["/zip"].headers["set-cookie"] == "a=1\nb=2"
    rows = read(("/nohead", "/x"), probe="true")
    assert rows["/nohead"].status == 200 and Handler.tries["/nohead"] == 2 and rows["/x"].body is None
    rows = read(("/same", "/other"), known=json.dumps({server + "/same": {"etag": "tag"}}))
    assert rows["/same"].status == 304 and rows["/same"].body is None and rows["/other"].status == 200


def test_waiting(server):
    slept = []
    got = http.fetch(server + "/busy", sleep=slept.append)
    assert got[2] == 200 and got[7] == 2 and slept == [7.0]
    assert http.backoff(0) == 0.5 and 0.5 <= http.backoff(5) <= 16 and http.backoff(50, lambda a, b: b) == 30.0
    assert http.wait_for({"retry-after": "Thu, 01 Jan 1970 00:01:30 GMT"}, 60.0) == 30.0 and http.wait_for({"retry-after": "soon"}, 0) == 0.0 and http.wait_for({"retry-after": "999"}, 0) == 60.0
    assert http.unzipped(b"\x1f\x8bbroken", 5) == (b"\x1f\x8bbro", True) and http.unzipped(gzip.compress(b"x" * 10), 4) == (b"xxxx", True)


def test_settings_and_command_line(spark, tmp_path):
    assert Settings(" e.example ", max_pages=0, delay=99).max_pages == 1 and Settings("e.example", delay=99).delay == 60.0
    for bad in ({"target": "http://"}, {"include": ("(",)}):
        with pytest.raises(ValueError):
            Settings(**bad)
    from webassay.__main__ import main

    pages = [(1, "https://e.example/", '<title>Home</title><a href="/a">A page</a>'), (2, "https://e.example/a", "<p>x</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    assert main(["https://e.example/", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/out"]) == 1
    found = spark.read.csv(f"{tmp_path}/out/findings", header=True)
    assert found.where("finding_id = 'title.missing' and url = 'https://e.example/a'").count() == 1 and found.where("finding_id = 'structure.dead_ends'").first().url == "https://e.example/"
    kinds = {r.kind: r["count"] for r in spark.read.text(f"{tmp_path}/out/report").groupBy("kind").count().collect()}
    assert kinds["page"] == 2 and kinds["score"] == kinds["graph"] == 1 and kinds["category"] == len(score.evaluated()) and kinds["lens"] == 3


def test_reports_of_an_audit(spark):
    pages = spark.createDataFrame([(i, f"https://e.example/{i}", f'<title>T{i // 2}</title><a href="/{i + 1}">next</a>') for i in range(4)], "page_id long, url string, html string")
    a = job.audit(spark, pages, "https://e.example/0")
    assert {r.node[-1]: r.depth for r in a.nodes.collect()} == {"0": 0, "1": 1, "2": 2, "3": 3}
    html = report.html_report("Audit", a.findings, lenses=a.lenses, categories=a.categories)
    assert "performance" in html and "duplicate.title" in html and "https://e.example/3" in html and "<table>" in html
    assert report.text_summary(a.findings, a.score).startswith("score ")
    one = job.page_report(pages.where("page_id = 0")).first()
    assert json.loads(one.json)["title"] == "T0" and any(f["finding_id"] == "description.missing" for f in json.loads(one.json)["findings"])


def checkpoints(spark):
    from pathlib import Path

    return sum(1 for _ in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("rdd-*"))


def test_rounds_leave_no_checkpoints(spark):
    """However many rounds it takes, a few tables stay."""
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), ((F.col("node") * 7 + 1) % 40).alias("dst")).where("src % 5 <> 0 and src <> dst")
    graph.pagerank(nodes, edges, rounds=2).count()
    before = checkpoints(spark)
    short = {r.node: r.pagerank for r in graph.pagerank(nodes, edges, rounds=2).collect()}
    few = checkpoints(spark) - before
    exact = {r.node: r.pagerank for r in graph.pagerank(nodes, edges, rounds=6).collect()}
    assert checkpoints(spark) - before - few <= few and few <= 3
    assert sum(exact.values()) == pytest.approx(1) and short != exact
    path = nodes.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).where("dst < 40")
    before = checkpoints(spark)
    assert {r.component for r in graph.components(nodes, path).collect()} == {0}
    assert checkpoints(spark) - before <= 2
    with pytest.raises(ValueError):
        graph.pagerank(nodes, edges, tolerance=None)


def sketch_of(hashes):
    return sorted(f"{h:016x}" for h in hashes)[: T.SKETCH]


def test_near_pairs_of_sketches(spark):
    """All pairs by plain loops, sizes and cores mixed."""
    r = random.Random(11)
    core = r.sample(range(2**60), 128)
    sets = [set(r.sample(core, r.choice([20, 60, 77, 90, 110, 128]))) | set(r.sample(range(2**60), r.choice([0, 0, 5, 20, 38]))) for _ in range(60)]
    sketches = [sketch_of(x) for x in sets]
    rows = [(i, f"h{i}", x) for i, x in enumerate(sketches)]
    got = {(x.a, x.b): round(x.similarity, 9) for x in duplicates.near_pairs(spark.createDataFrame(rows, "key long, content_hash string, sketch array<string>")).collect()}
    want = {}
    for i, a in enumerate(sketches):
        for j in range(i + 1, len(sketches)):
            union = sorted({*a, *sketches[j]})[: T.SKETCH]
            similar = len({*union} & {*a} & {*sketches[j]}) / len(union)
            if similar >= T.NEAR:
                want[i, j] = round(similar, 9)
    assert got == want and 20 < len(want) < 60 * 59 / 2


def test_a_shared_core_below_the_threshold_meets_nobody(spark):
    """Texts of one size with 76 of 128 hashes in common, one too few: no pair meets, whatever their number."""
    for n in (50, 200):
        rows = [(f"c{k}", i, 128, k + 1) for i in range(n) for k in range(76)] + [(f"o{i}", i, 128, 100) for i in range(n)]
        assert duplicates.met(spark.createDataFrame(rows, "hash string, key long, n int, left int"), 0.6).count() == 0
    mixed = [("c", i, 128, 90) for i in range(30)] + [("c", 30 + i, 100, 70) for i in range(30)]
    assert duplicates.met(spark.createDataFrame(mixed, "hash string, key long, n int, left int"), 0.6).count() == 30 * 29


def typed(value):
    """Nodes with a type by plain recursion: (types, node)."""
    if isinstance(value, dict):
        if "@type" in value:
            said = value["@type"]
            yield [said] if isinstance(said, str) else [str(x) for x in said] if isinstance(said, list) else [], value
        for x in value.values():
            yield from typed(x)
    elif isinstance(value, list):
        for x in value:
            yield from typed(x)


def test_typed_nodes_at_any_depth(spark):
    """Random nesting against plain recursion; unreadable blocks, texts and numbers have no nodes."""
    r = random.Random(5)

    def made(depth):
        kind = r.random()
        if depth == 0 or kind < 0.2:
            return r.choice(["", "x", 0, 1, False, True, None, [], {}])
        if kind < 0.45:
            return [made(depth - 1) for _ in range(r.randint(0, 3))]
        node = {k: made(depth - 1) for k in r.sample(["name", "image", "price", "priceCurrency", "@graph", "offers", "a b", "item.x"], r.randint(0, 4))}
        if r.random() < 0.7:
            node["@type"] = r.choice(["Product", "Offer", ["Product", "Thing"], "Organization", [], 5])
        return node

    blocks = [(i, made(7)) for i in range(60)] + [(60, {"@graph": [[[[{"@type": "Offer", "price": "1"}]]]]})]
    rows = [(i, json.dumps(x)) for i, x in blocks] + [(61, "{bad"), (62, ""), (63, None), (64, '"@type"')]
    nodes = structured.typed_nodes(spark.createDataFrame(rows, "page_id long, json string"))
    got = sorted((x.page_id, x.type, x.missing) for x in structured.incomplete(nodes).collect())
    want = []
    for i, x in blocks:
        for types, node in typed(x):
            for t in types:
                want.append((i, t, ", ".join(p for p in rules.REQUIRED.get(t, ()) if not node.get(p))))
    assert got == sorted(want) and len(want) > 60 and (60, "Offer", "priceCurrency") in got


def test_structured_findings_of_pages(spark):
    deep = '{"@graph": [{"@type": "Product", "name": "P", "image": "i", "offers": {"a": {"b": {"@type": "Offer"}}}}]}'
    page = lambda i, block, more="": (i, f"https://e.com/{i}", f'<html><head>{more}<script type="application/ld+json">{block}</script></head><body>x</body></html>')
    rows = [page(1, deep), page(2, '{"@type": "Organization", "name": "O"}'), page(3, deep, '<meta name="robots" content="noindex">'), page(4, "{bad")]
    got = structured.findings(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(x.page_id, x.finding_id, x.evidence) for x in got] == [(1, "structured.missing_properties", "Offer missing price, priceCurrency")]


def test_store_of_runs_is_whole_or_not_there(spark, tmp_path):
    from webassay.sources import store

    path = str(tmp_path / "store")
    rows = lambda n: spark.range(0, n, 1, 4).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"), F.array("id").alias("list"))
    assert store.read(spark, path) is None and store.runs(spark, path).count() == 0
    store.append(rows(40), path, "a/1")
    with pytest.raises(Exception):
        store.append(rows(90).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"), "text", "list"), path, "b")
    assert [r.run for r in store.runs(spark, path).collect()] == ["a/1"]
    store.append(rows(70), path, "a/1")  # a rerun adds nothing
    store.append(rows(7).where("id > 100"), path, "empty")
    store.append(rows(5), path, "c")
    assert sorted(r.id for r in store.read(spark, path).collect()) == sorted([*range(40), *range(5)])
    assert sorted(map(tuple, store.read(spark, path, "c").collect())) == [(i, f"x{i}", [i]) for i in range(5)]
    assert {r.run: r.rows for r in store.runs(spark, path).collect()} == {"a/1": 40, "c": 5, "empty": 0}
    named = {f for r in store.runs(spark, path).collect() for f in r.files}
    left = {f"data/{x}" for x in os.listdir(f"{path}/data")} - named
    assert len(left) <= 4  # of the failed run at most; the rerun's are gone
