from webassay.functions import html as H
from webassay.functions.tree import controls
from webassay.operators import rules

GOOD = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Handmade oak tables from our small workshop</title>
<meta name="description" content="We build oak tables by hand in a small workshop and deliver them to your door, with a guarantee of ten years.">
<link rel="canonical" href="https://shop.example/tables"><link rel="icon" href="/i.png"><meta name="viewport" content="width=device-width, initial-scale=1">
<meta property="og:title" content="t"><meta property="og:type" content="website"><meta property="og:image" content="https://shop.example/o.jpg"><meta property="og:url" content="https://shop.example/tables"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{"@type":"Product","name":"Table","image":"https://shop.example/o.jpg"}</script></head>
<body><h1>Oak tables</h1><h2>Sizes</h2><p>%s</p><a href="/chairs">Our oak chairs</a><img src="/oak-table.jpg" alt="A long oak table by a window" width="4" height="3"></body></html>""" % ("solid wood " * 200)
HEADERS = {"content-encoding": "br", "strict-transport-security": "max-age=1", "etag": "x"}


def ids(spark, html, url="https://shop.example/tables", headers=HEADERS, **more):
    row = {"page_id": 1, "url": url, "html": html, "headers": headers} | more
    schema = "page_id long, url string, html string, headers map<string,string>" + "".join(f", {k} {'string' if isinstance(v, str) else 'int'}" for k, v in more.items())
    return {r.finding_id: r.severity for r in rules.findings(spark.createDataFrame([row], schema)).collect()}


def test_a_clean_page_is_quiet(spark):
    assert {k: v for k, v in ids(spark, GOOD).items() if v in ("critical", "warning")} == {}


def test_an_empty_page_is_loud(spark):
    got = ids(spark, "<html><body></body></html>", headers={})
    assert {"title.missing", "description.missing", "canonical.missing", "headings.none", "links.none", "content.empty", "i18n.missing_lang", "technical.no_viewport", "technical.no_compression"} <= set(got)


def test_noindex_hides_findings_on_appearance(spark):
    got = ids(spark, "<html><body><p>x</p></body></html>", headers={"x-robots-tag": "googlebot: noindex"})
    assert "indexability.noindex" in got and "title.missing" not in got and "canonical.missing" not in got and "i18n.missing_lang" in got


def test_failed_fetches_have_their_own_rules(spark):
    assert set(ids(spark, "", error="blocked")) == {"technical.blocked"}
    assert set(ids(spark, "", error="timeout")) == {"technical.fetch_failed"}


def test_details(spark):
    page = GOOD.replace("<h2>Sizes</h2>", '<h3>Sizes</h3><img src="http://shop.example/img_1.jpg" alt="image of a cat"><img src="/a.png"><a href="https://o.example/" target="_blank">here</a><a href="http://o.example/"></a><script type="application/ld+json">{bad</script>')
    got = ids(spark, page, url="https://shop.example/Tables_a?x=1&y=2&PHPSESSID=3")
    assert {"headings.skipped_level", "images.redundant_alt_prefix", "images.missing_alt", "images.missing_dimensions", "images.generic_filename", "links.generic_anchor", "links.empty_anchor", "links.insecure", "links.unsafe_target_blank", "structured.invalid_json", "technical.mixed_content", "url.uppercase", "url.underscores", "url.session_id", "url.many_parameters", "canonical.not_self_referential"} <= set(got)


def test_required_properties_and_types(spark):
    graph = '<script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"],"headline":"h"},{"@type":"Offer","price":"1","priceCurrency":"EUR"}]}</script>'
    d = H.document(spark.createDataFrame([("https://e.example/", graph)], "url string, html string"))
    assert d.select(H.schema_types(d["doc"]["json_ld"])).first()[0] == ["Article", "Offer", "Thing"]
    assert "structured.missing_properties" in ids(spark, graph)


def test_titles_in_pictures_and_scripts_do_not_count(spark):
    page = "<title>One</title><svg><title>icon</title></svg><script>var t='<title>no</title><h1>no</h1>'</script><!-- <h1>no</h1> --><p>a &amp;lt; b</p>"
    d = H.document(spark.createDataFrame([("https://e.example/", page)], "url string, html string")).select("doc.titles", "doc.headings", "doc.text", "doc.word_count").first()
    assert d.titles == ["One"] and d.headings == [] and "&lt;" in d.text and d.word_count == 3 + ("One" in d.text)


def test_batch_of_one_equals_batch_of_many(spark):
    pages = spark.createDataFrame([(i, f"https://e.example/{i}", GOOD if i % 2 else "<p>x</p>") for i in range(6)], "page_id long, url string, html string")
    every = {(r.page_id, r.finding_id) for r in rules.findings(pages).collect()}
    for i in (0, 1):
        assert {(r.page_id, r.finding_id) for r in rules.findings(pages.where(f"page_id = {i}")).collect()} == {x for x in every if x[0] == i}


def test_controls():
    assert controls('<a href="/x"><svg></svg></a>') == [("svg in a link or button", "/x")]
    assert controls('<button aria-label="Menu"><svg></svg></button><a href="/y"><svg><title>Home</title></svg></a><a href="/z"><svg></svg> text</a>') == []
    assert controls('<input type="image" src="go.png"><area href="/a"><div role="img" class="hero"></div>') == [("input image", "go.png"), ("image map area", "/a"), ('role="img" element', "hero")]


def test_vitals(spark):
    got = rules.vitals_findings(spark.createDataFrame([("u", 5000.0, 0.05, 900.0)], "url string, lcp_ms double, cls double, ttfb_ms double")).collect()
    assert {(r.finding_id, r.severity) for r in got} == {("vitals.lcp", "warning"), ("vitals.ttfb", "notice")}
