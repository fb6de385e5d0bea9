"""Cases as queries over small inline tables, for what the test tables never show: every rule, and functions with their odd cases.

The SQL of such a case states the expected rows. They are written case by
case from what a rule is meant to say, next to the page that shows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from webassay.functions import html as H
from webassay.functions import text as T
from webassay.functions import urls as U
from webassay.operators import compare, crawl, graph, robots, rules, score, site, sitemap, technology
from webassay.plans import report
from webassay.plans.crawl import ROBOTS as RULES_FILE
from webassay.sources import http, providers
from webassay.sources import pages as S


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Keep a case and the SQL of what it must give."""

    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def values(rows: list[tuple], names: str) -> str:
    """SQL of a table of literals; numbers are BIGINT or DOUBLE."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int):
            return f"{x}::BIGINT"
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


PARTS = {
    "open": '<html lang="en">',
    "charset": '<meta charset="utf-8">',
    "title": "<title>Handmade oak tables from our small workshop</title>",
    "description": '<meta name="description" content="We build oak tables by hand in a small workshop and deliver them to your door, with a guarantee of ten years.">',
    "canonical": '<link rel="canonical" href="https://shop.example/tables">',
    "icon": '<link rel="icon" href="/i.png">',
    "viewport": '<meta name="viewport" content="width=device-width, initial-scale=1">',
    "og": '<meta property="og:title" content="t"><meta property="og:type" content="website"><meta property="og:image" content="https://shop.example/o.jpg"><meta property="og:url" content="https://shop.example/tables">',
    "card": '<meta name="twitter:card" content="summary">',
    "data": '<script type="application/ld+json">{"@type":"Product","name":"Table","image":"https://shop.example/o.jpg"}</script>',
    "head": "",
    "headings": "<h1>Oak tables</h1><h2>Sizes</h2>",
    "text": "<p>" + "solid wood " * 200 + "</p>",
    "links": '<a href="/chairs">Our oak chairs</a>',
    "images": '<img src="/oak-table.jpg" alt="A long oak table by a window" width="4" height="3">',
    "body": "",
}
HEAD = ("charset", "title", "description", "canonical", "icon", "viewport", "og", "card", "data", "head")
BODY = ("headings", "text", "links", "images", "body")
RECORD = {"url": "https://shop.example/tables", "headers": {"content-encoding": "br", "strict-transport-security": "max-age=1", "etag": "x"}}
#: What the page of PARTS gives by itself, which isn't a fault.
ALWAYS = {"structured.present"}


def image(src="/oak.jpg", size=' width="4" height="3"', **attrs) -> str:
    return f'<img src="{src}"' + "".join(f' {k.replace("_", "-")}="{v}"' for k, v in attrs.items()) + f"{size}>"


def times(item: str, n: int) -> str:
    return item * n


THIN = "<p>" + "word " * 50 + "</p>"
RENDERED = {"error": None, "words_before": 400, "words_after": 400, "links_before": 1, "links_after": 1, "title_before": "t", "title_after": "t", "description_before": "d", "description_after": "d"}


def rendered(**change) -> dict:
    return {"render_diff": RENDERED | change}


#: (case, parts that differ, fields of the record that differ, findings that come, findings that go)
CASES: list[tuple[str, dict, dict, set, set]] = [
    ("sound page", {}, {}, set(), set()),
    # Titles and descriptions
    ("no title", {"title": ""}, {}, {"title.missing"}, set()),
    ("blank title", {"title": "<title> </title>"}, {}, {"title.missing"}, set()),
    ("two titles", {"title": PARTS["title"] + "<title>Another</title>"}, {}, {"title.multiple"}, set()),
    ("title of a picture", {"body": "<svg><title>icon</title></svg>"}, {}, set(), set()),
    ("title of 60 signs", {"title": f"<title>{'x' * 60}</title>"}, {}, set(), set()),
    ("title of 61 signs", {"title": f"<title>{'x' * 61}</title>"}, {}, {"title.too_long"}, set()),
    ("title of 29 signs", {"title": f"<title>{'x' * 29}</title>"}, {}, {"title.too_short"}, set()),
    ("no description", {"description": ""}, {}, {"description.missing"}, set()),
    ("two descriptions", {"description": PARTS["description"] * 2}, {}, {"description.multiple"}, set()),
    ("description of 161 signs", {"description": f'<meta name="description" content="{"x" * 161}">'}, {}, {"description.too_long"}, set()),
    ("description of 69 signs", {"description": f'<meta name="description" content="{"x" * 69}">'}, {}, {"description.too_short"}, set()),
    # Indexing and canonical addresses
    ("noindex", {"head": '<meta name="robots" content="NoIndex, follow">'}, {}, {"indexability.noindex"}, {"structured.present"}),
    ("noindex hides appearance", {"title": "", "canonical": "", "text": THIN, "head": '<meta name="googlebot" content="noindex">'}, {}, {"indexability.noindex"}, {"structured.present"}),
    ("none in a header", {}, {"headers": RECORD["headers"] | {"x-robots-tag": "googlebot: none"}}, {"indexability.noindex", "indexability.nofollow"}, {"structured.present"}),
    ("nofollow", {"head": '<meta name="robots" content="nofollow">'}, {}, {"indexability.nofollow"}, set()),
    ("nosnippet", {"head": '<meta name="robots" content="nosnippet">'}, {}, {"indexability.restricted"}, set()),
    ("no canonical", {"canonical": ""}, {}, {"canonical.missing"}, set()),
    ("two canonicals", {"canonical": PARTS["canonical"] + '<link rel="canonical" href="https://shop.example/other">'}, {}, {"canonical.multiple"}, set()),
    ("relative canonical", {"canonical": '<link rel="canonical" href="/tables">'}, {}, {"canonical.relative"}, set()),
    ("canonical elsewhere", {"canonical": '<link rel="canonical" href="https://other.example/tables">'}, {}, {"canonical.cross_domain"}, set()),
    ("insecure canonical", {"canonical": '<link rel="canonical" href="http://shop.example/tables">'}, {}, {"canonical.insecure"}, set()),
    ("canonical of another page", {"canonical": '<link rel="canonical" href="https://shop.example/all">'}, {}, {"canonical.not_self_referential"}, set()),
    ("canonical with a last slash", {"canonical": '<link rel="canonical" href="https://shop.example/tables/">'}, {}, set(), set()),
    # Headings
    ("no headings", {"headings": ""}, {}, {"headings.none"}, set()),
    ("no main heading", {"headings": "<h2>Sizes</h2>"}, {}, {"headings.no_h1"}, set()),
    ("two main headings", {"headings": "<h1>Oak</h1><h1>Beech</h1>"}, {}, {"headings.multiple_h1"}, set()),
    ("an empty heading", {"headings": "<h1>Oak</h1><h2> </h2>"}, {}, {"headings.empty"}, set()),
    ("a level left out", {"headings": "<h1>Oak</h1><h3>Sizes</h3>"}, {}, {"headings.skipped_level"}, set()),
    # Images
    ("no alt", {"images": image()}, {}, {"images.missing_alt"}, set()),
    ("empty alt", {"images": image(alt="")}, {}, set(), set()),
    ("hidden image", {"images": image(aria_hidden="true")}, {}, set(), set()),
    ("presentation", {"images": image(role="presentation")}, {}, set(), set()),
    ("named by a label", {"images": image(aria_label="Oak")}, {}, {"images.alt_via_aria"}, set()),
    ("named by a title", {"images": image(title="Oak")}, {}, {"images.alt_via_aria"}, set()),
    ("a pixel", {"images": image(src="/count", size=' width="1" height="1"')}, {}, {"images.beacon_without_empty_alt"}, set()),
    ("a pixel with alt", {"images": image(src="/count", size=' width="1" height="1"', alt="")}, {}, set(), set()),
    ("picture of", {"images": image(alt="A picture of an oak table")}, {}, {"images.redundant_alt_prefix"}, set()),
    ("icon showing", {"images": image(alt="Icon showing, a lamp")}, {}, {"images.redundant_alt_prefix"}, set()),
    ("picture frame", {"images": image(alt="Picture frame of oak")}, {}, set(), set()),
    ("generic alt", {"images": image(alt="Logo.")}, {}, {"images.generic_alt"}, set()),
    ("one alt four times", {"images": times(image(alt="An oak table"), 4)}, {}, {"images.duplicate_alt"}, set()),
    ("one alt three times", {"images": times(image(alt="An oak table"), 3)}, {}, set(), set()),
    ("alt of 126 signs", {"images": image(alt="o" * 126)}, {}, {"images.alt_too_long"}, set()),
    ("alt is a file", {"images": image(alt="oak-table_2.JPG")}, {}, {"images.alt_is_filename"}, set()),
    ("alt of a camera", {"images": image(alt="DSC_0042")}, {}, {"images.alt_is_filename"}, set()),
    ("alt with an ending", {"images": image(alt="photo.heic")}, {}, {"images.alt_is_filename"}, set()),
    ("alt names a file in a sentence", {"images": image(alt="See plan.png for sizes")}, {}, set(), set()),
    ("alt repeats the address", {"images": image(alt="Tables")}, {}, {"images.alt_matches_slug"}, set()),
    ("generic file", {"images": image(src="/image-3.jpg", alt="Oak by a window")}, {}, {"images.generic_filename"}, set()),
    ("file of a camera", {"images": image(src="/DSCN1001.jpg", alt="Oak by a window")}, {}, {"images.generic_filename"}, set()),
    ("file of a number", {"images": image(src="/20240101.jpg", alt="Oak by a window")}, {}, {"images.generic_filename"}, set()),
    ("file behind a proxy", {"images": image(src="/_next/image?url=%2Fimg_12.png&w=64", alt="Oak by a window")}, {}, {"images.generic_filename"}, set()),
    ("telling file", {"images": image(src="/image-of-oak.jpg", alt="Oak by a window")}, {}, set(), set()),
    ("no source", {"images": '<img alt="Oak by a window" width="1" height="2">'}, {}, {"images.missing_src"}, set()),
    ("no size", {"images": image(size="", alt="Oak by a window")}, {}, {"images.missing_dimensions"}, set()),
    ("five images at once", {"images": "".join(image(alt=f"Oak number {i}") for i in range(5))}, {}, {"images.no_lazy_loading"}, set()),
    ("one of five is lazy", {"images": "".join(image(alt=f"Oak number {i}", loading="lazy" if i == 4 else "eager") for i in range(5))}, {}, set(), set()),
    # Links
    ("no links", {"links": ""}, {}, {"links.none"}, set()),
    ("only links elsewhere", {"links": '<a href="https://other.example/">Our friends</a>'}, {}, {"links.no_internal"}, set()),
    ("a link without text", {"links": '<a href="/chairs"></a>'}, {}, {"links.empty_anchor"}, set()),
    ("a link by its picture", {"links": '<a href="/chairs">' + image(alt="Our chairs") + "</a>"}, {}, set(), set()),
    ("read more", {"links": '<a href="/chairs">Read more »</a>'}, {}, {"links.generic_anchor"}, set()),
    ("150 links", {"links": times(PARTS["links"], 150)}, {}, set(), set()),
    ("151 links", {"links": times(PARTS["links"], 151)}, {}, {"links.excessive"}, set()),
    ("a link not followed", {"links": '<a rel="nofollow" href="/chairs">Our chairs</a>'}, {}, {"links.nofollow_internal"}, set()),
    ("an insecure link", {"links": PARTS["links"] + '<a href="http://other.example/">Our friends</a>'}, {}, {"links.insecure"}, set()),
    ("a window that reaches back", {"links": PARTS["links"] + '<a target="_blank" href="https://other.example/">Our friends</a>'}, {}, {"links.unsafe_target_blank"}, set()),
    ("a window of its own", {"links": PARTS["links"] + '<a target="_blank" rel="noopener" href="https://other.example/">Our friends</a>'}, {}, set(), set()),
    ("only a script", {"links": '<a href="javascript:go()">Our chairs</a><a href="#top">Up</a>'}, {}, {"links.none"}, set()),
    # Social previews
    ("no previews", {"og": "", "card": ""}, {}, {"social.og_missing", "social.twitter_missing"}, set()),
    ("half a preview", {"og": '<meta property="og:title" content="t"><meta property="og:image" content="https://shop.example/o.jpg">'}, {}, {"social.og_incomplete"}, set()),
    ("relative preview image", {"og": PARTS["og"].replace("https://shop.example/o.jpg", "/o.jpg")}, {}, {"social.og_image_relative"}, set()),
    ("preview of another page", {"og": PARTS["og"].replace('url" content="https://shop.example/tables"', 'url" content="https://shop.example/"')}, {}, {"social.og_url_mismatch"}, set()),
    ("an unknown card", {"card": '<meta name="twitter:card" content="gallery">'}, {}, {"social.twitter_card_invalid"}, set()),
    # Structured data
    ("data cut short", {"data": '<script type="application/ld+json">{"@type":</script>'}, {}, {"structured.invalid_json", "structured.none"}, {"structured.present"}),
    ("microdata", {"data": "", "body": '<div itemscope itemtype="https://schema.org/Product"></div>'}, {}, {"structured.microdata_only"}, {"structured.present"}),
    ("no data", {"data": ""}, {}, {"structured.none"}, {"structured.present"}),
    ("product without image", {"data": '<script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"],"name":"Table"}]}</script>'}, {}, {"structured.missing_properties"}, set()),
    ("offer inside a product", {"data": '<script type="application/ld+json">{"@type":"Product","name":"T","image":"i","offers":{"@type":"Offer","price":"1"}}</script>'}, {}, {"structured.missing_properties"}, set()),
    # Languages
    ("no language", {"open": "<html>"}, {}, {"i18n.missing_lang"}, set()),
    ("not a language", {"open": '<html lang="english_us">'}, {}, {"i18n.invalid_lang"}, set()),
    ("alternates", {"head": '<link rel="alternate" hreflang="en" href="https://shop.example/tables"><link rel="alternate" hreflang="de" href="https://shop.example/tische"><link rel="alternate" hreflang="x-default" href="https://shop.example/tables">'}, {}, set(), set()),
    ("alternate in no language", {"head": '<link rel="alternate" hreflang="en-UKX" href="https://shop.example/tables"><link rel="alternate" hreflang="x-default" href="https://shop.example/tables">'}, {}, {"i18n.hreflang_invalid"}, set()),
    ("alternates without the page", {"head": '<link rel="alternate" hreflang="de" href="https://shop.example/tische"><link rel="alternate" hreflang="x-default" href="https://shop.example/">'}, {}, {"i18n.hreflang_no_self"}, set()),
    ("alternates without a default", {"head": '<link rel="alternate" hreflang="en" href="https://shop.example/tables">'}, {}, {"i18n.hreflang_no_xdefault"}, set()),
    ("relative alternates", {"head": '<link rel="alternate" hreflang="en" href="/tables"><link rel="alternate" hreflang="x-default" href="/tables">'}, {}, {"i18n.hreflang_relative"}, set()),
    # Content
    ("no text", {"headings": "", "text": "", "links": '<a href="/chairs">' + image(alt="Our chairs") + "</a>"}, {}, {"content.empty", "headings.none"}, set()),
    ("very little text", {"text": THIN, "head": "<style>a{}</style>"}, {}, {"content.very_thin"}, set()),
    ("little text", {"text": "<p>" + "word " * 150 + "</p>"}, {}, {"content.thin"}, set()),
    ("mostly markup", {"text": "<p>" + "word " * 150 + "</p>", "body": times('<div class="' + "x" * 90 + '"></div>', 90)}, {}, {"content.thin", "content.low_text_ratio"}, set()),
    ("an application shell", {"text": THIN, "body": '<div id="root"></div>' + "".join(f'<script src="/{i}.js" defer></script>' for i in range(3))}, {}, {"content.very_thin", "content.js_rendered"}, set()),
    # Rendered pages
    ("same when rendered", {}, rendered(), set(), set()),
    ("not rendered", {}, rendered(error="timeout"), {"render.failed"}, set()),
    ("text by scripts", {}, rendered(words_before=20, words_after=70), {"render.content_requires_js"}, set()),
    ("a little text by scripts", {}, rendered(words_before=20, words_after=69), set(), set()),
    ("links by scripts", {}, rendered(links_before=0, links_after=3), {"render.links_require_js"}, set()),
    ("more links by scripts", {}, rendered(links_before=5, links_after=15), {"render.some_links_require_js"}, set()),
    ("title by scripts", {}, rendered(title_before=" "), {"render.title_requires_js"}, set()),
    ("description by scripts", {}, rendered(description_before=None), {"render.description_requires_js"}, set()),
    # Transport and delivery
    ("refused", {}, {"error": "blocked"}, {"technical.blocked"}, {"structured.present"}),
    ("timed out", {}, {"error": "timeout"}, {"technical.fetch_failed"}, {"structured.present"}),
    ("status 503", {}, {"status": 503}, {"technical.server_error"}, set()),
    ("status 410", {}, {"status": 410}, {"technical.client_error"}, set()),
    ("not secure", {"canonical": '<link rel="canonical" href="http://shop.example/tables">', "og": PARTS["og"].replace('url" content="https', 'url" content="http')}, {"url": "http://shop.example/tables"}, {"technical.not_https"}, set()),
    ("not told to stay secure", {}, {"headers": {"content-encoding": "br", "etag": "x"}}, {"technical.no_hsts"}, set()),
    ("insecure picture", {"images": image(src="http://shop.example/oak.jpg", alt="Oak by a window")}, {}, {"technical.mixed_content"}, set()),
    ("insecure in a set", {"images": image(alt="Oak by a window", srcset="/oak.jpg 1x, http://cdn.example/oak2.jpg 2x")}, {}, {"technical.mixed_content"}, set()),
    ("two redirects", {}, {"redirects": [("https://shop.example/a", 301, "/b"), ("https://shop.example/b", 308, "/tables")]}, {"technical.redirect_chain"}, set()),
    ("one redirect", {}, {"redirects": [("https://shop.example/a", 301, "/tables")]}, {"technical.redirect"}, set()),
    ("a redirect for now", {}, {"redirects": [("https://shop.example/a", 302, "/tables")]}, {"technical.redirect", "technical.temporary_redirect"}, set()),
    ("no viewport", {"viewport": ""}, {}, {"technical.no_viewport"}, set()),
    ("fixed viewport", {"viewport": '<meta name="viewport" content="width=1024">'}, {}, {"technical.viewport_fixed"}, set()),
    ("no encoding named", {"charset": ""}, {}, {"technical.no_charset"}, set()),
    ("encoding in the header", {"charset": ""}, {"charset_source": "header"}, set(), set()),
    ("first byte after 1800 ms", {}, {"ttfb_ms": 1800.0}, {"technical.ttfb_slow"}, set()),
    ("first byte after 1801 ms", {}, {"ttfb_ms": 1801.0}, {"technical.ttfb_very_slow"}, set()),
    ("not compressed", {}, {"headers": {"strict-transport-security": "max-age=1", "etag": "x"}}, {"technical.no_compression"}, set()),
    ("large page", {}, {"decoded_bytes": 150_001}, {"technical.large_html"}, set()),
    ("old protocol", {}, {"http_version": "http/1.1"}, {"technical.http1"}, set()),
    ("no validators", {}, {"headers": {"content-encoding": "br", "strict-transport-security": "max-age=1"}}, {"technical.no_cache_validators"}, set()),
    ("dated", {}, {"headers": {"content-encoding": "br", "strict-transport-security": "max-age=1", "last-modified": "Mon, 01 Jan 2024 00:00:00 GMT"}}, set(), set()),
    ("cut off", {}, {"truncated": True}, {"technical.body_truncated"}, set()),
    ("scripts in the way", {"head": "".join(f'<script src="/{i}.js"></script>' for i in range(3))}, {}, {"technical.render_blocking_scripts"}, set()),
    ("scripts put off", {"head": '<script src="/1.js" defer></script><script src="/2.js" async></script><script src="/3.js" type="module"></script>'}, {}, set(), set()),
    ("no icon", {"icon": ""}, {}, {"technical.no_favicon"}, set()),
]


def at(path: str, **more) -> tuple[dict, dict]:
    """Parts and record of the page at another address that names itself."""
    address = f"https://shop.example{path}"
    return {"canonical": f'<link rel="canonical" href="{address.replace("&", "&amp;")}">', "og": PARTS["og"].replace('url" content="https://shop.example/tables"', f'url" content="{address.replace("&", "&amp;")}"')}, {"url": address} | more


CASES += [
    ("a long address", *at("/" + "oak-" * 24), {"url.too_long"}, set()),
    ("a deep address", *at("/a/b/c/d/e"), {"url.too_deep"}, set()),
    ("capitals", *at("/Tables"), {"url.uppercase"}, set()),
    ("underscores", *at("/oak_tables"), {"url.underscores"}, set()),
    ("a session", *at("/tables?sid=1"), {"url.session_id"}, set()),
    ("three parameters", *at("/tables?a=1&b=2&c=3"), {"url.many_parameters"}, set()),
]


def page(parts: dict) -> str:
    own = PARTS | parts
    return "<!doctype html>" + own["open"] + "<head>" + "".join(own[k] for k in HEAD) + "</head><body>" + "".join(own[k] for k in BODY) + "</body></html>"


#: How grave findings are; the others are notices.
GRAVE = {
    "critical": ("content.empty", "indexability.noindex", "technical.blocked", "technical.client_error", "technical.fetch_failed", "technical.mixed_content", "technical.no_viewport", "technical.not_https", "technical.server_error", "title.missing"),
    "warning": (
        "canonical.cross_domain", "canonical.insecure", "canonical.missing", "canonical.multiple", "content.very_thin", "description.missing", "description.multiple", "headings.no_h1", "headings.none", "i18n.hreflang_invalid", "i18n.hreflang_no_self",
        "i18n.missing_lang", "images.control_without_name", "images.missing_alt", "images.missing_src", "indexability.nofollow", "links.insecure", "links.no_internal", "links.none", "render.content_requires_js", "render.links_require_js",
        "render.title_requires_js", "render.description_requires_js", "social.og_image_relative", "structured.invalid_json", "technical.no_charset", "technical.no_compression", "technical.redirect_chain", "technical.ttfb_very_slow",
        "technical.viewport_fixed", "title.multiple", "title.too_long", "url.session_id",
    ),
    "info": ("content.js_rendered", "indexability.restricted", "social.twitter_missing", "structured.microdata_only", "structured.present", "technical.body_truncated"),
}
SEVERITY = {i: severity for severity, ids in GRAVE.items() for i in ids}


def expected() -> list[tuple[str, str, str]]:
    return sorted((case, i, SEVERITY.get(i, "notice")) for case, _, _, come, go in CASES for i in (ALWAYS | come) - go)


FIELDS = "case string, page_id long, url string, html string, status int, error string, headers map<string,string>, redirects array<struct<url:string,status:int,location:string>>, ttfb_ms double, http_version string, decoded_bytes long, truncated boolean, charset_source string, mime string, render_diff struct<error:string,words_before:int,words_after:int,links_before:int,links_after:int,title_before:string,title_after:string,description_before:string,description_after:string>"


def case_pages(spark):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows = []
    for i, (case, parts, record, _, _) in enumerate(CASES):
        full = {"status": 200, "redirects": [], "http_version": "", "truncated": False, "charset_source": "", "mime": "text/html"} | RECORD | record
        diff = full.get("render_diff")
        rows.append(tuple({"case": case, "page_id": i, "html": page(parts), "render_diff": Row(**diff) if diff else None}.get(k, full.get(k)) for k in names))
    return spark.createDataFrame(rows, FIELDS)


@query(values(expected(), 'case_name, finding_id, severity'))
def page_rule_cases(spark, sf_dir):
    """Every page rule on a page that shows it, with all that the page gives besides."""
    pages = case_pages(spark)
    found = rules.findings(pages.drop("case"))
    return found.join(pages.select("page_id", F.col("case").alias("case_name")), "page_id").select("case_name", "finding_id", "severity")


#: (metric, value, finding, severity or none)
VITALS = (
    ("lcp_ms", 2500.0, None), ("lcp_ms", 2501.0, "notice"), ("lcp_ms", 4001.0, "warning"), ("cls", 0.1, None), ("cls", 0.11, "notice"), ("cls", 0.3, "warning"), ("ttfb_ms", 801.0, "notice"), ("ttfb_ms", 1801.0, "notice"),
    ("fcp_ms", 1801.0, "notice"), ("fcp_ms", 3001.0, "notice"), ("total_blocking_ms", 200.0, None), ("total_blocking_ms", 601.0, "notice"), ("lcp_ms", None, None),
)


@query(values([(str(i), "vitals." + m.removesuffix("_ms"), s) for i, (m, _, s) in enumerate(VITALS) if s], "url, finding_id, severity"))
def vitals_cases(spark, sf_dir):
    """Every metric at and above its bounds; only the core ones are graver when poor."""
    names = ("lcp_ms", "cls", "ttfb_ms", "fcp_ms", "total_blocking_ms")
    rows = spark.createDataFrame([(str(i), *(v if m == n else None for n in names)) for i, (m, v, _) in enumerate(VITALS)], "url string, " + ", ".join(f"{n} double" for n in names))
    return rules.vitals_findings(rows).select("url", "finding_id", "severity")


#: (html, what has no name)
CONTROLS = (
    ('<a href="/x"><svg></svg></a>', "1 svg in a link or button"),
    ('<button aria-label="Menu"><svg></svg></button>', None),
    ('<a href="/y"><svg><title>Home</title></svg></a><a href="/z"><svg></svg> text</a>', None),
    ('<input type="image" src="go.png"><input type="image" src="on.png"><area href="/a">', "2 input image, 1 image map area"),
    ('<div role="img" class="hero"></div>', '1 role="img" element'),
    ('<area href="/a" alt="North"><input type="image" src="go.png" title="Go">', None),
)


@query(values([(i, "images.control_without_name", "warning", e) for i, (_, e) in enumerate(CONTROLS) if e], "page_id, finding_id, severity, evidence"))
def control_cases(spark, sf_dir):
    pages = spark.createDataFrame([(i, f"https://e.example/{i}", h) for i, (h, _) in enumerate(CONTROLS)], "page_id long, url string, html string")
    return rules.control_findings(pages).select("page_id", "finding_id", "severity", "evidence")


@query(values([("fails when read", "analyzer.error"), ("fails when planned", "analyzer.error"), ("sound", "own.rule")], "case_name, finding_id"))
def rule_failure_cases(spark, sf_dir):
    """Own rules that raise or name what isn't there become a finding; a sound one gives its own."""
    page_ = spark.createDataFrame([("https://e.example/", "<p>x</p>")], "url string, html string")

    def broken(p):
        raise KeyError("no such part")

    own = {"fails when read": broken, "fails when planned": lambda p: F.col("not_there") > 0, "sound": lambda p: p.words > 0}
    return reduce(DataFrame.unionByName, [rules.findings(page_, rules=[rules.Rule("own.rule", "notice", when, lambda p: F.lit(""))]).select(F.lit(name).alias("case_name"), "finding_id") for name, when in own.items()])


ROBOTS = "host string, fetched boolean, error string, body string"
PAGES = "page_id long, url string, html string, status int, error string, headers map<string,string>, redirects array<struct<url:string,status:int,location:string>>"
HOP = [("https://e.example/old", 301, "/x")]
LONG = " ".join(f"word{i}" for i in range(80))


def pages_of(spark, *rows: dict) -> DataFrame:
    """Page records with doc; what a row doesn't give is that of a sound answer."""
    sound = {"html": "<p>text</p>", "status": 200, "error": None, "headers": {}, "redirects": []}
    return rules.with_defaults(spark.createDataFrame([tuple(({"page_id": i} | sound | r)[k.split()[0]] for k in PAGES.split(", ")) for i, r in enumerate(rows)], PAGES))


def u(path: str) -> str:
    return f"https://e.example{path}"


#: What comes of each small crawl: (id, severity, affected).
SITE_EXPECTED: dict[str, list[tuple[str, str, int]]] = {
    "robots out of reach": [("robots.unreachable", "warning", 1)],
    "no robots": [("robots.missing", "notice", 1)],
    "all shut": [("robots.blocks_everything", "critical", 1)],
    "no sitemap named": [("robots.no_sitemap_declared", "notice", 1)],
    "some crawlers shut out": [("robots.blocks_search_engine", "critical", 1), ("robots.blocks_answer_engines", "warning", 1), ("robots.blocks_ai_training", "info", 1)],
    "styles shut": [("robots.blocks_resources", "warning", 2)],
    "no sitemap": [("sitemap.missing", "warning", 0)],
    "some sitemaps": [("sitemap.partly_unreadable", "warning", 2), ("sitemap.truncated", "info", 1)],
    "sitemap entries": [("sitemap.broken_entries", "warning", 2), ("sitemap.redirecting_entries", "notice", 1), ("sitemap.noindexed_entries", "warning", 2), ("sitemap.non_canonical_entries", "notice", 1)],
    "one page": [("crawl.blocked_by_robots", "notice", 2), ("crawl.no_pages_discovered", "warning", 0)],
    "measured after consent": [("technical.analytics_behind_consent", "info", 0)],
    "not measured": [("technical.no_analytics", "notice", 0)],
    "measured": [],
    "nothing to measure": [],
    "llms.txt": [("robots.llms_txt_found", "info", 0)],
    "llms.txt is a page": [("robots.no_llms_txt", "notice", 0)],
    "reach": [("structure.orphan_pages", "warning", 1), ("structure.deep_pages", "notice", 2), ("structure.dead_ends", "notice", 1)],
    "targets of links": [("structure.broken_internal_links", "critical", 2), ("structure.links_to_redirects", "notice", 1)],
    "answers to anything": [("structure.soft_404", "warning", 1)],
    "honest answers": [],
    "many queries": [("crawl.parameter_explosion", "warning", 1)],
    "links elsewhere": [("external.checked", "info", 3), ("external.broken_links", "warning", 2)],
    "same titles": [("duplicate.title", "warning", 2), ("duplicate.description", "warning", 2), ("duplicate.h1", "warning", 3)],
    "same content": [("duplicate.content", "warning", 2), ("duplicate.untranslated_localizations", "warning", 2)],
    "near content": [("duplicate.partly_translated", "notice", 2), ("duplicate.near_content", "warning", 3)],
}


def site_cases(spark) -> dict[str, dict]:
    """Small crawls by name: the tables that a check needs."""
    t = lambda rows, names: spark.createDataFrame(rows, names)
    body = "User-agent: *\nDisallow: /\nSitemap: https://e.example/s.xml"
    shut = "User-agent: *\nDisallow: /private\n\nUser-agent: bingbot\nUser-agent: gptbot\nUser-agent: perplexitybot\nDisallow: /\nSitemap: https://e.example/s.xml\n\nUser-agent: googlebot\nDisallow: /assets/"
    text = lambda i: {"url": u(f"/{i}"), "html": f"<p>{LONG} {i}</p>"}
    noindex = "<meta name=googlebot content=noindex>"
    return {
        "robots out of reach": {"robots": t([("e.example", False, "timeout", "")], ROBOTS)},
        "no robots": {"robots": t([("e.example", False, "", "")], ROBOTS)},
        "all shut": {"robots": t([("e.example", True, "", body)], ROBOTS)},
        "no sitemap named": {"robots": t([("e.example", True, "", "User-agent: *\nDisallow: /x")], ROBOTS)},
        "some crawlers shut out": {"robots": t([("e.example", True, "", shut)], ROBOTS), "targets": t([(u("/"),)], "url string")},
        "styles shut": {"robots": t([("e.example", True, "", shut)], ROBOTS), "pages": pages_of(spark, {"url": u("/"), "html": '<link rel="stylesheet" href="/assets/a.css"><script src="/assets/b.js"></script><script src="/free.js"></script>'}, {"url": u("/2"), "html": '<script src="/assets/b.js"></script>'})},
        "no sitemap": {"sitemap_files": t([(u("/s.xml"), False, "HTTP 404", False)], "url string, fetched boolean, reason string, truncated boolean")},
        "some sitemaps": {"sitemap_files": t([(u("/a.xml"), True, "", True), (u("/b.xml"), False, "HTTP 500", False), (u("/c.xml"), False, "empty body", False)], "url string, fetched boolean, reason string, truncated boolean")},
        "sitemap entries": {"sitemap": t([(u(f"/{i}"),) for i in range(8)], "url string"), "pages": pages_of( spark, {"url": u("/0")}, {"url": u("/1"), "status": 404}, {"url": u("/2"), "error": "timeout", "status": None}, {"url": u("/3"), "redirects": HOP}, {"url": u("/4"), "headers": {"x-robots-tag": "none"}}, {"url": u("/5"), "html": noindex}, {"url": u("/6"), "html": '<link rel="canonical" href="/0">'}, {"url": u("/7"), "html": '<link rel="canonical" href="/7/">'}, {"url": u("/9"), "status": 404})},
        "one page": {"pages": pages_of(spark, {"url": u("/")}, {"url": u("/2"), "error": "dns"}), "skipped": t([(u("/x"), "blocked by robots.txt"), (u("/y"), "off-site"), (u("/z"), "blocked by robots.txt")], "url string, reason string")},
        "measured after consent": {"pages": pages_of(spark, {"url": u("/")}), "detections": t([("consent",), ("cms",)], "category string")},
        "not measured": {"pages": pages_of(spark, {"url": u("/")}), "detections": t([("cms",)], "category string")},
        "measured": {"pages": pages_of(spark, {"url": u("/")}), "detections": t([("tag-manager",), ("consent",)], "category string")},
        "nothing to measure": {"pages": pages_of(spark, {"url": u("/"), "error": "dns"}), "detections": t([("cms",)], "category string")},
        "llms.txt": {"llms_txt": t([(200, "# Site")], "status int, body string")},
        "llms.txt is a page": {"llms_txt": t([(200, "<!DOCTYPE html><p>x")], "status int, body string")},
        "reach": {"nodes": t([("r", 0, 0, 2, True), ("a", 1, 1, 1, True), ("b", 4, 1, 0, True), ("c", None, 0, 1, True), ("d", None, 0, 1, False), ("e", 5, 2, 3, True)], "node string, depth int, inlinks int, outlinks int, ok boolean"), "root": "r"},
        "targets of links": {"pages": pages_of(spark, {"url": u("/")}, {"url": u("/a"), "status": 404}, {"url": u("/b"), "error": "timeout", "status": None}, {"url": u("/c"), "redirects": HOP}), "outlinks": t([(u("/"), u("/a")), (u("/c"), u("/a#x")), (u("/"), u("/b")), (u("/"), u("/c")), (u("/"), u("/unknown"))], "url string, target string")},
        "answers to anything": {"pages": pages_of(spark, text(1), {"url": u("/2"), "html": "<p>" + " ".join(f"else{i}" for i in range(80)) + "</p>"}, text(3) | {"status": 404}), "probes": t([(200, LONG + " 7"), (200, LONG + " 8")], "status int, text string")},
        "honest answers": {"pages": pages_of(spark, text(1)), "probes": t([(404, LONG), (404, LONG)], "status int, text string")},
        "many queries": {"pages": pages_of(spark, *[{"url": u(f"/list?page={i}")} for i in range(5)], *[{"url": u(f"/few?page={i}")} for i in range(4)])},
        "links elsewhere": {"probed": t([("https://o.example/a", 200, None), ("https://o.example/b", 404, None), ("https://o.example/c", None, "dns")], "target string, status int, error string"), "outlinks": t([(u("/"), "https://o.example/b")], "url string, target string")},
        "same titles": {"metadata": t([(u("/1"), None, "Oak", "about oak", "Tables"), (u("/2"), None, "Oak ", "about oak", "Chairs"), (u("/3"), "k", "Elm", "x", "Stools"), (u("/4"), "k", "Elm", "y", "Benches"), (u("/5"), None, "", "", "Tables"), (u("/6"), None, "Ash", "z", "Tables")], "url string, cluster string, title string, description string, h1 string")},
        "same content": {"hashed": t([(u("/1"), None, "h1"), (u("/2"), None, "h1"), (u("/3"), "k", "h2"), (u("/4"), "k", "h2"), (u("/5"), None, ""), (u("/6"), None, ""), (u("/7"), None, "h3")], "url string, cluster string, content_hash string")},
        "near content": {"pairs": t([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string"), "clusters": t([("x", "k"), ("y", "k"), ("a", "m")], "url string, cluster string")},
    }


def of_case(tables: dict) -> list[site.SiteRule]:
    """The rule with the most tables that are all there: a case is about that one."""
    fit = [r for r in site.REGISTRY if set(r.needs) <= set(tables)]
    most = max(len(r.needs) for r in fit)
    return [r for r in fit if len(r.needs) == most]


@query(values([(name, *f) for name, found in SITE_EXPECTED.items() for f in found], "case_name, finding_id, severity, affected"))
def site_rule_cases(spark, sf_dir):
    """Every site finding on a small crawl that shows it, and on some that don't."""
    out = []
    for name, tables in site_cases(spark).items():
        # A case gives a handful of rows; they are fetched one case at a time, as one plan of all of them would be very wide.
        out += [(name, r.finding_id, r.severity, r.affected) for r in site.site_findings(spark, tables, of_case(tables)).collect()]
    return spark.createDataFrame(out, "case_name string, finding_id string, severity string, affected long")


def one_row(spark, cases: dict) -> DataFrame:
    """(case_name, value) of named columns over one row, as text."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("case_name"), v.cast("string").alias("value")) for k, v in cases.items()]))
    return spark.range(1).select(each.alias("x")).select("x.*")


def text_cases() -> dict[str, tuple]:
    """(column, made when it is called, and what it says) of functions on texts, headers and answers."""
    lit, join, words = F.lit, lambda c: F.array_join(c, "|"), lambda *x: F.array(*[F.lit(v) for v in x])
    now = lambda: F.lit("2024-01-01 00:00:00").cast("timestamp")
    decoded = lambda x, charset: F.concat_ws("/", *[S.decode_body(F.unhex(F.lit(x.hex())), F.lit(charset))[k] for k in ("text", "charset", "source")])
    headers = lambda **h: F.create_map(*[F.lit(x) for k, v in h.items() for x in (k.replace("_", "-"), v)]) if h else F.create_map().cast("map<string,string>")
    policy = lambda status, body, error: F.to_json(robots.load_policy(F.lit(status).cast("int"), F.lit(body).cast("string"), F.lit(error).cast("string")))
    return {
        "words": (lambda: join(T.words(lit("Ein Ärger, snake_case 12-3!"))), "ein|ärger|snake_case|12|3"),
        "count of words": (lambda: T.word_count(lit(" a  - b's  ... 12 ")), "3"),
        "shingles": (lambda: join(T.shingles(words("a", "b", "c", "d", "e"))), "a b c d|b c d e"),
        "shingles of few words": (lambda: join(T.shingles(words("a", "b"))), "a b"),
        "sample": (lambda: T.sample(words("a", "b", "c"), 2), "a, b (+1 more)"),
        "sample of all": (lambda: T.sample(words("a", "b"), 2), "a, b"),
        "directives": (lambda: join(F.array_sort(T.directives(words("googlebot: NOINDEX, nofollow", "max-snippet:10", "", "unknownbot: noindex")))), "max-snippet:10|nofollow|noindex|unknownbot: noindex"),
        "no hash of a short text": (lambda: T.content_hash(lit("too short")), ""),
        "hash without case and space": (lambda: T.content_hash(lit(LONG)) == T.content_hash(lit(LONG.upper().replace(" ", " \n "))), "true"),
        "sketch of a short text": (lambda: F.size(T.sketch(lit("too short"))), "0"),
        "similarity of one text": (lambda: T.similarity(T.sketch(lit(LONG)), T.sketch(lit(LONG))), "1.0"),
        "similarity of nothing": (lambda: T.similarity(T.sketch(lit("x")), T.sketch(lit(LONG))), "0.0"),
        "content type": (lambda: F.concat_ws("/", S.content_type(lit('Text/HTML; charset="UTF-8"; x=1'))["mime"], S.content_type(lit('Text/HTML; charset="UTF-8"; x=1'))["charset"]), "text/html/utf-8"),
        "no content type": (lambda: S.content_type(lit(None).cast("string"))["mime"], ""),
        "cookies": (lambda: F.to_json(S.set_cookies(words("a=1; Path=/", "b=x=y", "=none", "broken", "a=2"))), '{"b":"x=y","a":"2"}'),
        "retry after seconds": (lambda: S.retry_after(lit("120"), now()), "120.0"),
        "retry after a date": (lambda: S.retry_after(lit("Mon, 01 Jan 2024 00:01:30 GMT"), now()), "90.0"),
        "retry after a past date": (lambda: S.retry_after(lit("Sun, 31 Dec 2023 00:00:00 GMT"), now()), "0.0"),
        "retry after nothing": (lambda: F.coalesce(S.retry_after(lit("soon"), now()).cast("string"), lit("null")), "null"),
        "a byte order mark": (lambda: decoded("\ufeffhé".encode(), "iso-8859-1"), "hé/utf-8/bom"),
        "charset of the header": (lambda: decoded("hé".encode("latin-1"), "iso-8859-1"), "hé/iso-8859-1/header"),
        "charset of a tag": (lambda: decoded('<meta charset="iso-8859-1">é'.encode("latin-1"), ""), '<meta charset="iso-8859-1">é/iso-8859-1/meta'),
        "valid UTF-8": (lambda: decoded("hé".encode(), ""), "hé/utf-8/utf-8"),
        "neither": (lambda: decoded("hé".encode("latin-1"), ""), "hé/windows-1252/fallback"),
        "a challenge by header": (lambda: S.looks_blocked(headers(cf_mitigated="challenge"), lit("<p>x")), "header: cf-mitigated"),
        "a challenge by text": (lambda: S.looks_blocked(headers(), lit("<title>Just a moment...</title>")), "page: just a moment..."),
        "no challenge": (lambda: S.looks_blocked(headers(server="x"), lit("<p>welcome")), ""),
        "robots of status 404": (lambda: policy(404, "x", None), '{"fetched":false,"error":"","body":""}'),
        "robots of status 503": (lambda: policy(503, "x", None), '{"fetched":false,"error":"HTTP 503","body":""}'),
        "robots after a timeout": (lambda: policy(None, None, "timeout"), '{"fetched":false,"error":"timeout","body":""}'),
        "robots of status 200": (lambda: policy(200, "User-agent: *", None), '{"fetched":true,"error":"","body":"User-agent: *"}'),
        "crawler of an agent": (lambda: U.product_token(lit("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)")), "googlebot"),
        "crawler by itself": (lambda: U.product_token(lit("GPTBot/1.0 (+https://x)")), "gptbot"),
        "normal form": (lambda: U.normalize(lit("HTTP://User@Example.COM:80/a%7Eb;jsessionid=1?utm_source=x&b=2&a=1#top")), "http://example.com/a~b?a=1&b=2"),
        "resolved upwards": (lambda: U.resolve(lit("https://e.example/a/b/c?x=1"), lit("../d?y=2#z")), "https://e.example/a/d?y=2"),
        "resolved without scheme": (lambda: U.resolve(lit("https://e.example/a"), lit("//cdn.example/x.js")), "https://cdn.example/x.js"),
        "resolved query": (lambda: U.resolve(lit("https://e.example/a/b"), lit("?page=2")), "https://e.example/a/b?page=2"),
        "off-site": (lambda: U.reason_to_skip(lit("https://other.example/"), "https://www.e.example/"), "off-site"),
        "www is the same site": (lambda: U.reason_to_skip(lit("https://www.e.example/"), "https://e.example/"), ""),
        "a subdomain isn't": (lambda: U.reason_to_skip(lit("https://a.e.example/"), "https://e.example/"), "off-site"),
        "unless included": (lambda: U.reason_to_skip(lit("https://a.e.example/"), "https://e.example/", True), ""),
        "metric as a share": (lambda: compare.format_metric(lit(0.256), lit("pct")), "26%"),
        "metric as a whole number": (lambda: compare.format_metric(lit(12.0), lit("int")), "12"),
        "metric with a fraction": (lambda: compare.format_metric(lit(12.5), lit("num")), "12.5"),
        "metric without one": (lambda: compare.format_metric(lit(12.0), lit("num")), "12"),
        "rating": (lambda: F.concat_ws("/", rules.rating("cls", lit(0.1)), rules.rating("cls", lit(0.25)), rules.rating("cls", lit(0.26)), rules.rating("cls", lit(None).cast("double"))), "good/needs-improvement/poor/unknown"),
        "start address": (lambda: lit("|".join(U.normalize_target(x) for x in ("e.example", " https://e.example/x ", "localhost:8000"))), "https://e.example|https://e.example/x|https://localhost:8000"),
        "kinds of errors": (lambda: lit("|".join(http.error_kind(e) for e in (TimeoutError(), OSError("Name or service not known"), ConnectionResetError(), ValueError("x")))), "timeout|dns|connection|other"),
        "kinds of sitemaps": (lambda: F.concat_ws("|", *[sitemap.kind(lit(x)) for x in ("<?xml version='1.0'?><!-- c --><s:urlset xmlns:s='x'>", "<sitemapindex>", "https://e.example/\nx", "<html>", "")]), "urlset|sitemapindex|text|unknown|unknown"),
        "grades": (lambda: F.concat_ws("", *[score.grade(lit(x)) for x in (90.0, 89.9, 70.0, 60.0, 50.0, 49.9)]), "ABCDEF"),
    }


@query(values([(k, v) for k, (_, v) in text_cases().items()], "case_name, value"))
def function_cases(spark, sf_dir):
    """Functions on texts, headers, answers and addresses, with their odd cases."""
    return one_row(spark, {k: column() for k, (column, _) in text_cases().items()})


RICH = """<!doctype html><html lang="pt-PT"><head><base href="/shop/"><meta charset="ISO-8859-1"><title>Mesas</title><meta name="description" content="Mesas &amp; cadeiras"><meta name="robots" content="max-snippet:20"><meta name="generator" content="Acme 3">
<meta name="viewport" content="width=device-width"><meta property="og:title" content="OG"><meta property="og:image" content="o.jpg"><link rel="canonical" href="mesas"><link rel="alternate" hreflang="en" href="/en"><link rel="stylesheet" href="a.css"><link rel="shortcut icon" href="/f.ico">
<script src="b.js"></script><script async src="/c.js"></script><script type="application/ld+json">{"@type":["Product","Thing"],"offers":{"@type":"Offer"}}</script></head>
<body><!-- <h1>no</h1> --><h1>Mesas <b>novas</b></h1><h3>Medidas</h3><p>Duas mesas, tr&ecirc;s cadeiras</p><noscript><p>no</p></noscript><a href="x?b=1#c" rel="NoFollow">Ver  tudo</a><a href="https://o.example/"><img src="i.png" alt="Outra"></a><a href="mailto:a@b">m</a>
<img data-src="late.jpg" aria-label="Nome"><img src="p.gif" width="1" height="1" alt=""><iframe src="//v.example/1"></iframe><div id="root" itemscope></div></body></html>"""
#: What the page holds, by name: an expression over doc, url and html, and its text.
EXTRACTED = {
    "base address": ("doc.base_url", "https://e.example/shop/"),
    "titles": ("array_join(doc.titles, '|')", "Mesas"),
    "description": ("doc.description", "Mesas & cadeiras"),
    "robots": ("doc.robots", "max-snippet:20"),
    "generator": ("doc.generator", "Acme 3"),
    "viewport": ("doc.viewport", "width=device-width"),
    "property": ("doc.og_title", "OG"),
    "canonical": ("array_join(doc.canonicals, '|')", "https://e.example/shop/mesas"),
    "canonical as written": ("array_join(doc.canonicals_raw, '|')", "mesas"),
    "alternates": ("to_json(doc.hreflangs)", '[{"lang":"en","raw":"/en","url":"https://e.example/en"}]'),
    "styles": ("array_join(doc.stylesheets, '|')", "https://e.example/shop/a.css"),
    "icons": ("array_join(doc.favicons, '|')", "https://e.example/f.ico"),
    "language": ("doc.lang", "pt-PT"),
    "encoding": ("doc.charset_meta", "iso-8859-1"),
    "scripts": ("array_join(transform(doc.scripts, s -> concat_ws(' ', s.url, s.async, s.in_head)), '|')", "https://e.example/shop/b.js false true|https://e.example/c.js true true| false true"),
    "embeds": ("array_join(doc.embeds, '|')", "https://v.example/1"),
    "noscript": ("doc.has_noscript", "true"),
    "headings": ("array_join(transform(doc.headings, h -> concat(h.level, ' ', h.text)), '|')", "1 Mesas novas|3 Medidas"),
    "links": ("array_join(transform(doc.links, x -> concat_ws(' ', x.url, x.anchor, x.internal, x.nofollow)), '|')", "https://e.example/shop/x?b=1 Ver tudo true true|https://o.example/ Outra false false"),
    "images": ("array_join(transform(doc.images, i -> concat_ws(' ', i.url, coalesce(i.alt, 'null'), i.aria_label)), '|')", "https://e.example/shop/i.png Outra |https://e.example/shop/late.jpg null Nome|https://e.example/shop/p.gif  "),
    "types": ("array_join(types, '|')", "Offer|Product|Thing"),
    "microdata": ("doc.microdata", "true"),
    "a shell": ("doc.app_shell", "true"),
    "bytes add up": ("doc.markup_bytes + doc.embedded_bytes = doc.bytes", "true"),
    "embedded bytes": ("doc.embedded_bytes", str(sum(len(x) for x in ('<script src="b.js"></script>', '<script async src="/c.js"></script>', '<script type="application/ld+json">{"@type":["Product","Thing"],"offers":{"@type":"Offer"}}</script>')))),
    "counts of headings": ("to_json(summary.heading_counts)", '{"h1":1,"h2":0,"h3":1,"h4":0,"h5":0,"h6":0}'),
    "links of the summary": ("concat_ws(' ', summary.links_total, summary.links_internal, summary.links_external, summary.links_nofollow)", "2 1 1 1"),
    "images of the summary": ("concat_ws(' ', summary.images_total, summary.images_missing_alt, summary.images_decorative)", "3 1 1"),
    "preview of the summary": ("summary.og_image", "https://e.example/shop/o.jpg"),
    "resources of the summary": ("array_join(summary.resources, '|')", "https://e.example/shop/a.css|https://e.example/shop/b.js|https://e.example/c.js"),
    "worth rendering": ("render", "little text in an application shell"),
    "predicates of images": ("array_join(flags, '|')", "false false|true false|false true"),
    "blocking scripts": ("size(filter(doc.scripts, s -> s.src <> '' and s.in_head and not s.async and not s.defer and s.type <> 'module'))", "1"),
}


@query(values([(k, v) for k, (_, v) in EXTRACTED.items()], "case_name, value"))
def extract_cases(spark, sf_dir):
    """Everything that is read off one page that has it all."""
    one = H.document(spark.createDataFrame([("https://e.example/index", RICH)], "url string, html string"))
    doc = F.col("doc")
    full = one.select("doc", H.summary(doc).alias("summary"), H.should_render(doc).alias("render"), H.schema_types(doc["json_ld"]).alias("types"), F.transform(doc["images"], lambda i: F.concat_ws(" ", H.image_named(i) != "", H.image_pixel(i))).alias("flags"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("case_name"), F.expr(f"cast({e} as string)").alias("value")) for k, (e, _) in EXTRACTED.items()]))
    return full.select(each.alias("x")).select("x.*")


#: (kind of signal, what the page shows, technology, confidence, version)
SIGNALS = (
    ("header", {"headers": {"server": "nginx/1.25"}}, "nginx", 1.0, "1.25"),
    ("cookie", {"cookies": {"PHPSESSID": "1"}}, "PHP", 0.9, ""),
    ("js", {"js_globals": ["Shopify"]}, "Shopify", 0.9, ""),
    ("url", {"url": "https://e.example/a.aspx?x"}, "ASP.NET", 0.8, ""),
    ("meta", {"html": '<meta name="generator" content="Hugo 0.120">'}, "Hugo", 1.0, "0.120"),
    ("bundle", {"bundles": "..googletagmanager.com/gtm.js.."}, "Google Tag Manager", 0.8, ""),
    ("html", {"html": "<p>var u='https://static.hotjar.com/c/hotjar-1.js'</p>"}, "Hotjar", 1.0, ""),
    ("script", {"html": '<script src="/js/jquery-3.7.1.min.js"></script>'}, "jQuery", 0.9, "3.7.1"),
    ("stylesheet", {"html": '<link rel="stylesheet" href="/css/bulma.min.css">'}, "Bulma", 0.9, ""),
    ("dom", {"html": '<html data-wf-site="64">'}, "Webflow", 1.0, ""),
    ("two signals", {"cookies": {"csrftoken": "x"}, "html": '<input name="csrfmiddlewaretoken">'}, "Django", 0.97, ""),
    ("a weak signal", {"js_globals": ["M"]}, None, None, None),
    ("case counts", {"html": "<noscript>googletagmanager.com/ns.html?id=gtm-x</noscript>"}, None, None, None),
)


@query(values([(c, *rest) for c, _, *rest in SIGNALS if rest[0]], "case_name, technology, confidence, version"))
def signal_cases(spark, sf_dir):
    """Every kind of signal, two that add up, and two that don't suffice."""
    sound = {"url": "https://e.example/", "html": "<p>text</p>", "headers": {}, "cookies": {}, "js_globals": [], "bundles": ""}
    names = "case_name string, url string, html string, headers map<string,string>, cookies map<string,string>, js_globals array<string>, bundles string"
    pages = rules.with_defaults(spark.createDataFrame([tuple(({"case_name": c} | sound | shows)[n.split()[0]] for n in names.split(", ")) for c, shows, *_ in SIGNALS], names))
    numbered = pages.withColumn("site", F.col("case_name"))
    return technology.combine(technology.signals(numbered), ["site"]).select(F.col("site").alias("case_name"), "technology", "confidence", "version")


SITE_PAGES = [  # site, words, title, description, links, inlinks, depth, orphan, https, encoding, http_version, ttfb_ms, bytes, schema
    ("rich", 900, "Handmade oak tables", "d", 10, 4, 0, False, True, "br", "HTTP/2", 100.0, 20480, 1),
    ("rich", 700, "Oak chairs", "d", 6, 2, 1, False, True, "gzip", "HTTP/2", 300.0, 10240, 1),
    ("rich", 200, "Contact", "", 2, 2, 2, True, True, "br", "HTTP/3", 200.0, 30720, 0),
    ("poor", 100, "", "", 1, 0, 0, False, False, "", "HTTP/1.1", 900.0, 5120, 0),
    ("poor", 50, "Home", "", 0, 1, 3, True, False, "", "HTTP/1.0", 700.0, 0, 0),
]
#: metric: (rich, poor, which is the better)
SITE_METRICS = {
    "pages_crawled": (3.0, 2.0, "rich"), "median_words": (700.0, 75.0, "rich"), "thin_share": (0.333, 1.0, "rich"), "structured_data_share": (0.667, 0.0, "rich"), "missing_title_share": (0.0, 0.5, "rich"), "missing_description_share": (0.333, 1.0, "rich"),
    "median_title_length": (10.0, 4.0, "rich"), "links_per_page": (6.0, 0.5, "rich"), "median_inlinks": (2.0, 0.5, "rich"), "max_click_depth": (2.0, 3.0, "rich"), "orphan_share": (0.333, 0.5, "rich"), "https_share": (1.0, 0.0, "rich"),
    "compression_share": (1.0, 0.0, "rich"), "http2_share": (1.0, 0.0, "rich"), "median_ttfb_ms": (200.0, 800.0, "rich"), "median_html_kb": (20.0, 5.0, "poor"),
}


@query(values([(s, m, v[i], v[2] == s) for m, v in SITE_METRICS.items() for i, s in enumerate(("rich", "poor"))], "site, metric, value, best"))
def site_metric_cases(spark, sf_dir):
    """All metrics of two small sites, and which is the better at each."""
    rows = spark.createDataFrame(SITE_PAGES, "site string, words int, title string, description string, links int, inlinks int, depth int, orphan boolean, https boolean, encoding string, http_version string, ttfb_ms double, bytes long, schema int")
    return compare.metric_table(compare.site_metrics(rows))


COMPARED = [("us", "title", 100.0), ("us", "links", 60.0), ("us", "images", 95.0), ("us", "url", 50.0), ("one", "title", 94.0), ("one", "links", 70.0), ("one", "images", 91.0), ("one", "url", 54.9), ("two", "title", 90.0), ("two", "links", 80.0), ("two", "images", 20.0), ("two", "url", 55.0)]


@query(values([("gap", "links", 60.0, 80.0, "two"), ("strength", "title", 100.0, 94.0, "")], "kind, category, mine, theirs, rival"))
def comparison_cases(spark, sf_dir):
    """Categories where a rival, or the target, is ahead by more than five points."""
    rows = spark.createDataFrame(COMPARED, "site string, category string, score double")
    gaps = compare.category_gaps(rows, "us").select(F.lit("gap").alias("kind"), "category", "mine", "theirs", "rival")
    return gaps.unionByName(compare.strengths(rows, "us").select(F.lit("strength").alias("kind"), "category", "mine", F.col("best_rival").alias("theirs"), F.lit("").alias("rival")))


@query(values([("FAQPage", "one,two", 2), ("Recipe", "two", 1)], "label, rivals, n"))
def schema_gap_cases(spark, sf_dir):
    """Types that rivals mark up and the target doesn't, the most common first."""
    rows = spark.createDataFrame([("us", "Product"), ("one", "Product"), ("one", "FAQPage"), ("two", "FAQPage"), ("two", "Recipe")], "site string, label string")
    return compare.gap_order(compare.gaps(rows, "us")).select("label", "rivals", F.col("n").cast("long").alias("n"))


@query(values([("/a", "/b"), ("/b", "/a"), ("/b", "/c"), ("/c", "/a")], "src, dst"))
def graph_build_cases(spark, sf_dir):
    """Edges between where pages land: redirects followed, loops, repeats and links to unknown pages dropped."""
    pages = spark.createDataFrame([(u(a), u(b)) for a, b in (("/a", "/a"), ("/b", "/b"), ("/old", "/older"), ("/older", "/c"), ("/c", "/c"))], "requested_url string, final_url string")
    links = spark.createDataFrame([(u(a), u(b)) for a, b in (("/a", "/b#x"), ("/a", "/b"), ("/a", "/a?utm_source=x"), ("/b", "/a"), ("/b", "/old"), ("/old", "/a"), ("/c", "/nowhere"))], "url string, target string")
    edges = graph.build(pages, links)[1]
    bare = lambda c: F.regexp_replace(c, "^https://e.example", "").alias(c)
    return edges.select(bare("src"), bare("dst"))


ADMITTED = (("/new", 1, ""), ("/seen", 1, "seen"), ("/deep", 9, "too deep"), ("/also", 1, ""), ("/late", 2, "over budget"), ("mailto:x@y", 1, "unsupported scheme"))


@query(values([(a, why) for a, _, why in ADMITTED], "address, reason"))
def admission_cases(spark, sf_dir):
    """Why a frontier turns an address away, in the order of the checks."""
    rows = spark.createDataFrame([(u(a) if a.startswith("/") else a, d) for a, d, _ in ADMITTED], "url string, depth int")
    seen = spark.createDataFrame([(u("/seen"),)], "norm string")
    return sitemap.admit(rows, seen, "https://e.example/", 3, 2).select(F.regexp_replace("url", "^https://e.example", "").alias("address"), "reason")


FOUND = (("title.missing", "critical", "/a"), ("links.none", "warning", "/b"), ("links.none", "warning", "/a"), ("robots.missing", "notice", None), ("structured.present", "info", "/a"))


def _found(spark):
    return spark.createDataFrame([(i, s, i.split(".")[0], u(p) if p else None, "m", "e", "f") for i, s, p in FOUND], "finding_id string, severity string, category string, url string, message string, evidence string, fix string")


@query(values([("critical", 1), ("warning", 1), ("none", 0), ("no pages", 1)], "case_name, code"))
def exit_code_cases(spark, sf_dir):
    f = _found(spark)
    codes = [("critical", report.exit_code(f, f)), ("warning", report.exit_code(f.where("severity <> 'critical'"), f, "warning")), ("none", report.exit_code(f.where("severity = 'info'"), f, "notice")), ("no pages", report.exit_code(f.where("false"), f.where("false")))]
    return spark.createDataFrame(codes, "case_name string, code long")


@query(values([(1, "title.missing", "https://e.example/a"), (2, "links.none", "https://e.example/a"), (3, "links.none", "https://e.example/b"), (4, "robots.missing", "https://e.example/"), (5, "structured.present", "https://e.example/a")], "position, finding_id, url"))
def report_rows_cases(spark, sf_dir):
    """The rows of the CSV report in their order; findings of the site carry its address."""
    rows = [(i + 1, r.finding_id, r.url) for i, r in enumerate(report.csv_rows(_found(spark), "https://e.example/").collect())]
    return spark.createDataFrame(rows, "position long, finding_id string, url string")


@query(values([("/", "https://e.example/a|https://e.example/b?x=1", "https://o.example/x"), ("/sub", "https://www.e.example/a", "")], "page, inside, outside"))
def scope_cases(spark, sf_dir):
    """Links in normal form, each once, in the order of the page, by whether they stay in the site."""
    first = '<a href="/a">1</a><a href="https://o.example/x">2</a><a href="/b?x=1&utm_source=y">3</a><a href="/a#top">4</a><a href="mailto:x@y">5</a><a href="ftp://e.example/f">6</a>'
    pages = pages_of(spark, {"url": u("/"), "html": first}, {"url": u("/sub"), "html": '<a href="https://WWW.e.example/a">1</a>'})
    found = crawl.outlinks(crawl.links(pages, "https://e.example/"))
    return found.select(F.regexp_replace("url", "^https://e.example", "").alias("page"), F.array_join("outlinks", "|").alias("inside"), F.array_join("external_links", "|").alias("outside"))


@query(values([("https://a.example/",), ("https://b.example/",)], "target"))
def external_target_cases(spark, sf_dir):
    """The first addresses outside of the site, in order, each once."""
    pages = pages_of(spark, {"url": u("/1"), "html": '<a href="https://c.example">1</a><a href="https://b.example/#x">2</a>'}, {"url": u("/2"), "html": '<a href="https://b.example/">1</a><a href="https://a.example/">2</a><a href="/in">3</a>'})
    return crawl.external_targets(crawl.links(pages), 2)


@query(values([("/1", "render.content_requires_js"), ("/1", "render.links_require_js"), ("/1", "render.title_requires_js"), ("/2", "render.failed")], "page, finding_id"))
def render_diff_cases(spark, sf_dir):
    """Documents before and after rendering, joined and judged."""
    before = pages_of(spark, {"url": u("/1"), "html": "<div id=app></div>"}, {"url": u("/2")}, {"url": u("/3")})
    after = pages_of(spark, {"url": u("/1"), "html": f"<title>Tables</title><p>{LONG}</p><a href=/x>x</a>"}, {"url": u("/2"), "error": "timeout", "html": None}, {"url": u("/4")})
    found = rules.findings(crawl.render_diff(before, after.select("url", "doc", "error"))).where("category = 'render'")
    return found.select(F.regexp_replace("url", "^https://e.example", "").alias("page"), "finding_id")


#: (page, whether a search engine would take it)
INDEXABLE = (
    ({}, True), ({"status": 404}, False), ({"error": "timeout"}, False), ({"html": "<meta name=robots content=noindex>"}, False), ({"headers": {"x-robots-tag": "none"}}, False), ({"html": '<link rel="canonical" href="/other">'}, False),
    ({"html": '<link rel="canonical" href="/5?utm_source=x">'}, False), ({"html": '<link rel="canonical" href="/7?utm_source=x">'}, True),
)


@query(values([(i,) for i, (_, ok) in enumerate(INDEXABLE) if ok], "page_id"))
def indexable_cases(spark, sf_dir):
    return crawl.indexable(pages_of(spark, *[{"url": u(f"/{i}")} | r for i, (r, _) in enumerate(INDEXABLE)])).select("page_id")


@query(values([("page for an address", "2"), ("known nodes", "https://e.example/a=1,https://e.example/b=1,https://e.example/c=2"), ("top-up", "https://e.example/n,https://e.example/o"), ("quota", "true,true,true,false,false")], "case_name, value"))
def lookup_cases(spark, sf_dir):
    """A page by its address, the pages that addresses stand for, what a sitemap adds once links run out, and what it may add before."""
    pages = spark.createDataFrame([(1, u("/a"), u("/b")), (2, u("/b"), u("/c")), (3, u("/c"), u("/c"))], "page_id long, requested_url string, final_url string")
    asked = crawl.page_for(pages.withColumn("url", F.col("final_url")), "https://E.example/b#x").select(F.lit("page for an address").alias("case_name"), F.col("page_id").cast("string").alias("value"))
    # Asked for counts before landed at: /b is the second page's, and /a only the first one's.
    known = crawl.known_nodes(pages.where("page_id < 3").unionByName(spark.createDataFrame([(1, u("/b"), u("/b"))], "page_id long, requested_url string, final_url string")))
    nodes = known.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "url", "page_id"))), ",").alias("value")).select(F.lit("known nodes").alias("case_name"), "value")
    entries = spark.createDataFrame([("s", i, u(p)) for i, p in enumerate(("/a", "/n", "/n#x", "/o", "/p"))], "source string, pos int, loc string")
    more = crawl.topped_up(entries, spark.createDataFrame([(u("/a"),)], "norm string"), 2).agg(F.array_join(F.array_sort(F.collect_list("loc")), ",").alias("value")).select(F.lit("top-up").alias("case_name"), "value")
    asked_first = crawl.quota(spark.createDataFrame([("s", i, i != 1) for i in range(5)], "source string, pos int, admitted boolean"), 8)
    first = asked_first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "now"))), lambda x: x["now"].cast("string")), ",").alias("value")).select(F.lit("quota").alias("case_name"), "value")
    return asked.unionByName(nodes).unionByName(more).unionByName(first)


def in_order(df: DataFrame, column: str) -> str:
    """A column's values in the order of the rows, of a small ordered table."""
    return ",".join(str(r[0]) for r in df.select(column).collect())


ORDERS = {
    "detections": "b,a,c",
    "technologies by category": "cdn: a; server: b, c",
    "categories": "url,title,links",
    "deductions": "y,x,z",
    "vitals": "p1",
    "deep pages": "d,b",
    "parameter paths": "/b,/c,/a",
    "findings": "title.missing,links.none,links.none,robots.missing,structured.present",
    "grouped": "links.none 2 false https://e.example/a|https://e.example/b; robots.missing 1 true ; structured.present 1 false https://e.example/a; title.missing 1 false https://e.example/a",
    "short address": "/tables?x=1",
    "long address": "/" + "x" * 66 + "…",
    "headers of a cache": '{"etag":"x"}',
    "no headers of a cache": "{}",
    "time": "2024-01-02T03:04:05+00:00",
}


@query(values(list(ORDERS.items()), "case_name, value"))
def order_cases(spark, sf_dir):
    """The orders in which reports list things, and how they write them."""
    t = spark.createDataFrame
    found = t([("a", "cdn", 0.9), ("b", "server", 1.0), ("c", "server", 0.9)], "technology string, category string, confidence double")
    of_category = crawl.by_category(found).orderBy("category").select(F.concat("category", F.lit(": "), F.array_join("technologies", ", ")).alias("x"))
    grouped = crawl.grouped_findings(_found(spark)).orderBy("finding_id").select(F.concat_ws(" ", "finding_id", "n", "site_wide", F.array_join("urls", "|")).alias("x"))
    one = lambda c: in_order(spark.range(1).select(c.alias("x")), "x")
    got = {
        "detections": in_order(crawl.detections_in_order(found), "technology"),
        "technologies by category": in_order(of_category, "x").replace(",server", "; server"),
        "categories": in_order(crawl.categories_in_order(t([("title", 50.0, 2.0), ("links", 90.0, 1.0), ("url", 40.0, 0.5)], "category string, score double, weight double")), "category"),
        "deductions": in_order(crawl.deductions_in_order(t([("x", 5.0), ("y", 9.0), ("z", 5.0)], "finding_id string, points double")), "finding_id"),
        "vitals": in_order(crawl.measured_first(t([("p1", 0.5), ("p2", 0.4)], "node string, pagerank double"), 0), "node"),
        "deep pages": in_order(crawl.deepest_first(t([("a", 3), ("b", 4), ("c", None), ("d", 7)], "node string, depth int")), "node"),
        "parameter paths": in_order(crawl.worst_paths(t([("h", "/a", 5), ("h", "/b", 9), ("h", "/c", 9)], "host string, path string, variants int")), "path"),
        "findings": in_order(crawl.findings_in_order(_found(spark)), "finding_id"),
        "grouped": "; ".join(r[0] for r in grouped.collect()),
        "short address": one(crawl.shortened(F.lit("https://e.example/tables?x=1"))),
        "long address": one(crawl.shortened(F.lit("https://e.example/" + "x" * 80))),
        "headers of a cache": one(F.to_json(crawl.headers_of(F.lit('{"etag":"x"}')))),
        "no headers of a cache": one(F.to_json(crawl.headers_of(F.lit("broken")))),
        "time": one(crawl.utc_text(F.lit("2024-01-02 03:04:05").cast("timestamp"))),
    }
    return t(list(got.items()), "case_name string, value string")


#: (answer, what becomes of it)
ANSWERS = (
    ((200, {"content-type": "text/html; charset=iso-8859-1"}, "h\xe9".encode("latin-1"), None), "text/html iso-8859-1 header - hé"),
    ((200, {"content-type": "application/pdf"}, b"%PDF", None), "application/pdf   - "),
    ((403, {"content-type": "text/html", "cf-mitigated": "challenge"}, b"<p>x", None), "text/html utf-8 utf-8 blocked <p>x"),
    ((None, {}, None, "timeout"), "   timeout "),
    ((200, {"content-type": "text/html", "set-cookie": "a=1; Path=/\nb=2"}, b"<p>c", None), "text/html utf-8 utf-8 - <p>c a=1,b=2"),
    ((200, {}, b"<html>", None), "text/html utf-8 utf-8 - <html>"),
)


@query(values([(i, v) for i, (_, v) in enumerate(ANSWERS)], "page_id, value"))
def record_cases(spark, sf_dir):
    """Raw answers as page records: type, encoding and where it was read, error, text, cookies."""
    answers = spark.createDataFrame([(i, u(f"/{i}"), u(f"/{i}"), *a) for i, (a, _) in enumerate(ANSWERS)], "page_id long, requested_url string, final_url string, status int, headers map<string,string>, body binary, error string")
    got = S.record(answers)
    cookies = F.array_join(F.transform(F.map_entries("cookies"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return got.select("page_id", F.concat_ws(" ", "mime", "charset", "charset_source", F.coalesce("error", F.when(F.col("status").isNotNull(), "-")), F.coalesce("html", F.lit("")), F.nullif(cookies, F.lit(""))).alias("value"))


PAGE_SPEED = '{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":2100}}},"originLoadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":3000},"FIRST_CONTENTFUL_PAINT_MS":{"percentile":900}}},"lighthouseResult":{"categories":{"performance":{"score":0.83}}}}'


@query(values([("psi", "page", "lcp_ms", 2100.0), ("psi", "page", "fcp_ms", 900.0), ("psi", "page", "performance", 0.83), ("open_page_rank", "domain", "open_page_rank", 4.5), ("moz", "domain", "domain_authority", 40.0), ("moz", "domain", "spam_score", 1.0)], "provider, level, metric, value"))
def provider_cases(spark, sf_dir):
    """Figures of providers from their answers, those of the page before those of its origin; broken answers give none."""
    answers = [("psi", u("/"), PAGE_SPEED), ("open_page_rank", u("/"), '{"response":[{"page_rank_decimal":4.5}]}'), ("moz", u("/"), '{"results":[{"domain_authority":40,"spam_score":1}]}'), ("psi", u("/x"), "{broken"), ("unknown", u("/"), "{}")]
    return providers.metrics(spark.createDataFrame(answers, "provider string, url string, body string")).select("provider", "level", "metric", "value")


@query(values([("psi", True, True, ""), ("open_page_rank", False, True, "set opr_key"), ("moz", True, False, "")], "provider, available, free, note"))
def provider_status_cases(spark, sf_dir):
    return providers.statuses(spark, {"moz_token": "x"})


CHAIN = [(f"/{i}", f"/{i + 1}") for i in range(600)]


@query(values([("/0", "/600"), ("/599", "/600"), ("/x", "/y")], "url, final"))
def long_redirect_cases(spark, sf_dir):
    """A chain of 600 hops is followed to its end."""
    got = graph.resolve_redirects(spark.createDataFrame([*CHAIN, ("/x", "/y")], "url string, final string"))
    return got.where("url in ('/0', '/599', '/x')").select("url", "final")


@query("SELECT * FROM (VALUES (1, true, '*', NULL), (2, true, 'googlebot', 2.0::DOUBLE), (2, true, 'bingbot', 2.0::DOUBLE), (3, true, 'gptbot', NULL)) v(\"group\", declared, agent, delay)")
def robots_groups(spark, sf_dir):
    files = spark.createDataFrame([("x.example", RULES_FILE)], "host string, body string")
    return robots.agents(files).join(robots.delays(files), ["host", "group"], "left").select(F.col("group").cast("int").alias("group"), F.lit(True).alias("declared"), "agent", "delay")


_HEADINGS = [(1, [1, 2, 3]), (2, [1, 3, 4, 6]), (3, [2]), (4, []), (5, [4, 1, 3, 2, 4])]


@query("WITH h(id, levels) AS (VALUES " + ", ".join(f"({i}, {v}::INT[])" for i, v in _HEADINGS) + "), p AS (SELECT id, levels, unnest(range(2, len(levels) + 1)) AS i FROM h) SELECT id, 'h' || levels[i - 1] || '->h' || levels[i] AS skip FROM p WHERE levels[i] > levels[i - 1] + 1")
def heading_skips(spark, sf_dir):
    rows = spark.createDataFrame(_HEADINGS, "id int, levels array<int>")
    return rows.select("id", F.explode(rules.skips(F.transform("levels", lambda x: F.struct(x.alias("level"))))).alias("skip"))


_DIRECTIVES = [(1, "noindex, NOFOLLOW"), (2, "googlebot: noindex,  max-snippet:10"), (3, " , none ,"), (4, "otherthing: noindex"), (5, "")]


@query("WITH d(id, v) AS (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in _DIRECTIVES) + r") SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(v, '^\s*(googlebot|bingbot|robots)\s*:', '', 'i'), ','), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS directives FROM d")
def directive_parse(spark, sf_dir):
    rows = spark.createDataFrame(_DIRECTIVES, "id int, v string")
    return rows.select("id", F.array_join(F.array_sort(T.directives(F.array("v"))), "|").alias("directives"))
