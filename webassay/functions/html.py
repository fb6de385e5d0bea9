"""Extraction from HTML as Columns.

Pages are cut by regular expressions in a fixed order: comments first, then
raw-text elements, then tags. No closing tag is ever required, as pages come
truncated. ``document()`` adds one ``doc`` struct to a table of pages; it is
built in layers, so each array of tags is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webassay.functions import text as T
from webassay.functions import urls as U

#: Entities that are decoded, & last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&#160;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&laquo;": "«", "&raquo;": "»", "&amp;": "&"}
NOT_FOLLOWED = "javascript:|mailto:|tel:|data:|sms:|callto:"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once, whatever ``body`` does with it."""
    return F.transform(F.array(value), body)[0]


def unescape(s: Column) -> Column:
    def decode(x: Column) -> Column:
        out = x
        for entity, sign in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(sign))
        return F.when(x.contains("&"), out).otherwise(x)

    return _let(s, decode)


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag: null if absent, empty if without value.

    The tag is read from its start, past other attributes and their quoted
    values, so a name inside a value isn't taken for one.
    """
    found = rf"(?is)^<(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s{name}(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s=/>]|$))"
    return F.when(tag.rlike(found), unescape(F.regexp_replace(F.regexp_extract(tag, found, 1), "^[\"']|[\"']$", "")))


def attr_or_empty(tag: Column, name: str) -> Column:
    return F.trim(F.coalesce(attr(tag, name), F.lit("")))


def tags(html: Column, name: str) -> Column:
    """Start tags of an element, or of several joined by |."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{name})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))


def strip_tags(s: Column, by: str = "") -> Column:
    return F.regexp_replace(s, r"(?s)<[^>]*>", by)


def inner(s: Column) -> Column:
    """Text inside markup, joined by nothing."""
    return T.squeeze(unescape(strip_tags(s)))


def without(html: Column, names: str) -> Column:
    """HTML without the named elements and their content; an unclosed one runs to the end."""
    return F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?(?:</\1\s*>|\z)", " ")


def visible_text(bare: Column) -> Column:
    """Text of the body: raw-text elements and the head are gone, nodes are joined by a space."""
    body = F.regexp_replace(without(bare, "script|style|noscript|template|svg"), r"(?is)<head\b[^>]*>.*?</head\s*>", " ")
    return T.squeeze(unescape(strip_tags(body, " ")))


def markup_bytes(html: Column) -> Column:
    return F.octet_length(F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", ""), r"(?is)<style\b[^>]*>.*?</style\s*>", ""))


def tokens(value: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"\s+"), lambda t: t != "")


def document(pages: DataFrame, html: str = "html", url: str = "url", fields: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` with a struct ``doc`` of everything that the rules look at, or only of ``fields``: what they don't need isn't extracted."""
    keep = pages.columns
    raw, page_url = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    one = pages.withColumn("__bare", F.regexp_replace(raw, r"(?s)<!--.*?(?:-->|\z)", " "))
    code = F.col("__bare")
    # Tags inside scripts and styles are text; titles inside svg and math belong to pictures.
    two = (
        one.withColumn("__markup", without(code, "script|style|noscript|template"))
        .withColumn("__scripts", F.regexp_extract_all(code, F.lit(r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)"), F.lit(0)))
        .withColumn("__head_end", F.instr(F.lower(code), "</head"))
    )
    m = F.col("__markup")
    three = (
        two.withColumn("__metas", F.transform(tags(m, "meta"), lambda t: F.struct(F.lower(attr_or_empty(t, "name")).alias("name"), F.lower(attr_or_empty(t, "property")).alias("property"), F.lower(attr_or_empty(t, "charset")).alias("charset"), attr_or_empty(t, "content").alias("content"))))
        .withColumn("__link_tags", F.transform(tags(m, "link"), lambda t: F.struct(tokens(attr(t, "rel")).alias("rel"), attr_or_empty(t, "href").alias("href"), attr_or_empty(t, "hreflang").alias("hreflang"))))
        .withColumn("__base", F.coalesce(attr_or_empty(F.get(tags(m, "base"), 0), "href"), F.lit("")))
        .withColumn("__titles", F.transform(F.regexp_extract_all(without(m, "svg|math"), F.lit(r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"), F.lit(1)), lambda t: T.squeeze(unescape(t))))
        .withColumn("__heads", F.transform(F.regexp_extract_all(m, F.lit(r"(?is)<h[1-6](?=[\s>])[^>]*>.*?(?:</h[1-6]\s*>|\z)"), F.lit(0)), lambda t: F.struct(F.substring(t, 3, 1).cast("int").alias("level"), inner(t).alias("text"))))
        .withColumn("__anchors", F.regexp_extract_all(m, F.lit(r"(?is)<a(?=\s)[^>]*>.*?(?:</a\s*>|(?=<a\s)|\z)"), F.lit(0)))
        .withColumn("__imgs", tags(m, "img"))
        .withColumn("__text", visible_text(code))
    )
    base = F.when(F.col("__base") != "", U.resolve(page_url, F.col("__base"))).otherwise(page_url)
    four = three.withColumn("__base", base)
    b = F.col("__base")
    meta = lambda name: F.coalesce(F.get(F.filter("__metas", lambda x: x["name"] == name), 0)["content"], F.lit(""))
    prop = lambda name: F.coalesce(F.get(F.filter("__metas", lambda x: x["property"] == name), 0)["content"], F.lit(""))
    rel = lambda *names: F.filter("__link_tags", lambda x: (x["href"] != "") & F.arrays_overlap(x["rel"], F.array(*[F.lit(n) for n in names])))

    def link(t: Column) -> Column:
        start = F.regexp_extract(t, r"(?s)^<a(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", 0)
        image = F.get(tags(t, "img"), 0)
        return F.struct(attr_or_empty(start, "href").alias("href"), inner(t).alias("text"), tokens(attr(start, "rel")).alias("rel"), attr_or_empty(start, "target").alias("target"), F.when(image.isNotNull(), F.coalesce(attr(image, "alt"), F.lit(""))).alias("image_alt"))

    def image(t: Column) -> Column:
        src = F.coalesce(F.nullif(attr_or_empty(t, "src"), F.lit("")), attr_or_empty(t, "data-src"))
        names = ("title", "width", "height", "srcset", "aria-label", "aria-labelledby")
        return F.struct(src.alias("src"), attr(t, "alt").alias("alt"), *[attr_or_empty(t, n).alias(n.replace("-", "_")) for n in names], F.lower(attr_or_empty(t, "loading")).alias("loading"), F.lower(attr_or_empty(t, "role")).alias("role"), (F.lower(attr_or_empty(t, "aria-hidden")) == "true").alias("aria_hidden"))

    def script(t: Column) -> Column:
        start = F.regexp_extract(t, r"(?s)^<script[^>]*>", 0)
        body = F.regexp_extract(t, r"(?is)^<script[^>]*>(.*?)(?:</script\s*>)?$", 1)
        src = attr_or_empty(start, "src")
        return F.struct(src.alias("src"), F.lower(attr_or_empty(start, "type")).alias("type"), attr(start, "async").isNotNull().alias("async"), attr(start, "defer").isNotNull().alias("defer"), ((F.col("__head_end") > 0) & (F.instr(code, start) < F.col("__head_end"))).alias("in_head"), F.when(src == "", F.length(body)).otherwise(0).alias("inline_length"), body.alias("body"))

    five = (
        four.withColumn("__links", F.filter(F.transform("__anchors", link), lambda x: (x["href"] != "") & ~x["href"].startswith("#") & ~x["href"].rlike(rf"(?i)^(?:{NOT_FOLLOWED})")))
        .withColumn("__images", F.transform("__imgs", image))
        .withColumn("__script", F.transform("__scripts", script))
    )
    links = F.transform("__links", lambda x: F.struct(*[x[k].alias(k) for k in ("href", "text", "rel", "target", "image_alt")], U.resolve(b, x["href"]).alias("url")))
    images = F.transform("__images", lambda x: F.struct(*[x[k].alias(k) for k in ("src", "alt", "title", "width", "height", "srcset", "aria_label", "aria_labelledby", "loading", "role", "aria_hidden")], F.when(x["src"] != "", U.resolve(b, x["src"])).otherwise("").alias("url")))
    six = five.withColumn("__links", links).withColumn("__images", images)
    netloc = U.netloc(page_url)
    every = (
        b.alias("base_url"), F.col("__titles").alias("titles"), F.coalesce(F.get("__titles", 0), F.lit("")).alias("title"),
        F.col("__metas").alias("metas"), meta("description").alias("description"), F.transform(F.filter("__metas", lambda x: x["name"] == "description"), lambda x: x["content"]).alias("descriptions"),
        meta("robots").alias("robots"), F.transform(F.filter("__metas", lambda x: x["name"].isin("robots", "googlebot")), lambda x: x["content"]).alias("robots_all"),
        meta("viewport").alias("viewport"), meta("generator").alias("generator"), meta("twitter:card").alias("twitter_card"),
        *[prop(f"og:{n}").alias(f"og_{n}") for n in ("title", "type", "image", "url", "description", "site_name")],
        F.transform(rel("canonical"), lambda x: x["href"]).alias("canonicals_raw"), F.transform(rel("canonical"), lambda x: U.resolve(b, x["href"])).alias("canonicals"),
        F.transform(F.filter(rel("alternate"), lambda x: x["hreflang"] != ""), lambda x: F.struct(x["hreflang"].alias("lang"), x["href"].alias("raw"), U.resolve(b, x["href"]).alias("url"))).alias("hreflangs"),
        F.transform(rel("stylesheet"), lambda x: U.resolve(b, x["href"])).alias("stylesheets"),
        F.transform(rel("icon", "shortcut", "apple-touch-icon", "mask-icon"), lambda x: U.resolve(b, x["href"])).alias("favicons"),
        F.transform(rel("stylesheet", "preload", "icon", "manifest", "apple-touch-icon", "preconnect", "prefetch"), lambda x: U.resolve(b, x["href"])).alias("link_resources"),
        F.coalesce(attr_or_empty(F.get(tags(m, "html"), 0), "lang"), F.lit("")).alias("lang"),
        F.coalesce(F.get(F.filter(F.transform("__metas", lambda x: x["charset"]), lambda c: c != ""), 0), F.lit("")).alias("charset_meta"),
        F.col("__heads").alias("headings"), F.transform(F.filter("__heads", lambda h: h["level"] == 1), lambda h: h["text"]).alias("h1s"),
        F.transform("__links", lambda x: F.struct(*[x[k].alias(k) for k in ("href", "url", "text", "rel", "target", "image_alt")], F.coalesce(F.nullif(x["text"], F.lit("")), x["image_alt"], F.lit("")).alias("anchor"), (U.netloc(x["url"]) == netloc).alias("internal"), F.array_contains(x["rel"], "nofollow").alias("nofollow"))).alias("links"),
        F.col("__images").alias("images"),
        F.transform("__script", lambda s: F.struct(s["src"].alias("src"), F.when(s["src"] != "", U.resolve(b, s["src"])).otherwise("").alias("url"), *[s[k].alias(k) for k in ("type", "async", "defer", "in_head", "inline_length")])).alias("scripts"),
        F.filter(F.transform(F.filter("__script", lambda s: s["type"] == "application/ld+json"), lambda s: F.trim(s["body"])), lambda s: s != "").alias("json_ld"),
        F.transform(F.filter(F.transform(tags(m, "iframe|video|audio|source|embed|track|object"), lambda t: F.coalesce(F.nullif(attr_or_empty(t, "src"), F.lit("")), attr_or_empty(t, "data"))), lambda s: s != ""), lambda s: U.resolve(b, s)).alias("embeds"),
        code.rlike(r"(?i)<noscript\b").alias("has_noscript"), m.rlike(r"(?i)\sitemscope[\s=>]").alias("microdata"),
        m.rlike(r"(?i)<div[^>]*\sid\s*=\s*[\"']?(?:root|app|__next|__nuxt)[\"'\s>]").alias("shell_div"),
        m.rlike(r"(?i)<(?:div|main|section)[^>]*\sid\s*=\s*[\"']?(?:root|app|__next|__nuxt|___gatsby|svelte|q-app|ember-app)[\"'\s>]").alias("app_shell"),
        F.col("__text").alias("text"), T.word_count(F.col("__text")).alias("word_count"), markup_bytes(raw).alias("markup_bytes"), F.greatest(F.octet_length(raw) - markup_bytes(raw), F.lit(0)).alias("embedded_bytes"), F.octet_length(raw).alias("bytes"),
    )
    names = [f.name for f in six.select(*every).schema] if fields else []
    doc = F.struct(*([every[names.index(f)] for f in fields] if fields else every))
    # A generator of one row: predicates on doc stay above it, so they aren't rewritten into copies of the extraction.
    return six.select(*keep, F.explode(F.array(doc)).alias("doc"))


def image_named(i: Column) -> Column:
    """Accessible name of an image without its alt."""
    return F.coalesce(F.nullif(i["aria_label"], F.lit("")), F.nullif(i["aria_labelledby"], F.lit("")), F.nullif(i["title"], F.lit("")), F.lit(""))


def image_decorative(i: Column) -> Column:
    return (F.coalesce(F.trim(i["alt"]), F.lit("x")) == "") | i["role"].isin("presentation", "none") | i["aria_hidden"]


def image_pixel(i: Column) -> Column:
    return i["width"].isin("0", "1") & i["height"].isin("0", "1")


def should_render(doc: Column) -> Column:
    """Why a page is worth rendering in a browser; empty if it isn't."""
    n, scripts = doc["word_count"], F.size(doc["scripts"])
    return F.when(n == 0, "no text without scripts").when(n >= 100, "").when(doc["app_shell"], "little text in an application shell").when(scripts >= 5, "little text beside many scripts").otherwise("")


def summary(doc: Column) -> Column:
    """The fixed record that is kept of a page once its document is gone."""
    count = lambda items, test: F.size(F.filter(items, test))
    missing = F.filter(doc["images"], lambda i: i["alt"].isNull())
    return F.struct(
        doc["title"].alias("title"), F.length(doc["title"]).alias("title_length"), F.size(doc["titles"]).alias("title_count"), doc["description"].alias("description"), F.length(doc["description"]).alias("description_length"),
        F.coalesce(F.get(doc["canonicals"], 0), F.lit("")).alias("canonical"), doc["robots"].alias("robots_meta"), doc["lang"].alias("lang"), F.transform(doc["hreflangs"], lambda h: F.struct(h["lang"].alias("lang"), h["url"].alias("url"))).alias("hreflang"),
        doc["viewport"].alias("viewport"), doc["charset_meta"].alias("charset_meta"), doc["generator"].alias("generator"), doc["og_title"].alias("og_title"), doc["og_description"].alias("og_description"), F.when(doc["og_image"] != "", U.resolve(doc["base_url"], doc["og_image"])).otherwise("").alias("og_image"), doc["twitter_card"].alias("twitter_card"),
        doc["h1s"].alias("h1"), F.size(doc["h1s"]).alias("h1_count"), F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.concat(F.lit("h"), n.cast("string"))), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: count(doc["headings"], lambda h: h["level"] == n))).alias("heading_counts"),
        doc["word_count"].alias("word_count"), F.size(doc["links"]).alias("links_total"), count(doc["links"], lambda x: x["internal"]).alias("links_internal"), count(doc["links"], lambda x: ~x["internal"]).alias("links_external"), count(doc["links"], lambda x: x["nofollow"]).alias("links_nofollow"),
        F.size(doc["images"]).alias("images_total"), F.size(missing).alias("images_missing_alt"), F.transform(F.slice(missing, 1, 10), lambda i: i["src"]).alias("images_missing_alt_src"), count(doc["images"], image_decorative).alias("images_decorative"),
        F.concat(F.slice(doc["stylesheets"], 1, 8), F.slice(F.filter(F.transform(doc["scripts"], lambda s: s["url"]), lambda u: u != ""), 1, 8)).alias("resources"), F.size(doc["json_ld"]).alias("json_ld_blocks"), schema_types(doc["json_ld"]).alias("json_ld_types"),
    )


def schema_types(blocks: Column) -> Column:
    """Sorted distinct @type names at any depth of valid JSON-LD blocks."""
    valid = F.filter(blocks, lambda s: F.try_parse_json(s).isNotNull())
    single = F.flatten(F.transform(valid, lambda s: F.regexp_extract_all(s, F.lit(r'"@type"\s*:\s*"([^"]*)"'), F.lit(1))))
    lists = F.flatten(F.transform(F.flatten(F.transform(valid, lambda s: F.regexp_extract_all(s, F.lit(r'"@type"\s*:\s*\[([^\]]*)\]'), F.lit(1)))), lambda x: F.regexp_extract_all(x, F.lit(r'"([^"]*)"'), F.lit(1))))
    return F.array_sort(F.array_distinct(F.concat(single, lists)))


def json_errors(blocks: Column) -> Column:
    return F.size(F.filter(blocks, lambda s: F.try_parse_json(s).isNull()))
