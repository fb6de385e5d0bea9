"""Page rules: predicates over one page record, compiled into one projection.

A rule is a finding id, a severity, a predicate and its evidence, as Columns.
``findings()`` evaluates all rules in a single pass over the pages: one array
of structs per page, exploded. No rule scans the table again, and a rule can't
throw: every expression is total.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webassay.functions import html as H
from webassay.functions import text as T
from webassay.functions import urls as U

CRITICAL, WARNING, NOTICE, INFO = "critical", "warning", "notice", "info"
SEVERITIES = (CRITICAL, WARNING, NOTICE, INFO)


@dataclass(frozen=True)
class Thresholds:
    title_min: int = 30
    title_max: int = 60
    description_min: int = 70
    description_max: int = 160
    alt_max: int = 125
    images_lazy: int = 5
    thin: int = 300
    very_thin: int = 100
    text_ratio: float = 0.10
    ttfb_slow: float = 800.0
    ttfb_very_slow: float = 1800.0
    html_bytes: int = 150_000
    max_links: int = 150
    render_blocking: int = 3
    redirect_chain: int = 2
    near_duplicate: float = 0.60
    url_length: int = 115
    url_depth: int = 4
    url_params: int = 2
    duplicate_alt: int = 4


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    when: Callable[[Page], Column]
    evidence: Callable[[Page], Column]
    message: str = ""
    fix: str = ""
    errored: bool = False

    @property
    def category(self) -> str:
        return self.id.split(".")[0]


REGISTRY: list[Rule] = []


def rule(id: str, severity: str, message: str, fix: str = "", evidence=None, errored: bool = False):
    """Register a predicate as a rule: the extension point for further checks."""

    def add(when):
        REGISTRY.append(Rule(id, severity, when, evidence or (lambda p: F.lit("")), message, fix, errored))
        return when

    return add


#: Columns a page record may lack, as SQL of what stands in for them.
DEFAULTS = {
    "status": "200", "error": "cast(null as string)", "headers": "cast(map() as map<string,string>)", "redirects": "cast(array() as array<struct<url:string,status:int,location:string>>)",
    "ttfb_ms": "cast(null as double)", "http_version": "''", "decoded_bytes": "cast(null as bigint)", "truncated": "false", "charset_source": "''", "mime": "'text/html'",
    "render_diff": "cast(null as struct<error:string,words_before:int,words_after:int,links_before:int,links_after:int,title_before:string,title_after:string,description_before:string,description_after:string>)",
}


class Page:
    """Names for the parts of a page record that rules use."""

    def __init__(self, t: Thresholds):
        self.t, self.doc, self.url = t, F.col("doc"), F.col("url")
        self.https = U.scheme(self.url) == "https"
        self.titled = F.filter(self.doc["titles"], lambda x: x != "")
        self.title = F.coalesce(F.get(self.titled, 0), F.lit(""))
        self.described = F.filter(self.doc["descriptions"], lambda x: x != "")
        self.description = F.coalesce(F.get(self.described, 0), F.lit(""))
        self.canonicals, self.canonical = self.doc["canonicals"], F.coalesce(F.get(self.doc["canonicals"], 0), F.lit(""))
        self.canonical_raw = F.coalesce(F.get(self.doc["canonicals_raw"], 0), F.lit(""))
        self.images, self.links, self.words = self.doc["images"], self.doc["links"], self.doc["word_count"]
        self.directives = T.directives(F.concat(self.doc["robots_all"], F.array(self.header("x-robots-tag"))))
        self.blocked_index = F.arrays_overlap(self.directives, F.array(F.lit("noindex"), F.lit("none")))
        self.params = U.query_pairs(U.query(self.url))
        self.valid_json = F.filter(self.doc["json_ld"], lambda s: F.try_parse_json(s).isNotNull())
        self.diff = F.col("render_diff")

    def header(self, name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(""))

    def some_images(self, test) -> Column:
        return F.filter(self.images, test)

    def some_links(self, test) -> Column:
        return F.filter(self.links, test)


def _any(items: Column) -> Column:
    return F.size(items) > 0


def _srcs(items: Column) -> Column:
    return T.sample(F.transform(items, lambda i: i["src"]))


def _hrefs(items: Column) -> Column:
    return T.sample(F.transform(items, lambda i: i["href"]))


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def _r(id, severity, when, message, fix="", evidence=None, errored=False):
    rule(id, severity, message, fix, evidence, errored)(when)


# Titles and descriptions
_r("title.missing", CRITICAL, lambda p: ~_any(p.titled), "The page has no title", "Add one title that names the page.")
_r("title.multiple", WARNING, lambda p: _any(p.titled) & (F.size(p.doc["titles"]) > 1), "The page has several titles", "Keep one.", lambda p: T.sample(p.doc["titles"]))
_r("title.too_long", WARNING, lambda p: _any(p.titled) & (F.length(p.title) > p.t.title_max), "The title is longer than results show", "Shorten it.", lambda p: p.title)
_r("title.too_short", NOTICE, lambda p: _any(p.titled) & (F.length(p.title) < p.t.title_min), "The title says little", "Use the room that results give.", lambda p: p.title)
_r("description.missing", WARNING, lambda p: ~_any(p.described), "The page has no description", "Write one for the results page.")
_r("description.multiple", WARNING, lambda p: _any(p.described) & (F.size(p.doc["descriptions"]) > 1), "The page has several descriptions", "Keep one.")
_r("description.too_long", NOTICE, lambda p: _any(p.described) & (F.length(p.description) > p.t.description_max), "The description will be cut", "Shorten it.", lambda p: p.description)
_r("description.too_short", NOTICE, lambda p: _any(p.described) & (F.length(p.description) < p.t.description_min), "The description is short", "Say more.", lambda p: p.description)

# Indexing and canonical addresses
_r("indexability.noindex", CRITICAL, lambda p: p.blocked_index, "The page asks not to be indexed", "Remove the directive if that isn't meant.", lambda p: T.sample(p.directives))
_r("indexability.nofollow", WARNING, lambda p: F.arrays_overlap(p.directives, F.array(F.lit("nofollow"), F.lit("none"))), "Links of the page aren't followed", "Remove nofollow.", lambda p: T.sample(p.directives))
RESTRICTIONS = ("noarchive", "nosnippet", "noimageindex", "notranslate")
_r("indexability.restricted", INFO, lambda p: F.arrays_overlap(p.directives, F.array(*map(F.lit, RESTRICTIONS))), "The page restricts how it is shown", "", lambda p: T.sample(F.array_intersect(p.directives, F.array(*map(F.lit, RESTRICTIONS)))))
_r("canonical.missing", WARNING, lambda p: ~_any(p.canonicals), "The page names no canonical address", "Add one.")
_r("canonical.multiple", WARNING, lambda p: F.size(p.canonicals) > 1, "The page names several canonical addresses", "Keep one.", lambda p: T.sample(p.canonicals))
_r("canonical.relative", NOTICE, lambda p: _any(p.canonicals) & ~p.canonical_raw.rlike("(?i)^https?://"), "The canonical address is relative", "Write it in full.", lambda p: p.canonical_raw)
_r("canonical.cross_domain", WARNING, lambda p: _any(p.canonicals) & (U.netloc(p.canonical) != U.netloc(p.url)), "The canonical address is on another host", "Check that this is meant.", lambda p: p.canonical)
_r("canonical.insecure", WARNING, lambda p: _any(p.canonicals) & (U.netloc(p.canonical) == U.netloc(p.url)) & p.https & (U.scheme(p.canonical) == "http"), "A secure page names an insecure canonical address", "Use https.", lambda p: p.canonical)
_r("canonical.not_self_referential", NOTICE, lambda p: _any(p.canonicals) & (U.netloc(p.canonical) == U.netloc(p.url)) & ~(p.https & (U.scheme(p.canonical) == "http")) & (_bare(p.canonical) != _bare(p.url)), "The canonical address is another page", "Check that this is meant.", lambda p: p.canonical)

# Headings
_r("headings.none", WARNING, lambda p: ~_any(p.doc["headings"]), "The page has no headings", "Structure it.")
_r("headings.no_h1", WARNING, lambda p: _any(p.doc["headings"]) & ~_any(p.doc["h1s"]), "The page has no main heading", "Add an h1.")
_r("headings.multiple_h1", NOTICE, lambda p: F.size(p.doc["h1s"]) > 1, "The page has several main headings", "Keep one.", lambda p: T.sample(p.doc["h1s"]))
_r("headings.empty", NOTICE, lambda p: F.exists(p.doc["headings"], lambda h: h["text"] == ""), "A heading is empty", "Fill or remove it.")
_r("headings.skipped_level", NOTICE, lambda p: _any(skips(p.doc["headings"])), "Heading levels are skipped", "Go down one level at a time.", lambda p: T.sample(skips(p.doc["headings"])))


def skips(headings: Column) -> Column:
    """Pairs like h2->h4 in document order."""
    pairs = F.zip_with(F.slice(headings, 1, F.greatest(F.size(headings) - 1, F.lit(0))), F.slice(headings, 2, F.greatest(F.size(headings) - 1, F.lit(0))), lambda a, b: F.struct(a["level"].alias("a"), b["level"].alias("b")))
    return F.transform(F.filter(pairs, lambda x: x["b"] > x["a"] + 1), lambda x: F.concat(F.lit("h"), x["a"].cast("string"), F.lit("->h"), x["b"].cast("string")))


# Images. Words that name nothing, kinds of pictures, and types of files.
GENERIC_ALT = ("image", "images", "photo", "photos", "picture", "pictures", "graphic", "icon", "logo", "banner", "thumbnail", "untitled", "spacer", "blank", "imagem", "imagens", "foto", "fotos", "logotipo", "grafico", "icone")
PICTURES = ("image", "photo", "picture", "graphic", "icon", "logo", "screenshot", "illustration")
SHOWS = ("of", "showing", "depicting")
FILE_WORDS = ("img", "dsc", "dscn", "pxl", "screenshot", "photo", "image", "foto", "imagem", "untitled")
FILE_TYPES = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp")
GENERIC_FILES = ("image", "img", "photo", "pic", "picture", "untitled", "final", "new", "download", "foto", "imagem")
NUMBERED_FILES = ("dsc", "dscn", "pxl", "screenshot", "photo", "img")
PROXIES = ("/_next/image", "/cdn-cgi/image", "/imgproxy", "/_vercel/image", "/_ipx", "/wp-content/uploads/")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def _file(i: Column) -> Column:
    """Stem of the picture's file; of a proxy address, of the file it serves; empty if that isn't named."""
    path = U.path(i["url"])
    through = F.lit(False)
    for p in PROXIES:
        through = through | path.contains(p)
    pairs = U.query_pairs(U.query(i["url"]))
    value = lambda k: F.get(F.filter(pairs, lambda x: (x["k"] == k) & (x["v"] != "")), 0)["v"]
    target = F.coalesce(*[value(k) for k in ("url", "src", "image", "uri")], F.lit(""))
    return F.when(through, _stem(U.path(target))).otherwise(_stem(path))


_alt = lambda i: F.trim(F.coalesce(i["alt"], F.lit("")))
_r("images.missing_alt", WARNING, lambda p: _any(p.some_images(no_alt)), "Images have no alternative text", "Describe them, or mark them as decoration.", lambda p: _srcs(p.some_images(no_alt)))
_r("images.alt_via_aria", NOTICE, lambda p: _any(p.some_images(by_aria)), "Images are named, but not by alt", "Search engines read alt.", lambda p: _srcs(p.some_images(by_aria)))
_r("images.beacon_without_empty_alt", NOTICE, lambda p: _any(p.some_images(lambda i: H.image_pixel(i) & i["alt"].isNull())), "Tracking pixels have no empty alt", "Add alt=\"\".", lambda p: _srcs(p.some_images(lambda i: H.image_pixel(i) & i["alt"].isNull())))
_r("images.redundant_alt_prefix", NOTICE, lambda p: _any(p.some_images(redundant_prefix)), "Alternative texts say that they are images", "Start with what is shown.", lambda p: T.sample(F.transform(p.some_images(redundant_prefix), _alt)))
_r("images.generic_alt", NOTICE, lambda p: _any(p.some_images(generic_alt)), "Alternative texts are generic", "Describe the picture.", lambda p: T.sample(F.transform(p.some_images(generic_alt), _alt)))
_r("images.duplicate_alt", NOTICE, lambda p: _any(repeated_alts(p.images, p.t.duplicate_alt)), "Several images share an alternative text", "Tell them apart.", lambda p: T.sample(repeated_alts(p.images, p.t.duplicate_alt)))
_r("images.alt_too_long", NOTICE, lambda p: _any(p.some_images(lambda i: F.length(_alt(i)) > p.t.alt_max)), "Alternative texts are long", "Shorten them.", lambda p: _srcs(p.some_images(lambda i: F.length(_alt(i)) > p.t.alt_max)))
_r("images.alt_is_filename", NOTICE, lambda p: _any(p.some_images(names_a_file)), "Alternative texts are file names", "Describe the picture.", lambda p: T.sample(F.transform(p.some_images(names_a_file), _alt)))
_r("images.alt_matches_slug", NOTICE, lambda p: (_stem(U.path(p.url)) != "") & _any(p.some_images(lambda i: F.lower(_alt(i)) == F.lower(_stem(U.path(p.url))))), "An alternative text repeats the address", "Describe the picture.")
_r("images.generic_filename", NOTICE, lambda p: _any(p.some_images(generic_file)), "Images have generic file names", "Use short, telling names.", lambda p: _srcs(p.some_images(generic_file)))
_r("images.missing_src", WARNING, lambda p: _any(p.some_images(lambda i: i["src"] == "")), "Images have no source", "Add it, or remove them.")
_r("images.missing_dimensions", NOTICE, lambda p: _any(p.some_images(unsized)), "Images have no width and height", "Reserve their space.", lambda p: _srcs(p.some_images(unsized)))
_r("images.no_lazy_loading", NOTICE, lambda p: (F.size(p.some_images(lambda i: i["src"] != "")) >= p.t.images_lazy) & ~F.exists(p.images, lambda i: (i["src"] != "") & (i["loading"] == "lazy")), "No image loads lazily", "Load those below the fold lazily.")


def no_alt(i: Column) -> Column:
    return i["alt"].isNull() & (H.image_named(i) == "") & ~H.image_decorative(i) & ~H.image_pixel(i)


def by_aria(i: Column) -> Column:
    return i["alt"].isNull() & (H.image_named(i) != "")


def generic_alt(i: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_alt(i)), "^[.:-]+|[.:-]+$", "")).isin(*GENERIC_ALT)


def redundant_prefix(i: Column) -> Column:
    """"(A) picture of ...": a kind of picture, maybe after an article, and a word that says that it shows something."""
    words = F.split(F.lower(_alt(i)), r"\s+")
    at = F.when(F.get(words, 0).isin("a", "an"), 1).otherwise(0)
    return F.get(words, at).isin(*PICTURES) & F.regexp_extract(F.coalesce(F.get(words, at + 1), F.lit("")), r"^\w+", 0).isin(*SHOWS)


def names_a_file(i: Column) -> Column:
    """A text without spaces that ends in a picture's type, or a word that cameras and tools number or give an ending."""
    low = F.lower(_alt(i))
    ending = F.regexp_extract(low, r"\.(\w{2,4})$", 1)
    rest = F.regexp_replace(low, r"\.\w{2,4}$", "")
    word = F.regexp_replace(rest, r"[-_ ]?[0-9]+$", "")
    return (word.isin(*FILE_WORDS) & ((ending != "") | (word != rest))) | (ending.isin(*FILE_TYPES) & (rest != "") & ~low.rlike(r"\s"))


def generic_file(i: Column) -> Column:
    """A file named by a word that any picture could have, by such a word with a number, or by a number alone."""
    low = F.lower(_file(i))
    bare = F.regexp_replace(low, "[0-9]+$", "")
    word = F.regexp_replace(bare, "[-_ ]$", "")
    named = word.isin(*GENERIC_FILES) | ((bare != low) & (word.isin(*NUMBERED_FILES) | (bare == "")))
    return (i["url"] != "") & ~H.image_pixel(i) & named


def unsized(i: Column) -> Column:
    return (i["src"] != "") & ((i["width"] == "") | (i["height"] == ""))


def repeated_alts(images: Column, least: int) -> Column:
    alts = F.filter(F.transform(images, lambda i: F.lower(_alt(i))), lambda a: a != "")
    return F.filter(F.array_distinct(alts), lambda a: F.size(F.filter(alts, lambda b: b == a)) >= least)


# Links. Anchors that say nothing.
GENERIC_ANCHORS = (
    "click here", "click", "here", "read more", "learn more", "more", "more info", "this", "this page", "link", "download", "see more", "view", "go", "details",
    "clique aqui", "clica aqui", "aqui", "saiba mais", "sabe mais", "leia mais", "ler mais", "ver mais", "ver", "mais", "continuar", "detalhes", "descarregar",
)
generic_anchor = lambda x: F.trim(F.regexp_replace(F.lower(x["anchor"]), r"^[\s.:!»>…-]+|[\s.:!»>…-]+$", "")).isin(*GENERIC_ANCHORS)
_r("links.none", WARNING, lambda p: ~_any(p.links), "The page links nowhere", "Link it to the site.")
_r("links.no_internal", WARNING, lambda p: _any(p.links) & ~F.exists(p.links, lambda x: x["internal"]), "The page has no internal links", "Link it to the site.")
_r("links.empty_anchor", NOTICE, lambda p: _any(p.some_links(lambda x: F.trim(x["anchor"]) == "")), "Links have no text", "Name where they lead.", lambda p: _hrefs(p.some_links(lambda x: F.trim(x["anchor"]) == "")))
_r("links.generic_anchor", NOTICE, lambda p: _any(p.some_links(generic_anchor)), "Link texts are generic", "Name where they lead.", lambda p: _hrefs(p.some_links(generic_anchor)))
_r("links.excessive", NOTICE, lambda p: F.size(p.links) > p.t.max_links, "The page has very many links", "Keep those that matter.")
_r("links.nofollow_internal", NOTICE, lambda p: _any(p.some_links(lambda x: x["internal"] & x["nofollow"])), "Internal links aren't followed", "Remove nofollow.", lambda p: _hrefs(p.some_links(lambda x: x["internal"] & x["nofollow"])))
_r("links.insecure", WARNING, lambda p: p.https & _any(p.some_links(lambda x: U.scheme(x["url"]) == "http")), "A secure page links to insecure addresses", "Use https.", lambda p: _hrefs(p.some_links(lambda x: U.scheme(x["url"]) == "http")))
_r("links.unsafe_target_blank", NOTICE, lambda p: _any(p.some_links(unsafe_blank)), "Links open windows that can reach back", "Add rel=\"noopener\".", lambda p: _hrefs(p.some_links(unsafe_blank)))
unsafe_blank = lambda x: (F.lower(x["target"]) == "_blank") & ~x["internal"] & ~F.arrays_overlap(x["rel"], F.array(F.lit("noopener"), F.lit("noreferrer")))

# Social previews
_og = ("title", "type", "image", "url", "description", "site_name")
_og_missing = lambda p, names: F.array_compact(F.array(*[F.when(p.doc[f"og_{n}"] == "", F.lit(f"og:{n}")) for n in names]))
_has_og = lambda p: F.size(_og_missing(p, _og)) < 6
_r("social.og_missing", NOTICE, lambda p: ~_has_og(p), "The page has no Open Graph tags", "Add title, type, image and url.")
_r("social.og_incomplete", NOTICE, lambda p: _has_og(p) & _any(_og_missing(p, _og[:4])), "Open Graph tags are missing", "Add them.", lambda p: T.sample(_og_missing(p, _og[:4])))
_r("social.og_image_relative", WARNING, lambda p: (p.doc["og_image"] != "") & ~p.doc["og_image"].rlike("(?i)^https?://"), "The preview image has a relative address", "Write it in full.", lambda p: p.doc["og_image"])
_r("social.og_url_mismatch", NOTICE, lambda p: (p.doc["og_url"] != "") & (_bare(p.doc["og_url"]) != _bare(p.url)), "og:url is another page", "Name this page.", lambda p: p.doc["og_url"])
_r("social.twitter_missing", INFO, lambda p: (p.doc["twitter_card"] == "") & (p.doc["og_image"] == ""), "The page has no card and no preview image", "Add a card.")
_r("social.twitter_card_invalid", NOTICE, lambda p: (p.doc["twitter_card"] != "") & ~F.lower(p.doc["twitter_card"]).isin("summary", "summary_large_image", "app", "player"), "The card type is unknown", "Use a known one.", lambda p: p.doc["twitter_card"])

# Structured data. Required properties by type.
REQUIRED = {
    "Article": ("headline", "datePublished"), "NewsArticle": ("headline", "datePublished"), "BlogPosting": ("headline", "datePublished"), "Product": ("name", "image"), "Offer": ("price", "priceCurrency"),
    "LocalBusiness": ("name", "address"), "Organization": ("name",), "BreadcrumbList": ("itemListElement",), "FAQPage": ("mainEntity",), "Recipe": ("name", "image", "recipeIngredient"),
    "Event": ("name", "startDate", "location"), "VideoObject": ("name", "thumbnailUrl", "uploadDate"), "JobPosting": ("title", "datePosted", "hiringOrganization"),
}


def incomplete(blocks: Column) -> Column:
    """"Type missing a, b" of the nodes at the top of valid blocks, and one level below (@graph and other lists)."""
    unpack = lambda s: F.when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array(s))).otherwise(F.array(s))
    top = F.flatten(F.transform(blocks, unpack))
    graph = F.flatten(F.transform(top, lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))))
    child = lambda s: F.filter(F.map_values(F.coalesce(F.from_json(s, "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda v: v.startswith("{") & v.contains('"@type"'))
    nodes = F.concat(top, graph, F.flatten(F.transform(F.concat(top, graph), child)))

    def of_type(t: str, props: tuple[str, ...]) -> Column:
        absent = lambda s: F.array_join(F.array_compact(F.array(*[F.when(_falsy(F.get_json_object(s, f"$.{x}")), F.lit(x)) for x in props])), ", ")
        return F.transform(F.filter(nodes, lambda s: _is_type(s, t)), lambda s: F.struct(F.lit(t).alias("t"), absent(s).alias("m")))

    parts = [of_type(t, props) for t, props in REQUIRED.items()]
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(*parts), lambda x: x["m"] != ""), lambda x: F.concat(x["t"], F.lit(" missing "), x["m"]))))


def _is_type(s: Column, t: str) -> Column:
    found = F.get_json_object(s, "$['@type']")
    return F.coalesce((found == t) | (found.startswith("[") & found.contains(f'"{t}"')), F.lit(False))


def _falsy(v: Column) -> Column:
    return F.coalesce(v, F.lit("")).isin("", "[]", "{}", "0", "false", "null")


_r("structured.invalid_json", WARNING, lambda p: H.json_errors(p.doc["json_ld"]) > 0, "A JSON-LD block can't be read", "Fix its syntax.")
_r("structured.microdata_only", INFO, lambda p: ~_any(p.valid_json) & p.doc["microdata"], "The page uses microdata only", "JSON-LD is easier to keep.")
_r("structured.none", NOTICE, lambda p: ~_any(p.valid_json) & ~p.doc["microdata"], "The page has no structured data", "Add what fits its content.")
_r("structured.present", INFO, lambda p: _any(p.valid_json), "The page has structured data", "", lambda p: F.array_join(H.schema_types(p.doc["json_ld"]), ", "))
_r("structured.missing_properties", NOTICE, lambda p: _any(incomplete(p.valid_json)), "Structured data lacks required properties", "Add them.", lambda p: T.sample(incomplete(p.valid_json), 4))

# Languages
LANG, HREFLANG = "(?i)^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$", "(?i)^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$"
bad_hreflang = lambda h: ~h["lang"].rlike(HREFLANG) & (F.lower(h["lang"]) != "x-default")
_r("i18n.missing_lang", WARNING, lambda p: p.doc["lang"] == "", "The page doesn't name its language", "Add lang to html.")
_r("i18n.invalid_lang", NOTICE, lambda p: (p.doc["lang"] != "") & ~p.doc["lang"].rlike(LANG), "The page's language isn't a language tag", "Use one like pt-PT.", lambda p: p.doc["lang"])
_r("i18n.hreflang_invalid", WARNING, lambda p: F.exists(p.doc["hreflangs"], bad_hreflang), "Alternates have invalid languages", "Use language, then region.", lambda p: T.sample(F.transform(F.filter(p.doc["hreflangs"], bad_hreflang), lambda h: h["lang"])))
_r("i18n.hreflang_no_self", WARNING, lambda p: _any(p.doc["hreflangs"]) & ~F.exists(p.doc["hreflangs"], lambda h: _bare(h["url"]) == _bare(p.url)), "Alternates don't name the page itself", "Add it.")
_r("i18n.hreflang_no_xdefault", NOTICE, lambda p: _any(p.doc["hreflangs"]) & ~F.exists(p.doc["hreflangs"], lambda h: F.lower(h["lang"]) == "x-default"), "Alternates have no default", "Add x-default.")
_r("i18n.hreflang_relative", NOTICE, lambda p: F.exists(p.doc["hreflangs"], lambda h: ~h["raw"].rlike("(?i)^https?://")), "Alternates have relative addresses", "Write them in full.")

# Content
_r("content.empty", CRITICAL, lambda p: p.words == 0, "The page shows no text", "Serve its content.")
_r("content.very_thin", WARNING, lambda p: (p.words > 0) & (p.words < p.t.very_thin), "The page has very little text", "Say more, or merge it.", lambda p: p.words.cast("string"))
_r("content.thin", NOTICE, lambda p: (p.words >= p.t.very_thin) & (p.words < p.t.thin), "The page has little text", "Say more, or merge it.", lambda p: p.words.cast("string"))
_r("content.low_text_ratio", NOTICE, lambda p: (p.words > 0) & (p.words < p.t.thin) & (F.length(p.doc["text"]) < p.t.text_ratio * p.doc["markup_bytes"]), "The page is mostly markup", "Cut the markup.")
_r("content.js_rendered", INFO, lambda p: (p.words > 0) & (p.words < p.t.very_thin) & p.doc["shell_div"] & (F.size(p.doc["scripts"]) >= 3), "The page seems to be built by scripts", "Render it on the server.")

# Rendered pages
_ran = lambda p: p.diff.isNotNull() & (F.coalesce(p.diff["error"], F.lit("")) == "")
_r("render.failed", NOTICE, lambda p: F.coalesce(p.diff["error"], F.lit("")) != "", "The page could not be rendered", "", lambda p: p.diff["error"])
_r("render.content_requires_js", WARNING, lambda p: _ran(p) & (p.diff["words_before"] < 100) & (p.diff["words_after"] >= F.greatest(2 * p.diff["words_before"], p.diff["words_before"] + 50)), "Most text appears only with scripts", "Serve it.")
_r("render.links_require_js", WARNING, lambda p: _ran(p) & (p.diff["links_before"] == 0) & (p.diff["links_after"] > 0), "Links appear only with scripts", "Serve them.")
_r("render.some_links_require_js", NOTICE, lambda p: _ran(p) & (p.diff["links_before"] > 0) & (p.diff["links_after"] >= 2 * p.diff["links_before"]) & (p.diff["links_after"] >= p.diff["links_before"] + 10), "Many links appear only with scripts", "Serve them.")
for _name in ("title", "description"):
    _r(f"render.{_name}_requires_js", WARNING, lambda p, n=_name: _ran(p) & (F.trim(F.coalesce(p.diff[f"{n}_before"], F.lit(""))) == "") & (F.trim(F.coalesce(p.diff[f"{n}_after"], F.lit(""))) != ""), f"The {_name} appears only with scripts", "Serve it.")

# Transport and delivery
_r("technical.blocked", CRITICAL, lambda p: F.col("error") == "blocked", "The server refuses crawlers", "Let them in.", errored=True)
_r("technical.fetch_failed", CRITICAL, lambda p: F.col("error").isNotNull() & (F.col("error") != "blocked"), "The page could not be fetched", "Check the server.", lambda p: F.col("error"), errored=True)
_r("technical.server_error", CRITICAL, lambda p: F.col("status") >= 500, "The server reports an error", "Fix it.", lambda p: F.col("status").cast("string"))
_r("technical.client_error", CRITICAL, lambda p: (F.col("status") >= 400) & (F.col("status") < 500), "The page doesn't exist or is closed", "Fix or remove links to it.", lambda p: F.col("status").cast("string"))
_resources = lambda p: F.concat(F.transform(p.images, lambda i: i["url"]), F.transform(p.doc["scripts"], lambda s: s["url"]), p.doc["embeds"], p.doc["link_resources"], F.flatten(F.transform(p.images, lambda i: F.transform(F.filter(F.transform(F.split(i["srcset"], ","), lambda c: F.split_part(F.trim(c), F.lit(" "), F.lit(1))), lambda c: c != ""), lambda c: U.resolve(p.doc["base_url"], c)))))
_insecure = lambda p: F.array_distinct(F.filter(_resources(p), lambda u: U.scheme(u) == "http"))
_r("technical.not_https", CRITICAL, lambda p: ~p.https, "The page isn't secure", "Serve it by https.")
_r("technical.no_hsts", NOTICE, lambda p: p.https & (p.header("strict-transport-security") == ""), "Browsers aren't told to stay secure", "Send the header.")
_r("technical.mixed_content", CRITICAL, lambda p: p.https & _any(_insecure(p)), "A secure page loads insecure files", "Load them by https.", lambda p: T.sample(_insecure(p)))
_r("technical.redirect_chain", WARNING, lambda p: F.size("redirects") >= p.t.redirect_chain, "The page is reached over several redirects", "Point to it.")
_r("technical.redirect", NOTICE, lambda p: F.size("redirects") == 1, "The page is reached over a redirect", "Point to it.")
_r("technical.temporary_redirect", NOTICE, lambda p: F.exists("redirects", lambda r: r["status"].isin(302, 303, 307)), "A redirect is temporary", "Make it permanent.")
_r("technical.no_viewport", CRITICAL, lambda p: p.doc["viewport"] == "", "The page isn't made for phones", "Add a viewport.")
_r("technical.viewport_fixed", WARNING, lambda p: (p.doc["viewport"] != "") & ~F.replace(F.lower(p.doc["viewport"]), F.lit(" "), F.lit("")).contains("width=device-width"), "The viewport doesn't follow the device", "Use width=device-width.", lambda p: p.doc["viewport"])
_r("technical.no_charset", WARNING, lambda p: (p.doc["charset_meta"] == "") & ~F.col("charset_source").isin("header", "bom"), "The page doesn't name its encoding", "Name it.")
_r("technical.ttfb_very_slow", WARNING, lambda p: F.col("ttfb_ms") > p.t.ttfb_very_slow, "The server answers very slowly", "Speed it up.", lambda p: F.col("ttfb_ms").cast("string"))
_r("technical.ttfb_slow", NOTICE, lambda p: (F.col("ttfb_ms") > p.t.ttfb_slow) & (F.col("ttfb_ms") <= p.t.ttfb_very_slow), "The server answers slowly", "Speed it up.", lambda p: F.col("ttfb_ms").cast("string"))
_r("technical.no_compression", WARNING, lambda p: F.col("mime").isin("text/html", "application/xhtml+xml") & (p.header("content-encoding") == ""), "The page isn't compressed", "Compress it.")
_r("technical.large_html", NOTICE, lambda p: F.coalesce(F.col("decoded_bytes"), p.doc["bytes"]) > p.t.html_bytes, "The page is large", "Cut it.")
_r("technical.http1", NOTICE, lambda p: F.upper("http_version").isin("HTTP/1.0", "HTTP/1.1"), "The server speaks an old protocol", "Use HTTP/2.")
_r("technical.no_cache_validators", NOTICE, lambda p: (p.header("etag") == "") & (p.header("last-modified") == ""), "The page can't be revalidated", "Send an etag or a date.")
_r("technical.body_truncated", INFO, lambda p: F.coalesce("truncated", F.lit(False)), "Only part of the page was read")
_blocking = lambda p: F.filter(p.doc["scripts"], lambda s: (s["src"] != "") & s["in_head"] & ~s["async"] & ~s["defer"] & (s["type"] != "module"))
_r("technical.render_blocking_scripts", NOTICE, lambda p: F.size(_blocking(p)) >= p.t.render_blocking, "Scripts hold up the page", "Defer them.", lambda p: _srcs(_blocking(p)))
_r("technical.no_favicon", NOTICE, lambda p: ~_any(p.doc["favicons"]), "The page has no icon", "Add one.")

# Addresses
_r("url.too_long", NOTICE, lambda p: F.length(p.url) > p.t.url_length, "The address is long", "Shorten it.")
_r("url.too_deep", NOTICE, lambda p: U.path_depth(p.url) > p.t.url_depth, "The address is deep", "Flatten it.")
_r("url.uppercase", NOTICE, lambda p: U.path(p.url).rlike(r"\p{Lu}"), "The address has capitals", "Use small letters.")
_r("url.underscores", NOTICE, lambda p: U.path(p.url).contains("_"), "The address has underscores", "Use hyphens.")
_r("url.session_id", WARNING, lambda p: F.exists(p.params, lambda x: F.lower(x["k"]).isin(*U.SESSION_PARAMETERS)), "The address carries a session", "Use cookies.")
_r("url.many_parameters", NOTICE, lambda p: F.size(p.params) > p.t.url_params, "The address has many parameters", "Prefer clean paths.", lambda p: U.query(p.url))

#: Rules of this module; those that others register are tried before they run.
BUILT_IN = tuple(REGISTRY)
#: What concerns only how a page appears in results, and so not a page that isn't indexed.
APPEARANCE = r"^(?:title|description|social|structured|canonical|url)\.|^i18n\.hreflang|^content\.(?:thin|very_thin|low_text_ratio)$"

FINDING = "array<struct<finding_id:string,severity:string,category:string,message:string,evidence:string,fix:string>>"


def with_defaults(pages: DataFrame) -> DataFrame:
    """Page records with every column that rules look at, and ``doc``."""
    missing = {k: F.expr(v) for k, v in DEFAULTS.items() if k not in pages.columns}
    full = pages.withColumns(missing) if missing else pages
    return full if "doc" in pages.columns else H.document(full)


def findings(pages: DataFrame, thresholds: Thresholds = Thresholds(), rules: list[Rule] | None = None) -> DataFrame:
    """One row per finding: the page's key columns (all but html and doc), finding_id, severity, category, message, evidence, fix.

    Pages whose fetch failed get the rules for failures only; pages that ask
    not to be indexed lose the findings on their appearance in results.
    """
    p = Page(thresholds)
    failed = F.col("error").isNotNull()

    full = with_defaults(pages)

    def row(id: str, severity: str, message: str, evidence: Column, fix: str) -> Column:
        return F.struct(F.lit(id).alias("finding_id"), F.lit(severity).alias("severity"), F.lit(id.split(".")[0]).alias("category"), F.lit(message).alias("message"), F.coalesce(evidence, F.lit("")).alias("evidence"), F.lit(fix).alias("fix"))

    def one(r: Rule) -> Column:
        try:
            hit = F.coalesce(r.when(p), F.lit(False)) & (failed if r.errored else ~failed)
            out = F.when(hit, row(r.id, r.severity, r.message, r.evidence(p), r.fix))
            if r not in BUILT_IN:
                full.select(out)  # resolves its columns and types now
            return out
        except Exception as e:  # noqa: BLE001  a rule that can't be planned is a finding, not a crash
            return F.when(~failed, row("analyzer.error", INFO, f"The rule {r.id} fails", F.lit(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"), ""))

    keys = [c for c in ("site", "page_id", "url") if c in full.columns]
    every = full.select(*keys, p.blocked_index.alias("__noindex"), F.explode(F.array_compact(F.array(*[one(r) for r in (rules or REGISTRY)]))).alias("f"))
    return every.where(~(F.coalesce("__noindex", F.lit(False)) & F.col("f.finding_id").rlike(APPEARANCE))).select(*keys, "f.*")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def alt_targets(pages: DataFrame) -> DataFrame:
    """Unnamed controls that aren't images: (url, kind, identifier). The one projection that needs parents, so it walks the tree in Arrow batches."""
    from webassay.functions import tree

    return tree.unnamed_controls(pages)


def control_findings(pages: DataFrame) -> DataFrame:
    """images.control_without_name for pages with unnamed controls; kinds with the most first."""
    kinds = alt_targets(pages).groupBy("page_id", "url", "kind").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["kind"])), ", ")
    grouped = kinds.groupBy("page_id", "url").agg(text.alias("evidence"))
    return grouped.select("page_id", "url", F.lit("images.control_without_name").alias("finding_id"), F.lit(WARNING).alias("severity"), F.lit("images").alias("category"), F.lit("Controls have no name").alias("message"), "evidence", F.lit("Name them.").alias("fix"))


#: metric: (good up to, poor above, core)
VITALS = {"lcp_ms": (2500, 4000, True), "cls": (0.1, 0.25, True), "ttfb_ms": (800, 1800, False), "fcp_ms": (1800, 3000, False), "total_blocking_ms": (200, 600, False)}


def rating(metric: str, value: Column) -> Column:
    good, poor, _ = VITALS[metric]
    return F.when(value.isNull(), "unknown").when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")


def vitals_findings(vitals: DataFrame) -> DataFrame:
    """(url, finding_id, severity, category, evidence) of measured pages (url and a column per metric)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), rating(m, F.col(m)).alias("rating"), F.lit(core).alias("core")) for m, (_, _, core) in VITALS.items() if m in vitals.columns]))
    rows = vitals.select("url", each.alias("v")).select("url", "v.*").where(~F.col("rating").isin("good", "unknown"))
    return rows.select("url", F.concat(F.lit("vitals."), F.regexp_replace("metric", "_ms$", "")).alias("finding_id"), F.when(F.col("core") & (F.col("rating") == "poor"), WARNING).otherwise(NOTICE).alias("severity"), F.lit("vitals").alias("category"), F.format_string("%s: %s", "rating", F.col("value").cast("string")).alias("evidence"))
