"""Pieces of DuckDB SQL that several oracles share. Written apart from the Column functions, in RE2's dialect."""

from __future__ import annotations

from webassay.sources.pages import DERIVED

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(s: str) -> str:
    for a, b in _ENTITIES:
        s = f"replace({s}, '{a}', '{b}')"
    return s


def squeeze(s: str) -> str:
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def cut(s: str, *names: str) -> str:
    for n in names:
        s = rf"regexp_replace({s}, '<{n}\b[^>]*>.*?(</{n}\s*>|\z)', ' ', 'gis')"
    return s


_BARE = r"regexp_replace(html, '<!--.*?(-->|\z)', ' ', 'gs')"
_MARKUP = cut("bare", "script", "style", "noscript", "template")
_TEXT = squeeze(unescape(rf"regexp_replace(regexp_replace({cut('bare', 'script', 'style', 'noscript', 'template', 'svg')}, '<head\b[^>]*>.*?</head\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"))
_LINK = r"'<a\s+href=\"([^\"]*)\"[^>]*>(.*?)</a>'".replace('\\"', '"')

#: CTEs: u (parts of the address), d (what a page holds); both one row per page.
URLS = r"""u AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages)"""
DOCS = f"""{URLS},
b AS (SELECT *, {_BARE} AS bare FROM u),
m AS (SELECT *, {_MARKUP} AS markup, {_TEXT} AS text FROM b),
d AS (SELECT page_id, url, html, scheme, host, path, query, text, markup,
  list_transform(regexp_extract_all({cut('markup', 'svg', 'math')}, '<title\\b[^>]*>(.*?)</title\\s*>', 1, 'is'), lambda t: {squeeze(unescape('t'))}) AS titles,
  trim(regexp_extract(markup, '<html\\b[^>]*\\slang="([^"]*)"', 1, 'is')) AS lang,
  lower(regexp_extract(markup, '<meta\\b[^>]*\\scharset="([^"]*)"', 1, 'is')) AS charset,
  list_transform(regexp_extract_all(markup, '<h([1-6])\\b[^>]*>.*?</h[1-6]\\s*>', 1, 'is'), lambda x: x::INT) AS levels,
  list_transform(regexp_extract_all(markup, '<h1\\b[^>]*>(.*?)</h1\\s*>', 1, 'is'), lambda x: {squeeze(unescape("regexp_replace(x, '<[^>]*>', '', 'gs')"))}) AS h1s,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))) AS words,
  regexp_extract_all(markup, '<a\\s+href="([^"]*)"[^>]*>', 1, 'is') AS hrefs,
  list_transform(regexp_extract_all(markup, '<a\\s+href="[^"]*"[^>]*>(.*?)</a\\s*>', 1, 'is'), lambda x: {squeeze(unescape("regexp_replace(x, '<[^>]*>', '', 'gs')"))}) AS anchors,
  strlen(html) AS bytes, strlen(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script\\s*>', '', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', '', 'gis')) AS markup_bytes
  FROM m)"""

FETCHED = ", ".join(f"{v} AS {k}" for k, v in DERIVED.items())

#: CTEs: n (number of pages), e (edges src, dst) of the derived link graph, distinct and without loops.
EDGES = """n AS (SELECT count(*) AS n FROM pages),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT page_id AS src, (page_id * 7 + 1) % (SELECT n FROM n) AS dst FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, (page_id * 13 + 5) % (SELECT n FROM n) FROM pages WHERE page_id % 3 <> 0) WHERE src <> dst)"""
