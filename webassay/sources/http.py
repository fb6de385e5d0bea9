"""A Spark data source that fetches addresses: ``spark.read.format("webfetch").option("urls", ...)``.

One row per request, failures included. Addresses are dealt to partitions by
host, so each host is visited by one task at a time and with a delay. Options:
``probe`` (true: only whether an address answers), ``known`` (JSON of validators
by address, for conditional requests), ``agent``, ``timeout``, ``retries``,
``delay``.
"""

from __future__ import annotations

import json
import random
import time
import zlib
from collections import defaultdict
from email.utils import parsedate_to_datetime
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "requested_url string, final_url string, status int, headers map<string,string>, body binary, redirects array<struct<url:string,status:int,location:string>>, ttfb_ms double, requests int, truncated boolean, error string, error_detail string"
TEXTUAL = ("text/", "application/xhtml", "application/xml", "application/json", "application/javascript", "application/ld+json")


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def error_kind(e: BaseException) -> str:
    """timeout, dns, tls, connection or other, along the chain of causes."""
    seen: BaseException | None = e
    while seen is not None:
        name, text = type(seen).__name__.lower(), str(seen).lower()
        if "timeout" in name or "timed out" in text:
            return "timeout"
        if "gaierror" in name or "name or service" in text:
            return "dns"
        if ("ssl" in name or "certificate" in text) and "want" not in name:
            return "tls"
        if isinstance(seen, ConnectionError):
            return "connection"
        seen = seen.__cause__ or seen.__context__ or (seen.reason if isinstance(getattr(seen, "reason", None), BaseException) else None)
    return "connection" if isinstance(e, URLError) else "other"


def backoff(attempt: int, pick=random.uniform) -> float:
    """Seconds before the next attempt: half a second, or up to twice as long as the time before."""
    return min(30.0, pick(0.5, max(0.5, 0.5 * 2**attempt)))


def wait_for(headers: dict, now: float) -> float:
    """Seconds that Retry-After asks for, a minute at most; 0 if it doesn't."""
    value = headers.get("retry-after", "").strip()
    try:
        seconds = float(value) if value.replace(".", "", 1).isdigit() else parsedate_to_datetime(value).timestamp() - now
    except (TypeError, ValueError):
        return 0.0
    return max(0.0, min(60.0, seconds))


def unzipped(body: bytes, most: int) -> tuple[bytes, bool]:
    """(body, whether it was cut): what gzip holds, as far as it can be read and up to ``most`` bytes; other bodies as they are."""
    if not body.startswith(b"\x1f\x8b"):
        return body[:most], len(body) > most
    reader = zlib.decompressobj(wbits=31)
    try:
        out = reader.decompress(body, most + 1)
    except zlib.error:
        return body[:most], len(body) > most
    return out[:most], len(out) > most


def fetch(url: str, agent: str = "webassay", timeout: float = 15.0, hops: int = 10, max_bytes: int = 5_000_000, retries: int = 2, sleep=time.sleep, method: str = "GET", known: dict | None = None) -> tuple:
    """One address, redirects followed by hand, server errors retried after a growing wait.

    ``known`` has the etag and last_modified of a cached answer: an unchanged
    page answers 304 and has no body.
    """
    opener, at, redirects, requests = build_opener(_NoRedirect), url, [], 0
    asked = {"User-Agent": agent, "Accept-Encoding": "gzip"}
    asked |= {k: v for k, v in (("If-None-Match", (known or {}).get("etag")), ("If-Modified-Since", (known or {}).get("last_modified"))) if v}
    for attempt in range(retries + 1):
        try:
            while True:
                requests += 1
                began = time.monotonic()
                try:
                    answer = opener.open(Request(at, headers=asked, method=method), timeout=timeout)
                except HTTPError as e:
                    answer = e
                ttfb = (time.monotonic() - began) * 1000
                headers = {k.lower(): v for k, v in answer.headers.items() if k.lower() != "set-cookie"}
                if cookies := answer.headers.get_all("set-cookie"):
                    headers["set-cookie"] = "\n".join(cookies)
                if answer.status in (301, 302, 303, 307, 308) and "location" in headers:
                    to = urljoin(at, headers["location"])
                    redirects.append((at, answer.status, headers["location"]))
                    if len(redirects) > hops or any(r[0] == to for r in redirects):
                        return url, at, answer.status, headers, None, redirects, ttfb, requests, False, "redirect_loop", to
                    at = to
                    continue
                break
            if answer.status in (429, 500, 502, 503, 504) and attempt < retries:
                sleep(max(backoff(attempt), wait_for(headers, time.time())))
                continue
            kind = headers.get("content-type", "text/html").lower()
            wanted = method == "GET" and answer.status != 304 and (kind.startswith(TEXTUAL) or "gzip" in kind)
            body, cut = unzipped(answer.read(max_bytes + 1), max_bytes) if wanted else (None, False)
            return url, at, answer.status, headers, body, redirects, ttfb, requests, cut, None, None
        except Exception as e:  # noqa: BLE001  a failed fetch is a row
            if attempt == retries:
                return url, at, None, {}, None, redirects, None, requests, False, error_kind(e), str(e)[:500]
            sleep(backoff(attempt))
    raise AssertionError("unreachable")


def probe(url: str, **options) -> tuple:
    """Whether an address answers: HEAD, and GET where a server refuses or mishandles that."""
    first = fetch(url, method="HEAD", **options)
    return fetch(url, **options) if first[9] is not None or first[2] in (403, 405, 501) else first


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        hosts = defaultdict(list)
        for url in filter(None, self.options.get("urls", "").split("\n")):
            hosts[urlsplit(url).netloc].append(url)
        return [_Host(x) for x in hosts.values()]

    def read(self, partition):
        delay = float(self.options.get("delay", "0.25"))
        for i, url in enumerate(partition.urls):
            if i:
                time.sleep(delay)
            known = json.loads(self.options.get("known", "{}"))  # url: {etag, last_modified}
            options = {"agent": self.options.get("agent", "webassay"), "timeout": float(self.options.get("timeout", "15")), "retries": int(self.options.get("retries", "2"))}
            yield probe(url, **options) if self.options.get("probe", "false") == "true" else fetch(url, known=known.get(url), **options)


class WebFetch(DataSource):
    @classmethod
    def name(cls):
        return "webfetch"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(WebFetch)
