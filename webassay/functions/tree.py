"""Projections that need the element tree, over Arrow batches with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class Controls(HTMLParser):
    """Controls without a name: (kind, identifier)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.found: list[tuple[str, str]] = []

    @staticmethod
    def named(attrs: dict, alt: str | None = None) -> bool:
        if (attrs.get("aria-hidden") or "").lower() == "true" or (attrs.get("role") or "").lower() in ("presentation", "none"):
            return True
        return bool("".join((alt if alt is not None else attrs.get("alt") or "", attrs.get("aria-label") or "", attrs.get("aria-labelledby") or "", attrs.get("title") or "")).strip()) or ("alt" in attrs and alt is None and not (attrs["alt"] or "").strip())

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "input" and a.get("type", "").lower() == "image" and not self.named(a):
            self.found.append(("input image", a.get("src", "") or "(no src)"))
        if tag == "area" and not self.named(a):
            self.found.append(("image map area", a.get("href", "") or "(no href)"))
        if a.get("role", "").lower() == "img" and tag not in ("img", "svg") and not self.named(a):
            self.found.append(('role="img" element', a.get("class", "") or tag))
        if tag in VOID:
            return
        if tag == "svg" and self.stack and self.stack[-1]["tag"] in ("a", "button"):
            self.stack[-1]["svgs"].append(a | {"__title": ""})
        self.stack.append({"tag": tag, "attrs": a, "text": "", "svgs": []})

    def handle_endtag(self, tag):
        while any(x["tag"] == tag for x in self.stack):
            top = self.stack.pop()
            self.close_element(top)
            if top["tag"] == tag:
                break

    def close_element(self, top):
        if self.stack and top["tag"] != "svg":
            self.stack[-1]["text"] += top["text"]
        if top["tag"] == "title" and any(x["tag"] == "svg" for x in self.stack):
            for x in reversed(self.stack):
                if x["svgs"]:
                    x["svgs"][-1]["__title"] += top["text"]
                    break
        if top["tag"] in ("a", "button") and not top["text"].strip():
            for svg in top["svgs"]:
                own = dict(svg)
                for k in ("aria-label", "aria-labelledby", "title"):
                    own[k] = own.get(k) or top["attrs"].get(k, "")
                if not self.named(own, own.pop("__title")):
                    self.found.append(("svg in a link or button", top["attrs"].get("href", "").strip() or "(button)"))

    def handle_data(self, data):
        if self.stack and self.stack[-1]["tag"] not in ("script", "style"):
            self.stack[-1]["text"] += data

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        while self.stack:
            self.close_element(self.stack.pop())
        return self.found


def controls(html: str | None) -> list[tuple[str, str]]:
    parser = Controls()
    parser.feed(html or "")
    return parser.finish()


def unnamed_controls(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [(i, u, *c) for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3))) for c in controls(h)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["page_id", "url", "kind", "identifier"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id long, url string, kind string, identifier string")
