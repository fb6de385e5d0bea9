"""Personal data: checked patterns, and identifiers learned from their contexts.

Base spans are the leftmost, non-overlapping matches of one pattern per kind
that pass the kind's check. The method adds spans of kind ``id`` by
bootstrapping: base spans are the first seeds; the words around seeds (two
before, one before and one after) induce lexical patterns; tokens of the shape
of an identifier that stand in the same contexts are candidates. What fails a
card's or an address's check is known not to be one and counts against its
patterns. Spark keeps the bipartite graph of patterns and instances and scores
it in ROUNDS steps: an instance is as credible as a noisy-or of its patterns, a
pattern as the mean credibility of its distinct instances. Patterns at
MIN_SCORE or more, with MIN_SEEDS distinct seeds, are credible; the candidates
in them become seeds, as strong as they are credible, and induce patterns of
their own. That goes on until no candidate is new. All credible patterns then
mark the candidates that stand in them as identifiers.

Nulls and edges: a null text is empty and has no spans. Spans are code points,
end exclusive, in whole texts, found in time that grows with the length of the
text. Repeated rows and ties give the same rows. Columns of other names are
passed on by ``redact`` and not looked at. An empty table gives an empty
result. Patterns in which no candidate stands mark nothing and are left out. If
at most MAX_PATTERNS are left they are broadcast; else the contexts of
candidates are joined with them and each row is given its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.llm import common

KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A token that may be an identifier: it has a digit.
TOKEN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EDGE = "\"'()[]{}<>,;:!?.*#$%&|"
ROUNDS, MIN_SCORE, MIN_SEEDS, MAX_PATTERNS = 3, 0.8, 5, 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL; only the surroundings of @ are looked at, so long texts stay linear."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str, failed: list | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order. ``failed`` gets the spans of card numbers and addresses that fail on their value."""
    out, failed = [], [] if failed is None else failed
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            good = all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in m.group().split(".")))
            (out if good else failed).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (out if luhn(digits) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    out.sort()
    return out


HAS_DATA = re.compile("[0-9@]")


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Trimmed tokens with a digit that touch no base span and look like an identifier: six digits, or letters among four."""
    out, k = [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        if any(s[0] < b and s[2] > a for s in spans[k : k + 4]):
            continue
        token = m.group()
        a, b = a + len(token) - len(token.lstrip(EDGE)), b - len(token) + len(token.rstrip(EDGE))
        token = text[a:b]
        digits = sum(c.isdigit() for c in token)
        if digits >= 6 or digits >= 4 and any(c.isalpha() for c in token):
            out.append((a, b))
    return out


def words_before(text: str, a: int) -> list[str]:
    """The two words before a place, whole however long they are; fewer at the start of the text."""
    width = 64
    while True:
        start = max(0, a - width)
        words = text[start:a].split()
        if start == 0 or len(words) > 2:  # the first one may be cut
            return words[-2:]
        width *= 4


def word_after(text: str, b: int) -> list[str]:
    """The word that begins at a place or after the spaces there; none at the end of the text."""
    width = 32
    while True:
        words = text[b : b + width].split()
        if b + width >= len(text) or len(words) > 1:
            return words[:1]
        width *= 4


def contexts(text: str, a: int, b: int) -> list[str]:
    """Lexical patterns around a span: the two words before, the word before, the word before and after. Runs of digits are one 0."""
    plain = lambda words: [re.sub("[0-9]+", "0", w.lower()) for w in words]
    before, after = plain(words_before(text, a)), plain(word_after(text, b))
    w1, w2, r1 = (before[-1:] or ["^"])[0], (before[-2:-1] or ["^"])[0], (after or ["$"])[0]
    return [f"{w2} {w1} _", f"{w1} _", f"{w1} _ {r1}"]


def edges(docs: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, seed) with instance as a hash; seed is 1 for base spans, 0 for candidates, -1 for those that fail a check."""

    def step(c):
        out = {"pattern": [], "instance": [], "seed": []}
        for text in c["text"]:
            if not text or not HAS_DATA.search(text):
                continue
            spans = base_spans(text, failed := [])
            for a, b, seed in [(a, b, 1) for a, _, b in spans] + [(a, b, -1) for a, _, b in failed] + [(a, b, 0) for a, b in candidates(text, sorted(spans + failed))]:
                code = int.from_bytes(hashlib.blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                for p in contexts(text, a, b):
                    out["pattern"].append(p)
                    out["instance"].append(code)
                    out["seed"].append(seed)
        return out

    found = common.map_rows(docs.select("text"), step, "pattern string, instance long, seed int")
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def learn(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern): all that are credible and have a candidate to mark."""
    graph = common.checkpoint(edges(docs))
    # What has fewer instances that may count than a pattern needs can't become credible.
    able = graph.groupBy("pattern").agg(F.count_if(F.col("seed") >= 0).alias("able"), F.count_if(F.col("seed") == 0).alias("open"), F.count("*").alias("n")).where(f"able >= {MIN_SEEDS}")
    pairs, graph = graph, common.checkpoint(graph.join(able.select("pattern", "open", "n"), "pattern").select("*", (F.col("seed") > 0).cast("double").alias("weight")))
    common.forget(pairs)
    noisy_or = (1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("belief")  # a sum of logarithms, which partial aggregation can add
    while True:  # each turn makes seeds of candidates, of which there are only so many
        unknown = graph.where("seed = 0 and weight = 0")
        support = graph.groupBy("pattern").agg(F.count_if(F.col("weight") > 0).alias("seeds"), F.sum("weight").alias("mass"), F.max("n").alias("n"), F.max("open").alias("open")).where(f"seeds >= {MIN_SEEDS}")
        support = common.checkpoint(support)
        patterns = support.withColumn("score", F.col("mass") / F.col("n"))
        for _ in range(rounds):
            beliefs = unknown.join(patterns.select("pattern", "score"), "pattern").groupBy("instance").agg(noisy_or)
            gained = unknown.join(beliefs, "instance").groupBy("pattern").agg(F.sum("belief").alias("gained"))
            patterns = support.join(gained, "pattern", "left").withColumn("score", (F.col("mass") + 0.5 * F.coalesce("gained", F.lit(0.0))) / F.col("n")).drop("gained")
        credible = common.checkpoint(patterns.where(F.col("score") >= MIN_SCORE).select("pattern", "score", "open"))
        found = common.checkpoint(unknown.join(credible, "pattern").groupBy("instance").agg(noisy_or))
        if found.isEmpty():
            common.forget(graph, support, found)
            return credible.where("open > 0").select("pattern")
        before, graph = graph, common.checkpoint(graph.join(found, "instance", "left").withColumn("weight", F.when((F.col("seed") == 0) & (F.col("weight") == 0), F.coalesce("belief", F.lit(0.0))).otherwise(F.col("weight"))).drop("belief"))
        common.forget(before, support, credible, found)


def apply(docs: DataFrame, fn, schema) -> DataFrame:
    """``fn(columns, patterns of each row)`` over ``docs``, with the patterns learned from them."""
    patterns = learn(docs)
    few = {r["pattern"] for r in patterns.collect()} if patterns.count() <= MAX_PATTERNS else None
    if few is not None:
        held = docs.sparkSession.sparkContext.broadcast(few)
        return common.map_rows(docs, lambda c: fn(c, [held.value] * len(c["text"])), schema)
    key = F.sha2(F.col("text"), 256)

    def open_contexts(c):
        out = {"key": [], "pattern": []}
        for k, text in zip(c["key"], c["text"]):
            if text and HAS_DATA.search(text):
                spans = base_spans(text, failed := [])
                each = {p for a, b in candidates(text, sorted(spans + failed)) for p in contexts(text, a, b)}
                out["key"] += [k] * len(each)
                out["pattern"] += each
        return out

    stand = common.map_rows(docs.select(key.alias("key"), "text"), open_contexts, "key string, pattern string").distinct()
    own = stand.join(patterns, "pattern").groupBy("key").agg(F.collect_set("pattern").alias("__patterns"))  # as many as a text's own contexts
    with_own = docs.withColumn("__key", key).join(own, F.col("__key") == own["key"], "left").select(*docs.columns, "__patterns")
    return common.map_rows(with_own, lambda c: fn(c, [set(x or ()) for x in c.pop("__patterns")]), schema)


def all_spans(text: str, patterns: Container[str]) -> tuple[list, list]:
    """Base spans, and base with learned ones in order."""
    if not HAS_DATA.search(text):
        return [], []
    base = base_spans(text, failed := [])
    if not patterns:
        return base, base
    more = [(a, 4, b) for a, b in candidates(text, sorted(base + failed)) if any(p in patterns for p in contexts(text, a, b))]
    return base, sorted(base + more) if more else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans, n_id."""

    def step(c, patterns):
        out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_id")}
        for doc_id, text, own in zip(c["doc_id"], c["text"], patterns):
            base, every = all_spans(text or "", own)
            out["doc_id"].append(doc_id)
            for k in range(4):
                out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
            out["n_id"].append(len(every) - len(base))
        return out

    return apply(docs.select("doc_id", "text"), step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_id long")


def masked(text: str | None, patterns: Container[str]) -> str | None:
    """The text with each span (overlapping ones joined, named by the first) replaced by <KIND>."""
    if not text:
        return text
    out, end = [], 0
    for a, k, b in all_spans(text, patterns)[1]:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked; n_chars follows where it exists."""
    counted = "n_chars" in docs.columns

    def step(c, patterns):
        texts = [masked(t, own) for t, own in zip(c["text"], patterns)]
        changed = {"n_chars": [n if t is old or t == old else len(t) for n, t, old in zip(c["n_chars"], texts, c["text"])]} if counted else {}
        return c | {"text": texts} | changed

    return apply(docs, step, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"))
