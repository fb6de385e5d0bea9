"""Language identification by interpolated Kneser-Ney character models.

Character 4-grams of all training rows are counted per language in Spark.
Lower orders are continuation counts, so they follow from the distinct
4-grams. Each order becomes one sorted array of 64-bit hashes with the log
probabilities (and, for contexts, the back-off weights) of every language
beside it. A text is given the language of the lowest cross-entropy per
character; the mean and spread of that figure over rows that are set apart for
it, and don't train, calibrate a threshold above which the prediction is marked
as rejected.

Nulls and edges: null or letterless texts (marks aren't letters) are ``und``
with score 0 and marked as rejected. Rows of null language don't train. Without
training rows every text is ``und``. Repeated rows are scored alike, of equal
cross-entropies the first language in order wins. Texts are read whole, other
columns not at all. An empty table gives an empty result.

All 4-grams are kept, whatever their count, so that languages and discounts
don't depend on the size of the input. The model is broadcast; what is gathered
for it, the distinct (language, 4-gram) pairs, grows with the input.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.llm import common

ORDER = 4
#: Standard deviations above a language's mean cross-entropy at which a prediction is rejected.
REJECT_AT = 6.0
#: Of the rows that may train, one in so many calibrates instead.
CALIBRATES = 10
#: Characters' worth of evidence that the score of a long text comes close to.
EVIDENCE = 40.0
PAD, GAP = 1, 32
_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code unit to letter: lower case for letters and marks, a gap for all else."""
    if not _table:
        t = np.full(0x10000, GAP, np.uint16)
        for c in range(0x80, 0x10000):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LM":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        for c in range(65, 91):
            t[c] = t[c + 32] = c + 32
        _table.append(t)
        _table.append(np.array([unicodedata.category(chr(c))[0] == "M" for c in range(0x10000)]))
    return _table[0]


def marks() -> np.ndarray:
    """Which code units are marks: kept in the stream, but not letters."""
    letters()
    return _table[1]


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in one row, each text after ORDER - 1 pads, runs of other characters as one gap; and the text of each place.

    Letters beyond the first plane are folded onto the private area of that plane.
    """
    lengths = np.array([len(t) if t else 0 for t in texts])
    joined = "".join(t for t in texts if t)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes > 0xFFFF
    if wide.any():
        codes = codes.copy()
        for i in np.flatnonzero(wide):
            codes[i] = 0xE000 + codes[i] % 0x1900 if chr(codes[i]).isalpha() else GAP
    low = letters()[codes]
    low = np.where((codes >= 0xE000) & (codes < 0xF900) & wide, codes, low).astype(np.uint16)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = np.ones(len(low), bool)
    keep[1:] = ~((low[1:] == GAP) & (low[:-1] == GAP) & (row[1:] == row[:-1]))
    low, row = low[keep], row[keep]
    counts = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(counts + ORDER - 1)
    at = np.arange(len(low)) + (row + 1) * (ORDER - 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, PAD, np.uint16)
    out[at] = low
    return out, np.repeat(np.arange(len(texts), dtype=np.int32), counts + ORDER - 1)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (oldest character highest) and the places of their last characters, pads left out."""
    at = np.flatnonzero(codes != PAD)
    c = codes.astype(np.uint64)
    key = c[at]
    for k in range(1, ORDER):
        key |= c[at - k] << np.uint64(16 * k)
    return key, at


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over (text, lang); sums inside a task go on before anything is sent."""

    def begin():
        held: dict[str, list] = defaultdict(list)
        size = [0]

        def shrink(parts):
            keys = np.concatenate([k for k, _ in parts])
            u, inv = np.unique(keys, return_inverse=True)
            return u, np.bincount(inv, weights=np.concatenate([n for _, n in parts]), minlength=len(u)).astype(np.int64)

        def flush():
            out = {"lang": [], "gram": [], "n": []}
            for lang, parts in held.items():
                u, n = shrink(parts)
                out["lang"] += [lang] * len(u)
                out["gram"].append(u.view(np.int64))
                out["n"].append(n)
            held.clear()
            size[0] = 0
            return out | {k: np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("gram", "n")}

        def step(c):
            codes, row = stream(c["text"])
            key, at = grams(codes)
            langs = {x: i for i, x in enumerate(dict.fromkeys(c["lang"]))}
            own = np.array([langs[x] for x in c["lang"]])[row[at]] if len(at) else np.zeros(0, int)
            for lang, i in langs.items():
                if len(part := key[own == i]):
                    u, n = np.unique(part, return_counts=True)
                    held[lang].append((u, n))
                    size[0] += len(u)
            if size[0] > 1_000_000:
                size[0] = 0
                for lang in held:
                    held[lang] = [shrink(held[lang])]
                    size[0] += len(held[lang][0][0])
                if size[0] > 500_000:
                    return flush()
            return None

        return step, lambda: [flush()]

    partial = common.map_rows(docs.select("text", "lang"), None, "lang string, gram long, n long", final=begin)
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Rows of values under sorted 64-bit hashes, found through an index of leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = common.mix64(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], np.ascontiguousarray(values[order], np.float32)
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << int(np.uint64(64) - self.shift)) + 1, dtype=np.uint64))
        self.starts = starts.astype(np.int32)
        self.steps = int(np.diff(starts).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found) of each key."""
        h = common.mix64(keys)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        last = max(len(self.hashes) - 1, 0)
        hit = np.zeros(len(h), bool)
        row = at.copy()
        todo = np.flatnonzero(at < end)
        for _ in range(self.steps):
            if not len(todo):
                break
            same = self.hashes[np.minimum(row[todo], last)] == h[todo]
            hit[todo[same]] = True
            todo = todo[~same]
            row[todo] += 1
            todo = todo[row[todo] < end[todo]]
        return row, hit


class Model:
    """Interpolated Kneser-Ney models of all languages over the union of their n-grams."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        self.tables: list[Table] = []
        self.backoff: list[Table] = []
        data = [(keys, counts)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many distinct characters come before
            mask = np.uint64((1 << 16 * k) - 1)
            lower = [np.unique(x & mask, return_counts=True) for x in data[0][0]]
            data.insert(0, ([x for x, _ in lower], [n for _, n in lower]))
        chars = max(1, len(np.unique(np.concatenate(data[0][0]))))
        for k, (keys_k, counts_k) in enumerate(data, 1):
            every = np.unique(np.concatenate(keys_k))
            logp = np.zeros((len(every), len(langs)))
            contexts = np.unique(every >> np.uint64(16))
            weight = np.ones((len(contexts), len(langs)))
            if k == 1:
                base = np.full(logp.shape, 1.0 / (chars + 1))
            else:
                row, _ = self.tables[-1].find(every & np.uint64((1 << 16 * (k - 1)) - 1))
                base = np.exp(self.tables[-1].values[row].astype(float))
            in_context = np.searchsorted(contexts, every >> np.uint64(16))
            for j, (x, n) in enumerate(zip(keys_k, counts_k)):
                n = n.astype(float)
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
                c = np.searchsorted(contexts, x >> np.uint64(16))
                total, types = np.bincount(c, n, len(contexts)), np.bincount(c, minlength=len(contexts))
                seen = total > 0
                weight[seen, j] = d * types[seen] / total[seen]
                p = weight[in_context, j] * base[:, j]
                p[np.searchsorted(every, x)] += (n - d) / total[c]
                logp[:, j] = np.log(p)
            self.tables.append(Table(every, logp))
            self.backoff.append(Table(contexts, np.log(weight)))
        self.unknown = np.float32(np.log(1.0 / (chars + 1)))

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last character given the others, a column for each language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            part = keys[todo] & np.uint64((1 << 16 * k) - 1 if k < 4 else 2**64 - 1)
            row, hit = self.tables[k - 1].find(part)
            out[todo[hit]] += self.tables[k - 1].values[row[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            row, hit = self.backoff[k - 1].find(part >> np.uint64(16))
            out[todo[hit]] += self.backoff[k - 1].values[row[hit]]
        out[todo] += self.unknown
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) nats a character, and letters of each text."""
        codes, row = stream(texts)
        key, at = grams(codes)
        own = row[at]
        n = np.bincount(own, minlength=len(texts))
        letters_of = np.bincount(own, weights=(codes[at] != GAP) & ~marks()[codes[at]], minlength=len(texts))
        sums = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(self.log_probs(key), np.r_[0, np.cumsum(n[full])[:-1]], axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], np.stack([letters_of, n], 1)


def fit(docs: DataFrame) -> Model | None:
    """Train on every row of (text, lang) whose language isn't null."""
    kept = gram_counts(docs.where("lang is not null and text is not null")).toArrow()  # two integers and a language a pair
    if not kept.num_rows:
        return None
    table = kept.to_pandas()
    langs, keys, counts = [], [], []
    for lang, part in table.groupby("lang", sort=True):
        order = np.argsort(part["gram"].to_numpy().view(np.uint64))
        langs.append(lang)
        keys.append(part["gram"].to_numpy().view(np.uint64)[order])
        counts.append(part["n"].to_numpy()[order])
    return Model(langs, keys, counts)


def identify(docs: DataFrame, model: Model | None, train: str = "false") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for rows of (doc_id, text, lang).

    Rows where ``train`` holds calibrate the rejection threshold of the
    language that they are given. The score is the posterior of the chosen
    language at even priors. Characters depend on each other, so the evidence
    of n of them counts as that of n * EVIDENCE / (n + EVIDENCE).
    """
    flags = docs.select("doc_id", "text", F.expr(train).alias("train"))
    if model is None:
        return flags.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(c):
        m = held.value
        ce, n = m.cross_entropies(c["text"])
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(-(n[:, 1:] * EVIDENCE / (n[:, 1:] + EVIDENCE)) * (ce - low[:, None])).sum(1)
        named = n[:, 0] > 0
        return {"doc_id": c["doc_id"], "train": c["train"], "lang_pred": [m.langs[b] if ok else "und" for b, ok in zip(best, named)], "score": np.where(named, score, 0.0), "cross_entropy": [float(x) if ok else None for x, ok in zip(low, named)]}

    scored = common.checkpoint(common.map_rows(flags, step, "doc_id long, train boolean, lang_pred string, score double, cross_entropy double"))
    limits = scored.where("train and cross_entropy is not null").groupBy("lang_pred").agg((F.avg("cross_entropy") + REJECT_AT * F.stddev_pop("cross_entropy")).alias("limit"))
    limit = dict(limits.collect())  # one row for each language of the model
    over = F.lit(False)
    for lang, x in limit.items():
        over = F.when(F.col("lang_pred") == lang, F.col("cross_entropy") > x).otherwise(over)
    return scored.select("doc_id", "lang_pred", "score", "cross_entropy", F.coalesce(over, F.lit(True)).alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (~common.held_out() & F.col("lang").isNotNull()).alias("known"), (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATES)) == 0).alias("apart"))
    model = fit(docs.where("known and not apart"))
    out = identify(docs, model, "known and apart")
    return out.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
