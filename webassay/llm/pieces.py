"""Sampled segmentation over the piece lattice of a SentencePiece vocabulary, and lossless decoding.

A text is cut into chunks, a word with the spaces before it; no piece of the
vocabularies has a space behind another sign, so chunks are segmented
independently. Over a chunk's lattice of pieces a forward pass sums the weights
of all segmentations up to each place; a backward pass then draws pieces from
the end, each with its share of that sum. So a segmentation is drawn with
probability proportional to the product of its pieces' weights to the power
``alpha``. Forward sums are made once for each distinct chunk of a batch; the backward
pass goes over all chunks of a batch at once, as does the forward pass over
its distinct chunks; the last few, long ones are followed place by place. Random
numbers are hashes of the row key, the chunk's number and the step, so a row's
segmentation is the same in any batch, partition and run.

A merge vocabulary has ranks, not probabilities. Piece weights follow Zipf's
law over the ranks: 1 / ((rank + ZIPF) * H). Signs without a piece become byte
pieces of a fixed, smaller weight. Nothing is normalised and no space is added,
so decoding gives the text back, the sign U+2581 included.

Nulls and edges: a null text has null ids, an empty text none. A null key
counts as 0. Rows of one key and text get one segmentation. Long texts, also
those without spaces, are cut whole. Other columns are passed on, whatever their
names; those named ids, n_tokens or lossless are replaced. Decoding ids that
aren't valid UTF-8 together replaces what is wrong. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.llm import common
from webassay.llm.langid import Table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, ZIPF, SEED = 0.7, 3.0, 20_240
MARK = "▁"
CHUNK = re.compile(" *[^ ]+| +")
ROLL = 0x100000001B3
#: Characters of texts that are segmented together: more of them share their chunks.
STEP = 1_500_000
#: With fewer chunks left than this, passes go on place by place instead of over arrays.
FEW = 12


class Vocabulary:
    """Pieces with log weights, byte pieces, and the bytes that each id stands for."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], texts: list[bytes]):
        self.texts, self.byte_ids = texts, np.array(byte_ids, np.int64)
        self.longest = max(map(len, pieces), default=1)
        self.byte_weight = min((w for _, w in pieces.values()), default=0.0) - 2.0
        # Each prefix of a piece: its id (or -1 where it is no piece) and its log weight, under a rolling hash.
        prefixes: dict[str, tuple[int, float]] = {}
        for piece, found in pieces.items():
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], (-1, 0.0))
            prefixes[piece] = found
        keys = np.array([self.rolled(x) for x in prefixes], np.uint64)
        self.prefixes = Table(keys, np.array(list(prefixes.values())).reshape(-1, 2))

    @staticmethod
    def rolled(text: str) -> int:
        h = 0
        for c in text:
            h = (h * ROLL + ord(c) + 1) % 2**64
        return h

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        plain.sort(key=lambda i: (-sp.get_score(i), i))
        total = math.log(sum(1 / (r + ZIPF) for r in range(len(plain))))
        pieces = {sp.id_to_piece(i): (i, -math.log(r + ZIPF) - total) for r, i in enumerate(plain)}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        texts = [b""] * sp.get_piece_size()
        for p, (i, _) in pieces.items():
            texts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
        return cls(pieces, byte_ids, texts)

    def lattices(self, chunks: list[str], alpha: float) -> tuple[np.ndarray, ...]:
        """Lattices of all chunks: (places, number of place 0 of each chunk, and of each edge, by end: end, start, id, summed share of its end).

        A sign of several bytes without a piece is one edge; its id is the code point beyond all ids.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        base = np.r_[0, np.cumsum(sizes + 1)]
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chunk = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes)
        place = (np.arange(len(codes)) + chunk).astype(np.int32)  # number of the place before each sign
        left = base[chunk] + sizes[chunk] - place  # signs from here to the chunk's end
        signs = np.where(codes == 32, ord(MARK), np.where(codes == ord(MARK), -1, codes)).astype(np.uint64) + np.uint64(1)
        live, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        plain = np.zeros(len(codes), bool)
        starts, ends, ids, weights = [], [], [], []
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                h = h * np.uint64(ROLL) + signs[live + n - 1]
                row, hit = self.prefixes.find(h)
                live, h, row = live[hit], h[hit], row[hit]
                found = self.prefixes.values[row]
                real = found[:, 0] >= 0
                if n == 1:
                    plain[live[real]] = True
                starts.append(place[live[real]])
                ends.append(place[live[real]] + n)
                ids.append(found[real, 0].astype(np.int32))
                weights.append((alpha * found[real, 1]).astype(np.float32))
                more = left[live] > n
                live, h = live[more], h[more]
                if not len(live):
                    break
        rest = np.flatnonzero(~plain)
        if len(rest):
            c = codes[rest]
            width = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
            starts.append(place[rest])
            ends.append(place[rest] + 1)
            ids.append(np.where(c < 0x80, self.byte_ids[np.minimum(c, 255)], len(self.texts) + c).astype(np.int32))
            weights.append((alpha * self.byte_weight * width).astype(np.float32))
        del codes, chunk, left, signs, live, h, plain, place
        order = np.argsort(np.concatenate(ends), kind="stable").astype(np.int32)
        sort = lambda parts: np.concatenate(parts)[order]
        start, end, ident, weight = sort(starts), sort(ends), sort(ids), sort(weights)
        del order, starts, ends, ids, weights
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])  # of each place that edges end at: all but a chunk's place 0
        fan = np.diff(np.r_[first, len(end)])
        # Forward sums, for all chunks together by the distance of a place from its chunk's start.
        depth = end[first] - base[np.searchsorted(base, end[first], side="right") - 1]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        forward = np.zeros(int(base[-1]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < FEW:  # only few chunks are as long as this, and none of the longer ones comes back
                self.follow(forward, by_depth[a:], first, fan, start, end, weight)
                break
            at = by_depth[a:b]
            f = fan[at]
            offsets = np.r_[0, np.cumsum(f)[:-1]]
            edge = np.repeat(first[at] - offsets, f) + np.arange(int(f.sum()))
            value = forward[start[edge]] + weight[edge]
            top = np.maximum.reduceat(value, offsets)
            forward[end[first[at]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, f)), offsets))
        share = np.cumsum(np.exp(forward[start] + weight - forward[end]))
        share -= np.repeat(np.r_[0.0, share[first[1:] - 1]], fan)
        share[np.r_[first[1:], len(end)] - 1] = 1.0
        return sizes, base, end, start, ident, share

    @staticmethod
    def follow(forward, at, first, fan, start, end, weight) -> None:
        """Forward sums of ``at`` place by place: for long chunks (texts without spaces), where arrays would hold a few places each."""
        counts = fan[at]
        edge = np.repeat(first[at] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(int(counts.sum()))
        own = np.unique(start[edge])
        known = dict(zip(own.tolist(), forward[own].tolist()))  # those not yet summed are overwritten before they are read
        starts, weights, ends = start[edge].tolist(), weight[edge].tolist(), end[first[at]].tolist()
        exp, log, k, sums = math.exp, math.log, 0, []
        for place, n in zip(ends, counts.tolist()):
            values = [known[starts[i]] + weights[i] for i in range(k, k + n)]
            top = max(values)
            known[place] = top + log(sum([exp(v - top) for v in values]))
            sums.append(known[place])
            k += n
        forward[ends] = sums

    def encode(self, texts: list[str | None], keys: list[int | None], alpha: float, seed: int) -> list[np.ndarray | None]:
        """Sampled ids of each text."""
        chunks: list[str] = []
        counts = []
        for t in texts:
            found = CHUNK.findall(t) if t else []
            chunks += found
            counts.append(len(found))
        place = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
        kind = np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))
        if not len(chunks):
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        sizes, base, ends, starts, ids, shares = self.lattices(list(place), alpha)
        first_edge = np.zeros(int(base[-1]), np.int64)
        opens = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        first_edge[ends[opens]] = opens
        counts = np.array(counts)
        first = np.r_[0, np.cumsum(counts)]
        number = np.arange(len(chunks)) - np.repeat(first[:-1], counts)
        key = np.array([k or 0 for k in keys], np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            stream = np.repeat(common.mix64(key + np.uint64(seed)), counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at, zero = base[kind] + sizes[kind], base[kind]
            live, drawn = np.arange(len(chunks)), []
            step = 0
            while len(live) >= max(FEW, 1):
                u = (common.mix64(common.mix64(stream[live]) + np.uint64(step)) >> np.uint64(11)).astype(float) / 2**53
                edge = first_edge[at]
                todo = np.flatnonzero(shares[edge] <= u)  # the last share of a place is 1
                while len(todo):
                    edge[todo] += 1
                    todo = todo[shares[edge[todo]] <= u[todo]]
                drawn.append((live, ids[edge], step))
                at = starts[edge]
                more = at > zero
                live, at, zero = live[more], at[more], zero[more]
                step += 1
            self.draw(drawn, live, at, zero, stream, step, first_edge, shares, starts, ids)
        taken = np.zeros(len(chunks), np.int64)
        for who, got, from_ in drawn:
            taken[who] = from_ + (1 if isinstance(who, np.ndarray) else len(got))
        last = np.cumsum(taken)
        out = np.empty(int(last[-1]), np.int32)
        for who, got, from_ in drawn:
            if isinstance(who, np.ndarray):
                out[last[who] - 1 - from_] = got
            else:
                out[last[who] - from_ - len(got) : last[who] - from_] = got[::-1]
        cuts = np.r_[0, last][first]
        rows: list[np.ndarray | None] = [out[cuts[i] : cuts[i + 1]] if t is not None else None for i, t in enumerate(texts)]
        if (out >= len(self.texts)).any():
            rows = [r if r is None or not (r >= len(self.texts)).any() else self.spelled(r) for r in rows]
        return rows

    @staticmethod
    def draw(drawn: list, live, at, zero, stream, step: int, first_edge, shares, starts, ids) -> None:
        """The rest of the backward pass, chunk by chunk, with the same random numbers."""
        for who, place, stop in zip(live.tolist(), at.tolist(), zero.tolist()):
            path, size = [], max(64, min(place - stop, 1 << 16))
            key, k = common.mix64(stream[who : who + 1]), 0
            while place > stop:
                if k % size == 0:  # random numbers of the next steps
                    with np.errstate(over="ignore"):
                        chances = ((common.mix64(key + np.arange(step + k, step + k + size, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2**53).tolist()
                edge, u = int(first_edge[place]), chances[k % size]
                while shares[edge] <= u:
                    edge += 1
                path.append(int(ids[edge]))
                place, k = int(starts[edge]), k + 1
            drawn.append((who, path, step))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Signs without a piece, as bytes."""
        size, out = len(self.texts), []
        for i in ids.tolist():
            out += [i] if i < size else [int(self.byte_ids[b]) for b in chr(i - size).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        texts = self.texts
        return b"".join([texts[i] for i in ids]).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``docs`` without ``text`` but with ids, n_tokens and whether decoding gave the text back."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # one vocabulary, tens of thousands of pieces
    docs = docs.drop("ids", "n_tokens", "lossless")
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + ["ids array<int>", "n_tokens long", "lossless boolean"])

    def step(c):
        v = held.value
        ids = v.encode(c["text"], c[key], alpha, seed)
        same = [v.decode(None if r is None else r.tolist()) == t for r, t in zip(ids, c["text"])]
        return {k: c[k] for k in names} | {"ids": ids, "n_tokens": [None if r is None else len(r) for r in ids], "lossless": same}

    return common.map_rows(docs, step, schema, most=STEP)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """``tokens`` with the text that ``ids`` stand for."""
    held = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    names = tokens.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema] + ["text string"])
    return common.map_rows(tokens, lambda c: {k: c[k] for k in names} | {"text": [held.value.decode(x) for x in c["ids"]]}, schema, text="ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "lossless", "ids")
