"""Best-fit packing into sequences, certified by lower bounds from dual-feasible functions.

Documents become ids and an end id; only longer ones than a sequence are cut,
into pieces that fill one each, but for a shorter first piece. What is left to
pack is dealt to parts of about PART pieces. In each part best-fit decreasing
places pieces, the longest first, where the least room remains.

A dual-feasible function f maps lengths to shares such that no full sequence
holds more than 1 together; so no packing of a part has fewer sequences than
the sum of f over its pieces, whichever f. The family used raises lengths
above ``limit - t`` to whole sequences and drops those below t, for every t,
and rounds by multiples of 1 / (k + 1). Parts that reach their bound are
certified and only hand on what rounding up the bound leaves: the one sequence
with most room. Parts with a gap hand on all sequences with room, as long as
packing them anew saves some; then they too hand on only the loosest. What is
handed on by all parts meets in new ones of the same size, and a new
arrangement is taken where it has fewer sequences than the one before. The
last round is the one with a single part.

Nulls and edges: null and empty texts are one piece that holds the end id. Rows
with a null doc_id, and rows that repeat one, are documents of their own. Long
texts are encoded whole. Other columns of ``docs`` aren't looked at. An empty
table gives an empty result. Pieces of one length are taken in the order of
the rows; where they lie may differ when rows are read in another order, not
how many sequences there are beyond chance.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.llm import common

LIMIT, END = 1024, 2
#: Pieces in a part, about.
PART = 10_000
#: The family of dual-feasible functions: one for each threshold up to half a sequence, and roundings by 1 / (k + 1).
ROUNDINGS = range(1, 33)
#: What a handed-on piece keeps of where it lies: sequences are numbered (round, part, place).
ROUND_BITS, PLACE_BITS = 48, 20


def vocabulary() -> tuple[str, str]:
    """(pattern that splits texts, file of ranks); the same vocabulary as byte_bpe_50k.json, read by the library that encodes four times as fast."""
    import public_tokenizers

    return public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(pattern: str, ranks: str) -> Callable[[str], list[int]]:
    """Text to ids, made once in a worker. Strings of special tokens are ordinary text."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full, but for a shorter first one."""
    first = n - (ceil(n / limit) - 1) * limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def pieces_of(docs: DataFrame, limit: int = LIMIT, end: int = END, files: tuple[str, str] | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian numbers of 32 bits) of the pieces of (doc_id, text)."""
    files = files or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def step(c):
        encode, rows = encoder(*files), []
        for key, text in zip(c["doc_id"], c["text"]):
            raw = np.array([*encode(text or ""), end], "<u4").tobytes()
            for i, (start, length) in enumerate(cuts(len(raw) // 4, limit)):
                part = raw[4 * start : 4 * (start + length)]
                rows.append((key, i, start, length, zlib.crc32(part), part))
        return dict(zip(names, map(list, zip(*rows)))) if rows else None

    return common.map_rows(docs.select("doc_id", "text"), step, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def shares(limit: int) -> np.ndarray:
    """Dual-feasible functions by row: f[length] for lengths 0 to ``limit``, in units such that a sequence holds at most f[0] of them.

    Exact in integers: column 0 holds the unit. The first row is the length
    itself. Row t raises lengths above limit - t to a whole sequence, keeps
    those from t on and drops the others: two lengths of which one is above
    limit - t leave less than t for the rest. Row k keeps lengths x with
    (k + 1) x / limit whole and rounds the others down by k: floor((k + 1) x / limit) / k.
    """
    x = np.arange(limit + 1)
    rows = [np.r_[limit, x[1:]]]
    rows += [np.r_[limit, np.where(x > limit - t, limit, np.where(x >= t, x, 0))[1:]] for t in range(1, limit // 2 + 1)]
    rows += [np.r_[k * limit, np.where((k + 1) * x % limit == 0, k * x, (k + 1) * x // limit * limit)[1:]] for k in ROUNDINGS]
    return np.array(rows, np.int64)


def least_sequences(lengths: np.ndarray, limit: int = LIMIT) -> int:
    """The largest bound that a function of the family gives: no packing has fewer sequences."""
    table = shares(limit)
    sums = table[:, 1:] @ np.bincount(lengths, minlength=limit + 1)[1:]
    return int(np.max(-(-sums // table[:, 0])))


def best_fit(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length by best-fit decreasing; lengths alike keep their order.

    Sequences are kept by their room; a number whose bits are the rooms at hand finds the least one that suffices.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at, made = limit, made, made + 1
        sequence[i], offset[i] = at, limit - room
        if room > n:
            by_room[room - n].append(at)
            rooms |= 1 << (room - n)
    return sequence, offset


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, handed boolean, certified boolean, saves boolean"


def packer(level: int, limit: int, last: bool):
    """Pack a part anew, take that where it saves a sequence, and say which sequences are handed on."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = df["length"].to_numpy(np.int64)
        sequence, offset = best_fit(lengths, limit)
        used, before = int(sequence.max()) + 1, df["sequence_id"].nunique()
        saves = level == 0 or used < before
        if saves:
            df["sequence_id"], df["offset"] = (level << ROUND_BITS | int(df["part"].iloc[0]) << PLACE_BITS) + sequence, offset
        room = limit - df.groupby("sequence_id")["length"].transform("sum").to_numpy()
        certified = min(used, before) == least_sequences(lengths, limit)
        loosest = (df["sequence_id"] == df["sequence_id"].iloc[int(room.argmax())]).to_numpy()
        handed = (room > 0) & (not last) & (loosest if certified or not saves else True)
        return df.assign(handed=handed, certified=certified, saves=saves).drop(columns="part")

    return run


def pack(pieces: DataFrame, limit: int = LIMIT, part: int = PART) -> DataFrame:
    """``pieces`` (the columns of pieces_of without ids, and row, a number of their own) with sequence_id, offset and certified: whether the part that placed it reached its bound.

    Whole pieces fill a sequence each. The others are dealt to parts by their
    row numbers, so no document's pieces and no group of copies meet in one.
    Sequences that are handed on stay together in the part that they come to.
    """
    named = lambda df, handed: df.select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(handed).alias("handed"), F.lit(not handed).alias("certified"), F.lit(False).alias("saves"))
    done, waiting, level = named(pieces.where(F.col("length") >= limit), False), named(pieces.where(F.col("length") < limit), True), 0
    left, saving, parts = waiting.count(), True, 0
    while left:
        # Where nothing was saved only the loosest sequences are left, one of each part: they meet in half as many.
        parts = ceil(left / part) if saving else min(ceil(left / part), parts // 2)
        dealt = waiting.drop("handed", "certified", "saves").withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
        out = common.checkpoint(dealt.groupBy("part").applyInPandas(packer(level, limit, parts == 1), PACKED))
        done, waiting, level = done.unionByName(out.where("not handed")), out.where("handed"), level + 1
        left, saving = waiting.agg(F.count("*"), F.coalesce(F.max("saves"), F.lit(False))).first()
    return done.drop("handed", "saves")


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with row, written so that the numbers stay."""
    return common.checkpoint(pieces.withColumn("row", F.monotonically_increasing_id()))


def sequences(docs: DataFrame, limit: int = LIMIT, end: int = END, files: tuple[str, str] | None = None) -> DataFrame:
    """sequence_id, ids (array<long>), doc_ids, starts: the packed sequences; ``limit`` ids at most meet in one row."""
    whole = numbered(pieces_of(docs, limit, end, files, ids=True))
    placed = pack(whole.drop("ids"), limit).select("row", "sequence_id", "offset")
    parts = whole.join(placed, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("parts"))

    def unpacked(c):
        return {"sequence_id": c["sequence_id"], "ids": [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int64) for p in c["parts"]], "doc_ids": [[x["doc_id"] for x in p] for p in c["parts"]], "starts": [[x["offset"] for x in p] for p in c["parts"]]}

    return common.map_rows(parts, unpacked, "sequence_id long, ids array<long>, doc_ids array<long>, starts array<long>", text=None)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(numbered(pieces_of(common.read(spark, sf_dir, "documents")))).drop("row")
