"""Best-fit packing: pieces and ids by the public library, bounds by exhaustive search, sequences without gaps, odd input."""

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np


from webassay.llm import packing

from test_operators import ODD, docs, prose


def optimum(lengths, limit):
    """The least number of sequences by trying every one for each length."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [r - lengths[i] * (j == k) for k, r in enumerate(rooms)])
        place(i + 1, [*rooms, limit - lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_hold_for_every_full_sequence():
    """No multiset of lengths within a sequence has more than one whole share, whichever function is taken."""
    limit = 13
    table = packing.shares(limit)
    most = np.zeros((len(table), limit + 1), np.int64)
    for room in range(1, limit + 1):
        for n in range(1, room + 1):
            most[:, room] = np.maximum(most[:, room], most[:, room - n] + table[:, n])
    assert (most[:, limit] <= table[:, 0]).all() and (most[:, limit] == table[:, 0]).any()


def test_best_fit_between_bound_and_optimum():
    r = random.Random(4)
    tight = 0
    for _ in range(60):
        limit = r.choice([10, 17, 24])
        lengths = np.array([r.randint(1, limit - 1) for _ in range(r.randint(1, 9))])
        sequence, offset = packing.best_fit(lengths, limit)
        used, least, best = sequence.max() + 1, packing.least_sequences(lengths, limit), optimum(sorted(lengths.tolist(), reverse=True), limit)
        assert least <= best <= used <= best + 1
        tight += least == best
        for s in range(used):
            own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == s))
            assert [o for o, _ in own] == np.r_[0, np.cumsum([n for _, n in own])[:-1]].tolist() and sum(n for _, n in own) <= limit
    assert tight > 50


def test_best_fit_takes_the_least_room():
    """The same sequences as looking at every open one for each length."""
    r = random.Random(5)
    lengths = np.array([r.randint(1, 99) for _ in range(400)])
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fitting = [(room, j) for j, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting)[1]] -= n
        else:
            rooms.append(100 - n)
    sequence, _ = packing.best_fit(lengths, 100)
    assert sorted(100 - np.bincount(sequence, lengths)) == sorted(rooms)


def check(rows, wanted, limit):
    """Every piece of every document once, in sequences without gaps."""
    by_sequence, pieces = {}, []
    for x in rows:
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, x.length))
        pieces.append((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    assert sorted(pieces) == sorted(wanted)
    return len(by_sequence)


def wanted_of(pairs, limit):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out = []
    for key, text in pairs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % limit or min(limit, len(ids))
        bounds = [0, *range(first, len(ids) + 1, limit)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out.append((str(key), i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def test_pieces_and_sequences(spark):
    texts = [*ODD, "a<|endoftext|>b", "don't  stop\r\n\t  now it's 12345 ß中文   x" * 9, "y" * 30_000, *(prose(i, 5 + 37 * i % 900) for i in range(120))]
    rows = docs(spark, texts).union(docs(spark, [prose(7, 50)] * 40).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars")).withColumn("row", packing.F.lit("clash"))
    pairs = [(x.doc_id, x.text) for x in rows.collect()]
    for limit, part in ((1024, 10_000), (64, 25)):
        made = packing.numbered(packing.pieces_of(rows, limit))
        packed = packing.pack(made, limit, part)
        got = packed.collect()
        used = check(got, wanted_of(pairs, limit), limit)
        least = packing.least_sequences(np.array([x.length for x in got]), limit)
        assert least <= used <= least + 2 + used // 50, (least, used)
    assert all(x.certified for x in got if x.length == limit)


def test_exchange_saves_sequences(spark):
    """Parts of a few pieces leave room that only exchange can fill; the bound is then reached."""
    r = random.Random(6)
    rows = [(i, 0, 0, r.choice([1, 2, 3, 30, 51, 52]), 0) for i in range(600)]
    pieces = packing.numbered(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4))
    got = packing.pack(pieces, 100, 40).collect()
    lengths = np.array([x.length for x in got])
    alone = sum(packing.best_fit(lengths[i : i + 40], 100)[0].max() + 1 for i in range(0, 600, 40))
    used = len({x.sequence_id for x in got})
    assert len(got) == 600 and packing.least_sequences(lengths, 100) <= used < alone


def test_sequences_hold_the_ids(spark):
    import tiktoken  # noqa: F401

    texts = ["one two", None, prose(3, 700), "x y z"]
    encode = packing.encoder(*packing.vocabulary())
    whole = {i: [*encode(t or ""), 2] for i, t in enumerate(texts)}
    seen = {i: [] for i in whole}
    for x in packing.sequences(docs(spark, texts), limit=256).collect():
        assert len(x.ids) <= 256
        for key, a, b in zip(x.doc_ids, x.starts, [*x.starts[1:], len(x.ids)]):
            seen[key].append(x.ids[a:b])
    for i, parts in seen.items():
        assert sorted(n for p in parts for n in p) == sorted(whole[i])


def test_copies_of_one_document(spark):
    got = packing.pack(packing.numbered(packing.pieces_of(docs(spark, ["a b c"] * 900).selectExpr("1L as doc_id", "text"))), 1024, 100).collect()
    assert check(got, wanted_of([(1, "a b c")] * 900, 1024), 1024) == packing.least_sequences(np.array([x.length for x in got]))


def test_empty(spark):
    assert packing.pack(packing.numbered(packing.pieces_of(docs(spark, [])))).count() == 0


def test_small_multisets_never_beat_the_bound():
    for size in (1, 2, 3, 4):
        for lengths in combinations_with_replacement((1, 3, 4, 5, 7, 8), size):
            assert packing.least_sequences(np.array(lengths), 8) <= optimum(sorted(lengths, reverse=True), 8)


