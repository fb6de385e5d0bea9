"""Conversation repair: every edit script by exhaustive search, SQL on a small table, long conversations over many segments, odd rows."""

import hashlib
import os
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from webassay.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def ordered_rows(rows):
    """Rows of one conversation after damage, in order, with faults."""
    keyed = [(t, "" if r is None else r, x) for t, r, x in rows]
    keyed.sort(key=lambda y: (y[0] is not None, y[0] or 0, hashlib.sha256(f"{y[1]}:{y[2]}".encode()).hexdigest(), y[1]))
    out, seen = [], set()
    for turn, role, text in keyed:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit) by trying every edit script without more than two inserts in a row."""
    good = re.compile(r"(s?(ua)+)?\Z")

    @cache
    def best(i, done, inserted):
        found = []
        if i == len(rows) and good.match(done):
            found.append((0, ""))
        if inserted < 2:
            found += [(c + 5, "I" + a) for r in "ua" for c, a in best(i, shorter(done + r), inserted + 1)[:1] if c < 10**9]
        if i < len(rows):
            _, role, _, fault = rows[i]
            found += [(c + 2, "D" + a) for c, a in best(i + 1, done, 0)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role:
                    found += [(c + extra, "K" + a) for c, a in best(i + 1, shorter(done + role[0]), 0)]
                found += [(c + 1 + extra, "R" + a) for r in "ua" for c, a in best(i + 1, shorter(done + r), 0)]
        return [min(found)] if found else [(10**9, "")]

    def shorter(done):
        """Only what decides about the rest is kept; what can't be made good is one word."""
        if done in ("", "s", "u", "su"):
            return done
        if not re.match(r"s?(ua)*u?\Z", done):
            return "x"
        return "u" if done.endswith("u") else "ua"

    return best(0, "", 0)[0]


def repaired(rows, audit):
    out, i = [], 0
    odd = sum(c != "D" for c in audit) % 2
    for c in audit:
        if c != "I":
            _, role, text, _ = rows[i]
            i += 1
        if c == "D":
            continue
        name = role if c == "K" else ("user", "assistant")[(len(out) - odd) % 2]
        out.append(f"{name}:{'' if c == 'I' else text}")
    return out


def expected(rows):
    """What a conversation's rows after damage (turn, role, text) give."""
    rows = ordered_rows(rows)
    faults = [f for *_, f in rows]
    known = [t for t, *_ in rows if t is not None]
    cost, audit = cheapest(tuple(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(faults.count(f) for f in turns.FAULTS), illegal, cost, audit), repaired(rows, audit)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def some_rows(seed, conversations, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut off", " \n", "", None, "a. b ", "É.\t", "x.y"]
    rows = []
    for c in range(conversations):
        for t in range(r.randint(0, most)):
            rows.append((c if c else None, r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "User"]), r.choice(texts)))
    return rows


def test_every_edit_script(spark):
    rows = [x for x in some_rows(1, 60, 7)]
    fed = {}
    for c, t, role, text in rows:
        fed.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cost", turns.F.lit("clash"))
    for chunk, fan in ((256, 256), (2, 512)):  # whole conversations, and pieces of two rows
        ordered = turns.in_order(df, chunk)
        got = {x.conv_id: tuple(x)[1:] for x in turns.judged(ordered, fan).collect()}
        assert got == {c: expected(x)[0] for c, x in fed.items()}
        shas = {x.conv_id: x.repaired_sha256 for x in turns.digests(ordered, turns.judged(ordered, fan)).collect()}
        assert shas == {c: hashlib.sha256("\n".join(expected(x)[1]).encode()).hexdigest() for c, x in fed.items()}
    lines = {}
    for x in sorted(turns.repair(df, 4).collect(), key=lambda x: x.n):
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert lines == {c: expected(x)[1] for c, x in fed.items() if expected(x)[1]}


def as_tables(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")


def test_query_against_scripts_and_sql(spark, tmp_path):
    """Damage and repair; every original conversation is there; SQL gives the same rows."""
    rows = [(c, t, role, f"t{c} {t}." if t % 3 else text) for c, (_, t, role, text) in enumerate(some_rows(2, 90, 6)) if t is not None]
    rows = [(c // 4, t, role, text) for c, t, role, text in rows] + [(None, 1, "user", "Hi."), (None, None, None, None), (-5, 2, "user", "only"), *[(77_000 + i, 0, "user", "Hi.") for i in range(40)]]
    gone = next(c for c in range(10**6, 10**7) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    as_tables(spark, rows, tmp_path)
    got = sorted(map(tuple, turns.query(spark, str(tmp_path)).collect()), key=str)
    fed = {}
    for c, t, role, text in damage(rows):
        fed.setdefault(c, []).append((t, role, text))
    want = []
    for c in {x[0] for x in rows}:
        values, lines = expected(fed.get(c, []))
        want.append((c, *values, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    assert got == sorted(want, key=str) and (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    duck = duckdb.connect()
    duck.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(duck.execute(turns.SQL).fetchall(), key=str) == got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_query_against_sql_on_the_table(spark):
    duck = duckdb.connect()
    duck.execute("create view conversations as from '/root/testdata/sf0.01/conversations.parquet'")
    got = sorted(map(tuple, turns.query(spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(duck.execute(turns.SQL).fetchall()) and len(got) >= 100


def plain_fold(rows):
    """(cost, audit) of one long conversation, row by row."""
    never = (10**15, "")
    e, s, u, a = (0, ""), never, never, never
    more = lambda p, c, x: (p[0] + c, p[1] + x)
    for _, role, _, fault in rows:
        v, w = min(u, *(more(p, 5, "I") for p in (e, s, a))), min(a, more(u, 5, "I"))
        to_u, to_a, to_s = [more(v, 2, "D")], [more(w, 2, "D")], [more(s, 2, "D")]
        if fault not in ("blank", "duplicate"):
            x, c = 5 * (fault == "truncated"), role[:1]
            to_u.append(more(min(e, s, w), x + (c != "u"), "K" if c == "u" else "R"))
            to_a.append(more(v, x + (c != "a"), "K" if c == "a" else "R"))
            if c == "s":
                to_s.append(more(e, x, "K"))
        e, s, u, a = more(e, 2, "D"), min(to_s), min(to_u), min(to_a)
    return min(e, a, more(u, 5, "I"))


def test_one_conversation_with_most_rows(spark):
    """A conversation over many segments and range partitions beside short ones, with repeats far apart and a very long text."""
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "tool"]), r.choice([f"n{t}.", f"m{t % 40}.", "same.", "open"])) for t in range(2500)]
    rows += [(8, t, ("user", "assistant")[t % 2], "word " * 60_000 + f"{t}.") for t in range(4)] + [(9, 1, "user", "Copy.")] * 600
    ordered = turns.in_order(spark.createDataFrame(rows, SCHEMA).repartition(5), 16)
    assert ordered.select("seg").distinct().count() > 150
    found = turns.judged(ordered, 64)
    got = {x.conv_id: tuple(x)[1:] for x in found.collect()}
    shas = {x.conv_id: x.repaired_sha256 for x in turns.digests(ordered, found).collect()}
    for c in (7, 8, 9):
        own = ordered_rows([x[1:] for x in rows if x[0] == c])
        cost, audit = plain_fold(own)
        faults = [x[3] for x in own]
        assert got[c][1:4] == tuple(faults.count(f) for f in turns.FAULTS) and got[c][5:] == (cost, audit) and got[c][0] == 0
        assert got[c][4] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        assert shas[c] == hashlib.sha256("\n".join(repaired(own, audit)).encode()).hexdigest()


def test_empty(spark, tmp_path):
    as_tables(spark, [], tmp_path)
    assert turns.query(spark, str(tmp_path)).count() == 0
