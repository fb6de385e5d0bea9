"""Hard negatives: plain loops over all pairs, SQL, bounds that hold, copies of one vector, odd rows."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webassay.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The result by loops over all pairs."""
    held = {}
    for key, x, label in rows:
        if key is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x])
        held[key] = max(held.get(key, (label, row[1], row)), (label, row[1], row))
    held = {k: v[2] for k, v in held.items()}
    out = []
    for a, (label, q) in held.items():
        if a % 50:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(q, p)), k) for k, (_, p) in held.items() if k != a))
        for s, k in [(s, k) for s, k in scores if held[k][0] == label][:5]:
            hard = [(t, n) for t, n in scores if held[n][0] != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, k, i + 1, n, -s, -t) for i, (t, n) in enumerate(hard)]
    return sorted(out)


def made(seed, n, dims, labels, near=0.3, ids=None):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dims))
    x = near * r.normal(size=(n, dims)) + centres[r.integers(0, 4, n)] * 0.3
    return [(int(ids[i]) if ids else i, [float(v) for v in row], int(r.integers(0, labels))) for i, row in enumerate(x)]


def got_of(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(map(tuple, vafile.query(spark, str(folder)).collect()))


def by_sql(folder):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as from '{folder}/embeddings.parquet/*.parquet'" if os.path.isdir(f"{folder}/embeddings.parquet") else f"create view embeddings as from '{folder}/embeddings.parquet'")
    return sorted(duck.execute(vafile.SQL).fetchall())


ODD_ROWS = [(50, [1.0] * 6, 3), (50, [1.0] * 6, 4), (100, [0.5] * 6, 4), (100, [0.5] * 6, 4), (None, [1.0] * 6, 1), (5001, None, 1), (5002, [None, 1.0], 1), (5003, [float("nan")], 1), (5004, [float("inf")], 1), (5005, [1.0], None), (5006, [], 1), (5007, [0.25, 0.5], 4), (-50, [0.1] * 6, 7), (-49, [0.1] * 6, 7)]


def test_against_loops_and_sql(spark, tmp_path):
    rows = [x for x in made(1, 700, 6, 10) if x[0] not in (50, 100)] + ODD_ROWS
    got = got_of(spark, rows, tmp_path)
    assert got == plain(rows) == by_sql(tmp_path) and len(got) > 100


def test_small_tiles_and_ties(spark, tmp_path, monkeypatch):
    """Many blocks, slices and steps; whole numbers so small that most scores tie."""
    for k, v in (("BLOCK", 60), ("SLICE", 3), ("STEP_ROWS", 16), ("STEP_ANCHORS", 2), ("STEP_PAIRS", 20), ("LEAST_BLOCK", 60)):
        monkeypatch.setattr(vafile, k, v)
    r = random.Random(3)
    rows = [(i, [r.randint(0, 2) / 256 for _ in range(3)], r.randint(0, 3)) for i in range(500)]
    assert got_of(spark, rows, tmp_path) == plain(rows)


def test_one_vector_of_most_rows(spark, tmp_path):
    """A third of all rows, anchors too, share one vector and label; the searches see a few of them."""
    rows = made(5, 400, 8, 3) + [(1000 + i, [0.3] * 8, 1) for i in range(300)]
    assert got_of(spark, rows, tmp_path) == plain(rows)
    q = [76] * 8
    some = spark.createDataFrame([(i, 1, q) for i in range(400)], "vec_id long, label long, q array<long>")
    rank = F.row_number().over(vafile.W.partitionBy("label", "q").orderBy("vec_id"))
    plan = some.withColumn("rank", rank).where(F.col("rank") <= vafile.KEEP)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bounds_hold():
    r = np.random.default_rng(2)
    q = r.integers(-90, 90, (300, 5))
    edges = np.sort(r.choice(np.arange(-90, 90), (5, 7), replace=False), axis=1).astype(float)
    low, high = np.c_[q.min(0), edges + 1], np.c_[edges, q.max(0)]
    high = np.maximum(low, high)
    codes = np.stack([np.searchsorted(edges[d], q[:, d]) for d in range(5)], axis=1).astype(np.uint8)
    tile = vafile.Tile(np.arange(300).tobytes(), np.zeros(300, np.int64).tobytes(), q.astype("<i4").tobytes(), codes.tobytes(), (edges, low + high, high - low, 90))
    anchors = r.integers(-90, 90, (20, 5)).astype(tile.kind)
    lower, upper = tile.bounds(anchors, np.arange(300))
    exact = anchors.astype(int) @ q.T
    assert (lower <= 2 * exact).all() and (2 * exact <= upper).all() and (lower < upper).any()
    some = vafile.same_label(tile, np.zeros(20, np.int64), anchors)
    assert len(some.key) == 20 * vafile.KEEP


def test_only_candidates_are_scored(spark):
    """Most rows are ruled out by their approximations."""
    rows = made(8, 3000, 16, 2)
    vectors = vafile.whole(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "label", "q")
    table = vafile.cells(vectors, 16)
    held = vectors.collect()
    q = np.array([x.q for x in held])
    codes = np.stack([np.searchsorted(table[0][d], q[:, d]) for d in range(16)], axis=1).astype(np.uint8)
    tile = vafile.Tile(np.array([x.vec_id for x in held]).tobytes(), np.array([x.label for x in held]).tobytes(), q.astype("<i4").tobytes(), codes.tobytes(), table)
    seen = []
    exact = tile.exact
    tile.exact = lambda a, one, r: (seen.append(len(r)), exact(a, one, r))[1]
    vafile.same_label(tile, tile.labels[:50], q[:50].astype(tile.kind))
    assert sum(seen) < 0.1 * 50 * 1500


def test_too_large_components(spark, tmp_path):
    with pytest.raises(ArithmeticError):
        got_of(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], tmp_path)


def test_empty(spark, tmp_path):
    assert got_of(spark, [], tmp_path) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_on_the_table(spark):
    got = sorted(map(tuple, vafile.query(spark, "/root/testdata/sf0.01").collect()))
    assert got == by_sql("/root/testdata/sf0.01") and got
