"""Hard negatives by a vector-approximation file.

Components are whole numbers. Each dimension is quantised into CELLS cells
whose edges are quantiles of all rows, so a row's approximation is one byte a
dimension. A table of the cells' middles and widths turns approximations into
bounds of inner products: twice a score lies within a.middle -+ |a|.width,
looked up once for a block and then taken with all anchors. Only candidates
whose upper bound may still enter a window are scored exactly, with whole
numbers, so results are exact.

A window is, first, an anchor's best rows of its label, and then, for each of
its positive scores p, the best rows of other labels from p/2 to 0.95 p. Rows
are dealt to blocks and anchors to slices; a tile compares one block with one
slice and hands on no more than a window holds, so what is shuffled doesn't depend
on how many rows tie or lie close together. Of rows alike in label and vector only the
first KEEP ids can enter any window, and anchors alike in both share one
search; a vector that a third of all rows have is so compared a few times.

Nulls and edges: rows with a null label or vector, or with a component that is
null or not finite, take no part, nor do rows without vec_id. Rows that share a
vec_id count as one, the one with the greatest label, then vector. Where
vectors differ in length, missing components are 0. Anchors without other rows
of their label have no result, nor have positives without a row in their
window; scores below 0 have empty windows. Where components are so large that
scores could reach 2**51, an error is raised. Other columns aren't looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webassay.llm import common

SCALE, ANCHORS, MOVED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score between which a hard negative lies.
LOWEST, HIGHEST = 50, 95
CELLS = 64
#: Rows in a block and anchors in a slice at most, about, and rows below which a block isn't split for more tasks.
BLOCK, SLICE, LEAST_BLOCK = 32_768, 4_096, 2_048
#: Rows and anchors that are compared in one step of a tile.
STEP_ROWS, STEP_ANCHORS = 8_192, 256
#: Pairs that are scored exactly together.
STEP_PAIRS = 100_000
#: Of rows with one label and vector: an anchor itself and its positives.
KEEP = POSITIVES + 1


def whole(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (array<long>) of the rows of (vec_id, label, embedding) that take part, one for each vec_id."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    named = rows.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null").where(~F.exists("embedding", bad))
    out = named.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))
    twice = common.checkpoint(rows.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id"))
    if twice.isEmpty():
        return out
    twice = common.sized(twice)
    one = out.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.max(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q")
    return out.join(twice, "vec_id", "left_anti").unionByName(one)


def cells(vectors: DataFrame, dims: int, n: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(inner edges, twice the middle, twice the half width by dimension and cell; the largest component's size). One row for each dimension reaches the driver.

    A cell holds the numbers above the edge before it up to its own edge; the outer ones end at the least and the greatest number.
    """
    cuts = [i / n for i in range(1, n)]
    found = vectors.select(F.posexplode("q").alias("dim", "x")).groupBy("dim").agg(F.percentile_approx("x", cuts, 1000).alias("cuts"), F.min("x").alias("least"), F.max("x").alias("most")).orderBy("dim").collect()
    edges, low, high = np.zeros((dims, n - 1)), np.zeros((dims, n)), np.zeros((dims, n))
    for x in found:
        edges[x.dim] = x.cuts
        low[x.dim], high[x.dim] = np.r_[x.least, edges[x.dim] + 1], np.r_[edges[x.dim], x.most]
    high = np.maximum(low, high)  # cells between equal edges are empty
    return edges, low + high, high - low, max((max(abs(x.least), abs(x.most)) for x in found), default=0)


def packed(df: DataFrame, group: str, numbers: list[str], edges: np.ndarray | None = None) -> DataFrame:
    """One row for each value of ``group``, which are of bounded size: columns of whole numbers and vectors (q) as bytes, sorted by the numbers; with ``edges`` also the approximations (codes), a byte a dimension."""
    kinds = {group: pa.int64(), **dict.fromkeys([*numbers, "q"], pa.binary()), **({} if edges is None else {"codes": pa.binary()})}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in numbers]).combine_chunks()
        vectors = table["q"].chunk(0).flatten().to_numpy().astype("<i4")
        row = {group: [table[group][0].as_py()], "q": [vectors.tobytes()], **{k: [table[k].to_numpy().astype("<i8").tobytes()] for k in numbers}}
        if edges is not None:
            by_dim = vectors.reshape(len(table), len(edges)).T
            row["codes"] = [np.stack([np.searchsorted(e, x) for e, x in zip(edges, by_dim)], axis=1).astype(np.uint8).tobytes()]
        return pa.table({k: row[k] for k in kinds}, schema=pa.schema(kinds.items()))

    return df.select(group, *numbers, "q").groupBy(group).applyInArrow(run, ", ".join(f"{k} {'long' if k == group else 'binary'}" for k in kinds))


def dealt(df: DataFrame, key: str, name: str, rows: int, most: int, tasks: int) -> tuple[DataFrame, int]:
    """``df`` with ``name``, a number dealt by a hash of ``key`` such that about ``most`` rows share one, and how many numbers there are."""
    n = max(1, ceil(rows / most), min(tasks, ceil(rows / LEAST_BLOCK)))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n))), n


class Tile:
    """A block of rows: ids, labels, approximations, and the vectors of those that they can't rule out."""

    def __init__(self, ids: bytes, labels: bytes, q: bytes, codes: bytes, table: tuple):
        _, middle, width, most = table
        # Sums of whole numbers below 2**24 are exact in either kind.
        self.kind = np.float32 if 4 * len(middle) * max(1, most) ** 2 < 2**24 else np.float64
        self.ids, self.labels, shape = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), (-1, len(middle))
        self.vectors, self.codes = np.frombuffer(q, "<i4").reshape(shape), np.frombuffer(codes, np.uint8).reshape(shape)
        self.middle, self.width, self.all = middle.astype(self.kind), width.astype(self.kind), np.arange(len(middle))

    def bounds(self, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the lower and upper bounds of scores of ``anchors`` with ``rows`` (numbers of rows)."""
        codes = self.codes[rows]
        middle = anchors @ self.middle[self.all, codes].T
        width = np.abs(anchors) @ self.width[self.all, codes].T
        return middle - width, middle + width

    def exact(self, anchors: np.ndarray, one: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of pairs: numbers of anchors and of rows."""
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), STEP_PAIRS):
            now = slice(i, i + STEP_PAIRS)
            out[now] = np.einsum("ij,ij->i", anchors[one[now]], self.vectors[rows[now]].astype(self.kind))
        return out


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf, values.dtype)


def best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the first k of each key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    sorted_ = key[order]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_)) + 1] if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


class Found:
    """The best of each window so far: (window, score, id)."""

    def __init__(self, k: int):
        self.k, self.key, self.score, self.ids = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.r_[self.key, key], np.r_[self.score, score], np.r_[self.ids, ids]
        keep = best(key, score, ids, self.k)
        self.key, self.score, self.ids = key[keep], score[keep], ids[keep]


def steps(numbers: np.ndarray, size: int):
    return (numbers[i : i + size] for i in range(0, len(numbers), size))


def same_label(tile: Tile, labels: np.ndarray, anchors: np.ndarray, k: int = KEEP) -> Found:
    """The best k rows of each anchor's label; windows are numbers of anchors."""
    found = Found(k)
    for label in np.intersect1d(labels, tile.labels):
        for some in steps(np.flatnonzero(labels == label), STEP_ANCHORS):
            for rows in steps(np.flatnonzero(tile.labels == label), STEP_ROWS):
                lower, upper = tile.bounds(anchors[some], rows)
                a, r = np.nonzero(upper >= kth(lower, k)[:, None])
                found.add(some[a], tile.exact(anchors, some[a], rows[r]), tile.ids[rows[r]])
    return found


def in_windows(tile: Tile, labels: np.ndarray, anchors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int = NEGATIVES) -> Found:
    """The best k rows of other labels of each window: its anchor (``owner``, in order) and the scores from ``low`` to ``high``."""
    found, waiting = Found(k), []

    def score() -> None:
        """Score what waits, all at once."""
        if waiting:
            w = np.repeat([w for w, _ in waiting], [len(r) for _, r in waiting])
            rows = np.concatenate([r for _, r in waiting])
            scores = tile.exact(anchors, owner[w], rows)
            inside = (scores >= low[w]) & (scores <= high[w])
            found.add(w[inside], scores[inside], tile.ids[rows[inside]])
            waiting.clear()

    for label in np.unique(labels):
        others = np.flatnonzero(tile.labels != label)
        for some in steps(np.flatnonzero(labels == label), STEP_ANCHORS):
            own = np.flatnonzero(np.isin(owner, some))
            place = np.searchsorted(some, owner[own])
            for rows in steps(others, STEP_ROWS):
                lower, upper = tile.bounds(anchors[some], rows)
                held = 0
                for w, at in zip(own.tolist(), place.tolist()):
                    r = np.flatnonzero(upper[at] >= 2 * low[w])
                    down, up = lower[at, r], upper[at, r]
                    sure = down[(down >= 2 * low[w]) & (up <= 2 * high[w])]
                    # With k rows inside for certain, what can't reach the least of them has no place.
                    least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
                    r = rows[r[(down <= 2 * high[w]) & (up >= least)]]
                    if len(r):
                        waiting.append((w, r))
                        held += len(r)
                    if held > STEP_PAIRS:
                        score()
                        held = 0
                score()
    return found


def searched(blocks: DataFrame, n_blocks: int, slices: DataFrame, table: tuple, windows: bool) -> DataFrame:
    """key, p, score, vec_id: what each tile finds. ``slices``: keys, labels, q and, with ``windows``, scores (of positives), as many as ``owner`` (numbers of anchors)."""
    tiles = slices.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).withColumnsRenamed({"label": "labels", "q": "vectors"}).join(blocks, "block")

    def step(c):
        out = {"key": [], "p": [], "score": [], "vec_id": []}
        for i in range(len(c["block"])):
            tile = Tile(c["vec_id"][i], c["label"][i], c["q"][i], c["codes"][i], table)
            keys, labels = np.frombuffer(c["key"][i], "<i8"), np.frombuffer(c["labels"][i], "<i8")
            anchors = np.frombuffer(c["vectors"][i], "<i4").reshape(len(keys), -1).astype(tile.kind)
            if windows:
                p = np.frombuffer(c["p"][i], "<i8")
                # One row for each anchor and positive score: neighbours of one key share an anchor.
                first = np.r_[True, keys[1:] != keys[:-1]]
                owner = np.cumsum(first) - 1
                found = in_windows(tile, labels[first], anchors[first], owner, -(-LOWEST * p // 100), HIGHEST * p // 100)
                out["p"] += p[found.key].tolist()
            else:
                found = same_label(tile, labels, anchors)
                out["p"] += [0] * len(found.key)
            for k, v in (("key", keys[found.key]), ("score", found.score), ("vec_id", found.ids)):
                out[k] += v.tolist()
        return out

    return common.map_rows(tiles, step, "key long, p long, score long, vec_id long", text=None)


def firsts(found: DataFrame, k: int) -> DataFrame:
    """key, p, best: the first k (score, vec_id) of each window, in order."""
    rank = F.row_number().over(W.partitionBy("key", "p").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("key", "p").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("best"))


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, q)."""
    spark = vectors.sparkSession
    rows = common.checkpoint(vectors)
    dims = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0] or 1
    rows = rows.select("vec_id", "label", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("q"))).alias("q")).withColumn("h", F.xxhash64("q"))
    table = cells(rows, dims)
    if 4 * dims * table[-1] ** 2 >= 2**53:
        raise ArithmeticError("components are too large for exact scores")
    # Spark keeps the first few of each group before the exchange too, so a vector of very many rows isn't gathered.
    rank = F.row_number().over(W.partitionBy("label", "h", "q").orderBy("vec_id"))
    some = common.checkpoint(rows.withColumn("rank", rank).where(F.col("rank") <= KEEP).select("vec_id", "label", "q"))
    chosen = rows.where(is_anchor)
    kinds = common.checkpoint(chosen.groupBy("label", "h", "q").agg(F.min("vec_id").alias("key")))
    tasks = 2 * spark.sparkContext.defaultParallelism
    placed, n_blocks = dealt(some, "vec_id", "block", some.count(), BLOCK, tasks)
    blocks = common.checkpoint(packed(placed, "block", ["vec_id", "label"], table[0]))
    sliced, _ = dealt(kinds.select("key", "label", "q"), "key", "slice", kinds.count(), SLICE, 1)
    same = searched(blocks, n_blocks, packed(sliced, "slice", ["key", "label"]), table, False)
    positives = common.checkpoint(firsts(same, KEEP).select("key", "best"))
    members = chosen.select(F.col("vec_id").alias("anchor_id"), "label", "h", "q").join(kinds, ["label", "h", "q"]).select("anchor_id", "key")
    held = members.join(common.sized(positives), "key").withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("anchor_id")), 1, POSITIVES))
    pairs = common.checkpoint(held.select("key", "anchor_id", F.explode("best").alias("x")).select("key", "anchor_id", F.col("x.vec_id").alias("positive_id"), F.col("x.score").alias("p")))
    scores = pairs.where("p >= 0").select("key", "p").distinct()
    near = searched(blocks, n_blocks, packed(sliced.join(scores, "key"), "slice", ["key", "p", "label"]), table, True)
    negatives = firsts(near, NEGATIVES)
    out = pairs.join(common.sized(common.checkpoint(negatives)), ["key", "p"]).select("anchor_id", "positive_id", F.col("p").alias("positive_score"), F.explode("best").alias("x"))
    return out.select("anchor_id", "positive_id", F.col("x.rank").cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(common.read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % ANCHORS == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embeddings.label DESC, q DESC) = 1),
w AS (SELECT vec_id, label, list_resize(q, (SELECT max(len(q)) FROM v), 0) AS q FROM v),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, coalesce(list_inner_product(a.q, r.q), 0)::BIGINT AS score FROM w a JOIN w r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
