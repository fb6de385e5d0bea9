"""Mixing of sources to target weights by pivotal dependent rounding.

Each source has a target number of words. Its ratio target / size is split
into whole copies that every document gets and a fraction, which is each
document's probability of one copy more. Pivotal rounding turns these
probabilities into decisions: two documents meet, mass moves from one to the
other at random so that one of them becomes 0 or 1, and the other goes on to
meet the next. What moves is words, so a source's expected words are kept
exactly until one residual is left, which is rounded to the nearer side; long
documents meet first, so that the residual is mostly a short one. Buckets of a
source are rounded apart; their residuals meet in a tree whose nodes join FAN
residuals, level by level.

Nulls and edges: a null text has size 0. A null source is a source and comes
last. Rows alike in doc_id, source and size are one unit and share a decision.
Sources without words have target 0 and their documents are not taken. Documents
of one size meet in the order of their ids. Other columns are passed on by
``mix`` whatever their names. An empty table gives an empty result. Random numbers are hashes of the doc_id and
the level, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webassay.llm import common

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Documents in a bucket, about, and residuals that meet in a node of the tree.
BUCKET, FAN = 1000, 64


def targets(sized: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, units, source_size, target) from (source, size): one row per source.

    Targets are ``share`` of all sizes dealt by weight; no target is above
    ``most`` times its source's size, and what is over is dealt anew. That is
    the level L with sum(min(most * size, L * weight)) = share * sum(size):
    with sources in the order of most * size / weight, those before the first
    whose cap is above the level are capped. One row per source is sorted;
    documents are only summed.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    w = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (((F.row_number().over(w) - 1) % len(weights)) + 1).cast("int"))
    ranked = by_source.select("*", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole, before = W.partitionBy(), W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    step = ranked.select("*", F.sum("weight").over(whole).alias("w_all"), (F.sum("source_size").over(whole) * F.lit(share)).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("w_capped"))
    level = step.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("w_all") - F.col("w_capped")))
    found = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(whole)["level"])
    return found.select("source", "units", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def meet(ids: np.ndarray, size: np.ndarray, p: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """Sequential pivotal rounding of words: decisions (0, 1 or, for the last one left, its probability) and its place or -1.

    Words move from one document to the other until either is 0 or 1. The two
    directions are drawn so that each document's expectation stays as it was.
    """
    u = (common.mix64(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) >> np.uint64(11)).astype(float) / 2**53
    out, left, mine, held = np.zeros(len(ids)), -1, 0.0, 0.0
    for i, (q, z, r) in enumerate(zip(p.tolist(), size.tolist(), u.tolist())):
        if left < 0:
            left, mine, held = i, q, z
            continue
        up, down = min((1 - mine) * held, q * z), min(mine * held, (1 - q) * z)
        moved = up if r * (up + down) < down else -down
        mine, q = mine + moved / held, q - moved / z
        if mine < 1e-9 or mine > 1 - 1e-9:
            out[left], left, mine, held = round(mine), i, q, z
            if q < 1e-9 or q > 1 - 1e-9:
                out[i], left = round(q), -1
        else:
            out[i] = round(q)
    if left >= 0:
        out[left] = mine
    return out, left


UNIT = "doc_id long, source string, size long, rows long, source_size long, target double, whole int, p double, bucket long, open boolean"


def rounder(level: int, last: bool):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "doc_id"], ascending=False, kind="stable", na_position="last").reset_index(drop=True)
        ids = df["doc_id"].fillna(-1).astype("int64").to_numpy()
        p, left = meet(ids, np.maximum(df["size"], 1).to_numpy(float) * df["rows"].to_numpy(float), df["p"].to_numpy(), level)
        if last and left >= 0:
            p[left], left = float(p[left] >= 0.5), -1
        return df.assign(p=p, bucket=df["bucket"] // FAN, open=np.arange(len(df)) == left)

    return run


def decide(sized: DataFrame) -> DataFrame:
    """Copies of each unit (doc_id, source, size): also rows, source_size, target, copies."""
    goal = targets(sized)
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-9).cast("int")
    salted = F.expr(f"pmod(xxhash64(doc_id, size), ceil(units / {BUCKET}))")
    ready = units.withColumnRenamed("source", "s").join(goal, F.expr("s <=> source")).drop("s").select("doc_id", "source", "size", "rows", "source_size", "target", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"), salted.alias("bucket"), F.lit(True).alias("open"))
    ready = common.checkpoint(ready)
    buckets = (ready.agg(F.max("bucket")).first()[0] or 0) + 1
    done, level, pending = ready.where("p <= 1e-9").withColumn("p", F.lit(0.0)), 0, ready.where("p > 1e-9")
    while True:
        last = buckets <= 1
        out = common.checkpoint(pending.groupBy("source", "bucket").applyInPandas(rounder(level, last), UNIT))
        done = done.unionByName(out.where("not open"))
        if last:
            break
        pending, level, buckets = out.where("open"), level + 1, -(-buckets // FAN)
    return done.select("doc_id", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """The rows of ``docs`` (with text, source, doc_id), each as often as the mix takes it."""
    sized = docs.withColumn("__size", common.n_words(F.col("text")) if size is None else size)
    taken = decide(sized.select("doc_id", "source", F.col("__size").alias("size"))).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").alias("__copies"))
    return sized.join(taken.where("__copies > 0"), F.expr("doc_id <=> __d and source <=> __s and __size = __z")).withColumn("__copy", F.expr("explode(sequence(1, __copies))")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    sized = common.checkpoint(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size")))
    taken = decide(sized).withColumn("row", F.expr("explode(sequence(1L, rows))"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
