"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the contracts: space and U+0009 to U+000D. ``bytes.split()`` splits on just these.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Checkpoints after which shuffle files that nothing refers to any more are released.
RELEASE_EVERY = 4
_calls: list[None] = []
#: Spark's bound of an Arrow batch, and what is asked for here.
BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Characters that one step of a Python operator holds in arrays.
STEP_CHARS = 1_500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one is chosen only where none is set and all tasks run in this machine's driver."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "/tmp/webassay-checkpoints"
        spark.sparkContext.setCheckpointDir(held)
    return held


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    _calls.append(None)
    if len(_calls) >= RELEASE_EVERY:
        # Shuffle files go once the driver has collected what refers to them; iterations would pile them up.
        _calls.clear()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def forget(*done: DataFrame) -> None:
    """Delete the files of checkpoints that nothing will read again; what is no checkpoint is left alone."""
    for df in done:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 by 3. A null id is a training row."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


#: Rows of a few numbers that may be broadcast once they are counted.
SMALL_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a table of short rows if a count shows that it is small; else the planner's own join."""
    return F.broadcast(df) if df.count() <= rows else df


def spans_of(lengths: list[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows that hold about ``most`` characters together (one row at least)."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def lengths_of(values: pa.Array) -> list[int]:
    """Characters of texts, bytes, or items of lists; 0 for nulls."""
    kind = values.type
    count = pc.list_value_length if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pc.binary_length if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else pc.utf8_length
    return pc.fill_null(count(values), 0).to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most, where the session has Spark's own bound: texts would fill eight times as much on either side."""
    if spark.conf.get(BATCHES, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(BATCHES, BATCH_BYTES)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str | StructType, text: str | None = "text", final: Callable[[], Callable] | None = None, most: int = STEP_CHARS) -> DataFrame:
    """Run ``fn`` over column lists, a bounded number of characters at a time.

    ``fn(columns)`` gets a dict of lists and returns a dict of lists (or None)
    with the columns of ``schema``. With ``final``, ``fn`` is replaced by what
    ``final()`` returns: a pair (step, end) made afresh for each partition,
    whose ``end()`` returns the last rows of the partition.
    """
    bound_batches(df.sparkSession)
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    names = struct.names

    def run(batches):
        step, end = final() if final else (fn, None)
        for batch in batches:
            # Only the rows of a step become Python objects.
            for a, b in spans_of(lengths_of(batch.column(text)), most) if text else [(0, batch.num_rows)]:
                out = step({name: batch.column(i).slice(a, b - a).to_pylist() for i, name in enumerate(batch.schema.names)})
                if out is not None and len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[k], type=arrow.field(k).type) for k in names], schema=arrow)
        if end:
            for out in end():
                if len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[k], type=arrow.field(k).type) for k in names], schema=arrow)

    return df.mapInArrow(run, struct)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    Alternating large-star and small-star steps: each only joins and groups
    on node ids, in a number of rounds that grows with the logarithm of the
    path length. A node of high degree is never gathered: minima are
    aggregated with partial sums and joins are left to the adaptive planner.
    """
    work = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    work = checkpoint(work.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    # Done once every node has one lower neighbour, or only higher ones: then each component is a star around its least node.
    ends = lambda: F.explode(F.array(F.struct(F.col("v").alias("w"), F.lit(1).alias("lower")), F.struct(F.col("u").alias("w"), F.lit(0).alias("lower"))))
    while not work.select(ends().alias("x")).groupBy("x.w").agg(F.sum("x.lower").alias("lower"), F.count("*").alias("n")).where("lower > 0 and n > 1").isEmpty():
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above u are tied to the least of u and its neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's lower neighbours, and itself, are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, work = work, checkpoint(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        forget(before)
    ends = work.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return ends.unionByName(work.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct().join(ends.select("node"), "node", "left_anti"))
