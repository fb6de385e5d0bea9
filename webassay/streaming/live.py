"""Live figures of a running crawl, hooks for each batch, and its end by request or by time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n): running counts, for the complete output mode."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def first_landed(pages: DataFrame, late: str) -> DataFrame:
    """Pages (final_url, at, ...) of a stream, the first of each address within the watermark."""
    return pages.withWatermark("at", late).dropDuplicatesWithinWatermark(["final_url"])


def run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, should_stop: Callable[[], bool] = lambda: False, budget: float | None = None, every: float = 0.2) -> str:
    """Feed batches to ``on_batch`` until the stream has no more, ``should_stop`` says so or ``budget`` seconds are over; why it ended."""
    query: StreamingQuery = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    began = time.monotonic()
    try:
        while query.isActive:
            if should_stop():
                return "stopped"
            if budget is not None and time.monotonic() - began > budget:
                return "out of time"
            query.awaitTermination(every)
        if query.exception() is not None:
            raise query.exception()
        return "done"
    finally:
        query.stop()
