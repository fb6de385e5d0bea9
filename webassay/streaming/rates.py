"""Windowed request rates, sessions, and the pacing of hosts, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Pacing of a host.
BLOCK, ERROR, RECOVER, CAP, FLOOR, SLOW_MS, OK_RUN, KEPT, LEAST = 2.0, 1.5, 0.8, 30.0, 0.1, 3000.0, 5, 10, 5


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, users, total) per tumbling window; on a stream, ``late`` is the watermark."""
    source = events.withWatermark("ts", late) if late else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    rows = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "users", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, last, n) per run of events with smaller gaps."""
    source = events.withWatermark("ts", late) if late else events
    rows = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return rows.select("user_id", "start", "last", "n")


class Pace:
    """Delay and circuit breaker of one host; ``see`` takes the outcome of one request."""

    def __init__(self, base: float = 0.25, max_blocks: int = 5, state: tuple | None = None):
        self.base, self.max_blocks = base, max_blocks
        self.delay, self.blocks, self.errors, self.fine, self.tripped, self.latencies = state or (base, 0, 0, 0, False, [])

    def _wait(self, factor: float) -> None:
        self.delay = min(CAP, max(self.delay, self.base, FLOOR) * factor)

    def _slow(self) -> bool:
        """Whether the middle of the last answers, the upper one of two, took too long."""
        return len(self.latencies) >= LEAST and sorted(self.latencies)[len(self.latencies) // 2] > SLOW_MS

    def see(self, outcome: str, ttfb_ms: float | None) -> None:
        if outcome == "ok":
            self.blocks = self.errors = 0
            self.fine += 1
            if ttfb_ms is not None and ttfb_ms == ttfb_ms:  # a null comes as NaN
                self.latencies = [*self.latencies, float(ttfb_ms)][-KEPT:]
            if self._slow():
                self._wait(ERROR)
            elif self.fine >= OK_RUN and self.delay > self.base:
                self.delay, self.fine = max(self.base, self.delay * RECOVER), 0
            return
        self.fine = 0
        if outcome == "blocked":
            self.blocks += 1
            self._wait(BLOCK)
            self.tripped = self.tripped or self.blocks >= self.max_blocks
        else:
            self.errors += 1
            if self.errors > 1:
                self._wait(ERROR)

    def state(self) -> tuple:
        return (self.delay, self.blocks, self.errors, self.fine, self.tripped, list(self.latencies))


OUT = "host string, delay double, blocks int, errors int, tripped boolean, requests long"


def host_states(requests: DataFrame, base: float = 0.25, max_blocks: int = 5) -> DataFrame:
    """The state of each host after its requests (host, seq, outcome, ttfb_ms) in order.

    A chain of updates needs a host's requests in order. They pass through as
    sorted batches, and only the state of one host is held at a time.
    """
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        host, pace, n = None, None, 0
        row = lambda: (host, round(pace.delay, 6), pace.blocks, pace.errors, pace.tripped, n)
        for batch in batches:
            done = []
            for name, outcome, ttfb in batch[["host", "outcome", "ttfb_ms"]].itertuples(index=False):
                if pace is None or name != host:
                    if pace is not None:
                        done.append(row())
                    host, pace, n = name, Pace(base, max_blocks), 0
                pace.see(outcome, ttfb)
                n += 1
            if done:
                yield pd.DataFrame(done, columns=names)
        if pace is not None:
            yield pd.DataFrame([row()], columns=names)

    return requests.select("host", "seq", "outcome", "ttfb_ms").repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, OUT)


STREAMED = f"{OUT}, expired boolean"


class HostPacing(StatefulProcessor):
    """Pacing of hosts as keyed state: a value, the list of last latencies, and a timer that lets silent hosts go."""

    def __init__(self, base: float, max_blocks: int, idle_ms: int):
        self.base, self.max_blocks, self.idle_ms = base, max_blocks, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pace = handle.getValueState("pace", "delay double, blocks int, errors int, fine int, tripped boolean, requests long, last long")
        self.latencies = handle.getListState("latencies", "ttfb_ms double")

    def _held(self) -> tuple[Pace, int, int]:
        if not self.pace.exists():
            return Pace(self.base, self.max_blocks), 0, 0
        *state, n, last = self.pace.get()
        return Pace(self.base, self.max_blocks, (*state, [x[0] for x in self.latencies.get()])), n, last

    @staticmethod
    def _row(host: str, pace: Pace, n: int, expired: bool) -> Row:
        return Row(host=host, delay=round(pace.delay, 6), blocks=pace.blocks, errors=pace.errors, tripped=pace.tripped, requests=n, expired=expired)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pace, n, last = self._held()
        for row in sorted(rows, key=lambda r: r.seq):
            at = int(row.at.timestamp() * 1000)
            if n and at - last > self.idle_ms:  # the watermark lags behind: its timer hasn't gone off yet
                yield self._row(key[0], pace, n, True)
                pace, n, last = Pace(self.base, self.max_blocks), 0, 0
            pace.see(row.outcome, row.ttfb_ms)
            n, last = n + 1, max(last, at)
        *state, latencies = pace.state()
        self.pace.update((*state, n, last))
        self.latencies.clear()
        if latencies:
            self.latencies.put([(x,) for x in latencies])
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key[0], pace, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pace, n, _ = self._held()
        self.pace.clear()
        self.latencies.clear()
        yield self._row(key[0], pace, n, True)

    def close(self) -> None:
        pass


def stream_host_states(requests: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000, base: float = 0.25, max_blocks: int = 5) -> DataFrame:
    """The same on a stream of (host, seq, outcome, ttfb_ms, at): each micro-batch updates the hosts that it has requests of.

    A host that is silent for ``idle_ms`` of event time, as far as the
    watermark knows, has a last row with ``expired`` and starts anew when it
    comes back; so state grows with the hosts at work, not with all hosts ever
    seen. Within a micro-batch requests are taken in the order of seq.
    """
    rocksdb(requests.sparkSession)
    seen = requests.select("host", "seq", "outcome", "ttfb_ms", "at").withWatermark("at", late)
    return seen.groupBy("host").transformWithState(HostPacing(base, max_blocks, idle_ms), STREAMED, "update", "eventTime")


FRESHNESS = "url string, at timestamp, reuse boolean, etag string"


class Freshness(StatefulProcessor):
    """The last good answer of each address, kept as long as it lives: a timer forgets it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "etag string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        etag, until = self.answer.get() if self.answer.exists() else (None, None)
        before = until
        for row in sorted(rows, key=lambda r: r.at):
            at = int(row.at.timestamp() * 1000)
            reuse = until is not None and at <= until
            yield Row(url=key[0], at=row.at, reuse=reuse, etag=etag if reuse or until is not None else None)
            if not reuse and row.status is not None and 200 <= row.status < 300:
                etag, until = row.etag, at + self.ttl_ms
            elif not reuse and row.status == 304 and until is not None:  # unchanged: the old answer lives on
                until = at + self.ttl_ms
        if until is not None and until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.answer.update((etag, until))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_freshness(answers: DataFrame, ttl_ms: int, late: str = "10 minutes") -> DataFrame:
    """(url, at, reuse, etag) for a stream of (url, at, status, etag): whether an answer no older than ``ttl_ms`` was at hand when the address came up, and the etag known by then.

    An answer of status 200 to 299 lives for ``ttl_ms``; until then later ones
    aren't asked for. One of 304 renews what it confirms. What is too old, by
    event time and watermark, leaves the state.
    """
    rocksdb(answers.sparkSession)
    return answers.select("url", "at", "status", "etag").withWatermark("at", late).groupBy("url").transformWithState(Freshness(ttl_ms), FRESHNESS, "append", "eventTime")


def rocksdb(spark: SparkSession) -> None:
    """State with timers and times to live needs the provider on RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
