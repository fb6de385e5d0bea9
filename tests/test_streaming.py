import random

from pyspark.sql import functions as F

from webassay.streaming import live, rates

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def stream(spark, tmp_path, rows):
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(20)]
    got = run(rates.windowed(stream(spark, tmp_path, rows), "1 hour", "1 day"), "complete", tmp_path, "windows")
    want = rates.windowed(spark.createDataFrame(rows, SCHEMA), "1 hour")
    assert sorted(map(tuple, got.select("start", "event_type", "n", "total").collect())) == sorted(map(tuple, want.select("start", "event_type", "n", "total").collect()))


def shaped(df):
    return df.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"), F.col("value").alias("ttfb_ms"), F.col("ts").alias("at"))


def test_host_states_on_a_stream_equal_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    r = random.Random(3)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 2, r.choice(["ok", "ok", "ok", "error", "blocked"]), r.choice([None, 10.0, 4000.0])) for i in range(16)]
    got = run(rates.stream_host_states(shaped(stream(spark, tmp_path, rows))), "update", tmp_path, "hosts").where("not expired")
    last = {}
    for x in got.collect():
        last[x.host] = max(last.get(x.host, (0,)), (x.requests, x.delay, x.blocks, x.errors, x.tripped))
    want = {x.host: (x.requests, x.delay, x.blocks, x.errors, x.tripped) for x in rates.host_states(shaped(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert last == want and any(x[1] > 0.25 for x in want.values()) and max(x[0] for x in last.values()) == 8


def test_silent_hosts_expire_and_start_anew(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    rows = [(0, at(0), 1, "blocked", None), (1, at(1), 1, "blocked", None), (2, at(2), 2, "ok", 5.0), (3, at(3), 2, "ok", 5.0)]
    rows += [(4 + i, at(200 + i), 2, "ok", 5.0) for i in range(4)]  # an hour and more later only host 2 is left
    rows += [(8, at(300), 1, "ok", 5.0), (9, at(301), 2, "ok", 5.0), (10, at(302), 2, "ok", 5.0), (11, at(303), 2, "ok", 5.0)]
    got = run(rates.stream_host_states(shaped(stream(spark, tmp_path, rows)), late="1 minute"), "update", tmp_path, "silent").collect()
    of = lambda host: [(x.requests, x.delay, x.expired) for x in got if x.host == host]
    assert of("h1")[:3] == [(2, 1.0, False), (2, 1.0, True), (1, 0.25, False)]
    assert [x for x in of("h2") if not x[2]][0] == (2, 0.25, False) and any(x[2] for x in of("h2"))


def test_answers_are_reused_until_their_time_is_over(spark, tmp_path):
    from datetime import datetime, timedelta

    schema = "url string, at timestamp, status int, etag string"
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [[("a", at(0), 200, "v1"), ("b", at(0), 500, None), ("c", at(0), 200, "c1")], [("a", at(20), 200, "v2"), ("b", at(21), 200, "w"), ("c", at(31), 304, None), ("c", at(40), 304, None)], [("a", at(45), 200, "v3"), ("a", at(46), 200, "v4"), ("b", at(300), 200, "x")], [("a", at(301), 200, "v5")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "answers"))
    got = run(rates.stream_freshness(source, 30 * 60_000, "1 minute"), "append", tmp_path, "fresh").orderBy("url", "at")
    of = lambda url: [(x.reuse, x.etag) for x in got.collect() if x.url == url]
    assert of("a")[:4] == [(False, None), (True, "v1"), (False, "v1"), (True, "v3")] and not of("a")[4][0]
    assert of("b")[:2] == [(False, None), (False, None)] and not of("b")[2][0]
    assert of("c") == [(False, None), (False, "c1"), (True, "c1")]


def test_live_counts_hooks_and_ends(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1), i, "critical" if i % 3 == 0 else "notice", 1.0) for i in range(12)]
    severity = lambda df: df.select(F.col("event_type").alias("severity"))
    got = run(live.severity_counts(severity(stream(spark, tmp_path, rows))), "complete", tmp_path, "severities")
    assert {r.severity: r.n for r in got.collect()} == {"critical": 4, "notice": 8}
    seen = []
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert live.run(source(), lambda df, i: seen.append(df.count()), str(tmp_path / "c1")) == "done" and sum(seen) == 12
    assert live.run(source(), lambda df, i: None, str(tmp_path / "c2"), should_stop=lambda: True) == "stopped"
    assert live.run(source(), lambda df, i: __import__("time").sleep(1), str(tmp_path / "c3"), budget=0.5) == "out of time"


def test_first_landed_page_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 3, "a", 1.0) for i in range(12)]
    pages = stream(spark, tmp_path, rows).select(F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("final_url"), F.col("ts").alias("at"))
    got = run(live.first_landed(pages, "1 day"), "append", tmp_path, "landed")
    assert sorted(r.final_url[-1] for r in got.collect()) == ["0", "1", "2"]
