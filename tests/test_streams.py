"""Streams on input that is out of order, late or repeated, in any session zone, and what they write."""

from __future__ import annotations

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from chatloom.operators import lifecycle
from chatloom.sources import polls
from chatloom.streaming import processors as p
from chatloom.streaming import runs


def put(spark, path, rows, schema):
    """One file more."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(result, folder, name="out"):
    """One run over what there is; the query's progress reports."""
    started = result.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start()
    started.awaitTermination()
    return started.recentProgress


LOG = "k string, seq long, at timestamp_ntz, frame string"


def log(seqs):
    return [("a", i, datetime.datetime(1970, 1, 1, 0, 0, i), f"frame {i}") for i in seqs]


def test_later_file_first(spark, tmp_path):
    """Ten rows of one key in two files, the later ones first."""
    path = str(tmp_path / "in")
    for part in (range(5, 10), range(5)):
        put(spark, path, log(part), LOG)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)

    def fold(s):
        return p.run_fold(s, "k", p.Changes(), ["n", "hash", "before"], "at", "20 seconds")

    rows = runs.run_to_end(fold, stream, "at", "later-first").collect()
    assert sorted(r.n for r in rows) == list(range(1, 10)) and all(r.late_row is None for r in rows)
    # without a time the five that come too late come out as such, whole
    run(p.run_fold(stream, "k", p.Changes(), ["n", "hash", "before"]), str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.n for r in rows if r.late_row is None) == [6, 7, 8, 9]
    assert sorted((r.late_seq, json.loads(r.late_row)["frame"]) for r in rows if r.late_row) == [(i, f"frame {i}") for i in range(5)]


def test_released_by_the_watermark(spark, tmp_path):
    """What the watermark has passed comes out before the input ends; a row behind it is late, a repeated one too,
    and so is one without a seq."""
    path = str(tmp_path / "in")
    put(spark, path, log([7, 3, 5]), LOG)
    stream = spark.readStream.schema(LOG).parquet(path)
    result = p.run_fold(stream, "k", p.EventLog(), ["n", "position", "dropped"], "at", "4 seconds")

    def shown():
        rows = spark.read.schema(result.schema).parquet(str(tmp_path / "out")).collect()
        return sorted(r.n for r in rows if r.late_row is None), sorted(map(str, (r.late_seq for r in rows if r.late_row)))

    run(result, str(tmp_path))  # watermark 3
    assert shown() == ([3], [])
    put(spark, path, log([4, 4, 12, 2]), LOG)
    run(result, str(tmp_path))  # watermark 8
    assert shown() == ([3, 4, 5, 7], ["2", "4"])
    put(spark, path, [("a", None, None, "no seq"), *log([12])], LOG)
    run(result, str(tmp_path))
    assert shown() == ([3, 4, 5, 7], ["2", "4", "None"])


def test_released_by_a_timer(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in (range(5, 10), range(5)):
        put(spark, path, log(part), LOG)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    result = p.run_fold(stream, "k", p.EventLog(), ["n", "position", "dropped"], hold_ms=30_000)
    started = result.writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 150
        while spark.table("held").count() < 10 and time.time() < until:
            time.sleep(1)
        rows = sorted(((r.n, r.position, r.late_row) for r in spark.table("held").collect()), key=str)
    finally:
        started.stop()
    assert rows == [(i, i + 1, None) for i in range(10)]


CASES = {
    "sessions": (p.Sessions, "kind string, value string", lambda r, i: (r.choice(["token", "token", "poll", "finish"]) if i < 90 else r.choice(["discard", "poll"]), f"v{i}"), ["seq_out", "tokens", "done", "error"]),
    "memory": (p.RollingMemory, "role string, text string", lambda r, i: (r.choice(["user", "assistant", "system"]), "x" * r.choice([0, 3, 400, 2500]) + str(i)), ["xid", "excerpt", "summary", "branch"]),
    "files": (p.FileTimes, "mtime double", lambda r, i: (r.choice([None, float("nan"), 0.0, 1.5, 2.0]),), ["seq_out", "mtime", "before"]),
    "think": (p.ThinkFilter, "content string", lambda r, i: ("".join(r.choice(["<think>", "</think>", "a", "<", "thi"]) for _ in range(3)),), ["seq_out", "visible"]),
    "events": (p.EventLog, "ignored string", lambda r, i: ("x",), ["n", "position", "dropped"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_any_file_order_gives_the_sorted_result(spark, tmp_path, name):
    """Rows of three keys, dealt at random over files; a run on all rows at once is sorted, and is the measure."""
    fold, columns, make, names = CASES[name]
    r = random.Random(len(name))
    schema = f"k string, seq long, {columns}"
    rows = [(k, i, *make(r, i)) for k in "abc" for i in range(100)]
    whole = spark.createDataFrame(rows, schema)
    put(spark, str(tmp_path / "whole"), rows, schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "whole"))
    run(p.on_time(p.run_fold(stream, "k", fold(), names)), str(tmp_path))
    want = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    timed = whole.withColumn("at", F.timestamp_seconds("seq"))
    r.shuffle(rows)
    for part in range(4):
        put(spark, str(tmp_path / "dealt"), rows[part::4], schema)
    dealt = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "dealt")).withColumn("at", F.timestamp_seconds("seq"))
    got = runs.run_to_end(lambda s: p.on_time(p.run_fold(s, "k", fold(), names, "at", "200 seconds")), dealt, "at", name)
    assert timed.count() == 300 and len(want) > 10
    assert sorted(map(str, got.collect())) == want


@pytest.mark.parametrize("fold", ["sessions", "events"])
def test_a_batch_writes_what_it_brought(spark, tmp_path, fold):
    """A key with much state: a small batch must not write it all again."""
    path, n = str(tmp_path / "in"), 20_000
    schema = "k string, seq long, kind string, value string"
    spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("seq"), F.lit("token").alias("kind"), F.repeat(F.lit("v"), 50).alias("value")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    made = p.Sessions() if fold == "sessions" else p.EventLog()
    result = p.run_fold(stream, "k", made, ["a", "b", "c"] if fold == "events" else ["a", "b", "c", "d"])

    def written(progress):
        return sum(o["numRowsUpdated"] for x in progress for o in x["stateOperators"]), sum(o["customMetrics"].get("rocksdbTotalBytesWritten", 0) for x in progress for o in x["stateOperators"])

    first = written(run(result, str(tmp_path)))
    put(spark, path, [("a", n + i, "token", "v") for i in range(5)], schema)
    second = written(run(result, str(tmp_path)))
    print(fold, first, second)
    assert second[0] <= 20
    if fold == "sessions":
        assert first[1] > 50 * n and second[1] < first[1] / 100


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
@pytest.mark.parametrize("timed", [False, True])
def test_schedules_in_any_zone(spark, tmp_path, zone, timed):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(i, f"{1 + i % 28}-{1 + i % 12}-2023-{i % 24}-30", f"2023-06-{1 + i % 28:02d} 10:00:00") for i in range(60)] + [(99, "31-02-2023-10-00", "2023-06-01 10:00:00"), (100, "1-1-2024-0-0", None)]
        planned = lifecycle.parse_schedules(spark.createDataFrame(rows, "id long, when string, submitted string").selectExpr("id", "when", "'' AS message", "CAST(submitted AS timestamp) AS submitted"))
        planned = planned.select("id", "submitted", "due")
        planned.write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(planned.schema).parquet(str(tmp_path / "in"))
        if timed:
            got, as_of = runs.available_now(p.stream_schedules(source, "submitted", "1 day"), "zones"), F.lit("2023-06-27 10:00:00").cast("timestamp")
        else:
            got, as_of = runs.until_idle(p.stream_schedules(source), "zones"), F.current_timestamp()
        want = lifecycle.due_schedules(planned, as_of).withColumn("fire_ts", F.coalesce("fire_ts", "due"))
        shown = ["id", F.date_format("due", "yyyy-MM-dd HH:mm").alias("due"), F.date_format("fire_ts", "yyyy-MM-dd HH:mm").alias("fire")]
        rows = sorted(map(tuple, got.select(*shown).collect()))
        assert rows == sorted(map(tuple, want.select(*shown).collect())) and len(rows) > 20
        assert dict((i, d) for i, d, _ in rows).get(0) in (None, "2023-01-01 00:30")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_release_leaves_what_waits(spark, tmp_path):
    """Ten thousand rows of 2,500 keys wait; a batch that makes a few due writes a few pages, not all that waits."""
    path, n = str(tmp_path / "in"), 10_000
    schema = "k long, seq long, at timestamp, ignored string"
    rows = spark.range(n).select((F.col("id") % 2500).alias("k"), "id", F.timestamp_seconds(F.col("id") + 1000), F.lit("x")).toDF(*(c.split()[0] for c in schema.split(", ")))
    rows.coalesce(1).write.parquet(path)
    result = p.run_fold(spark.readStream.schema(schema).parquet(path), "k", p.EventLog(), ["n", "position", "dropped"], "at", f"{n - 10} seconds")

    def updated(progress):
        return sum(o["numRowsUpdated"] for x in progress for o in x["stateOperators"])

    def put_one(i):
        put(spark, path, [(i, i, datetime.datetime.fromtimestamp(i + 1000), "x")], schema)

    run(result, str(tmp_path))
    put_one(n)
    assert updated(run(result, str(tmp_path))) < n / 10
    got = spark.read.schema(result.schema).parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in got.collect()) == list(range(11)) and got.schema["k"].dataType.simpleString() == "bigint"
    held = spark.read.format("statestore").option("path", str(tmp_path / "out-cp")).option("operatorId", 0).option("stateVarName", "index").load()
    assert held.select("key").distinct().count() <= p.BUCKETS


def test_polls_are_dealt_out(spark, tmp_path):
    """A tick meets 4,000 polled rows in many tasks."""
    rows = polls.poll(spark, spark.range(4000).repartition(4), lambda i, tick: f"{i % 7} {tick}", "id", first=1, last=1, missed="replay").withColumn("task", F.spark_partition_id())
    run(rows, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("id", "tick").distinct().count() == got.count() == 4000 and got.select("task").distinct().count() > 1
