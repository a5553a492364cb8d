"""Polls, state files that change, and the store of latest rows, across restarts and crashes."""

from __future__ import annotations

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from chatloom.sources import polls, state_files
from chatloom.sources.io import write_files
from chatloom.sources.store import LatestStore


def test_ticks_of_a_restarted_stream(spark, tmp_path):
    """Ticks go on after the last finished one; of missed ones only the last is polled, unless they are replayed."""
    things = spark.createDataFrame([(i,) for i in range(3)], "thing long")

    def seen(thing, tick):
        return f"{thing} at {tick}"

    for missed, want in (("replay", [1, 2, 3, 4, 5, 6]), ("skip", [2, 6])):
        for last in (2, 2, 6):
            stream = polls.poll(spark, things, seen, "thing", first=1, last=last, missed=missed)
            stream.writeStream.format("parquet").option("path", str(tmp_path / missed)).option("checkpointLocation", str(tmp_path / f"{missed}-cp")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / missed)).collect()
        assert sorted((r.thing, r.tick) for r in rows) == [(i, t) for i in range(3) for t in want]
        assert all(r.frame == f"exit_code: 0\n--stdout--\n{r.thing} at {r.tick}" and r.at_ms == 60_000 * r.tick for r in rows)
    with pytest.raises(ValueError, match="skip or replay"):
        polls._Ticks({"missed": "never"})


def test_clock_of_the_machine():
    clock = polls._Ticks({"interval_ms": "1000"})
    start, now = clock.initialOffset(), clock.latestOffset()
    assert 0 <= now["tick"] - start["tick"] <= 1
    assert [p.tick for p in clock.partitions({"tick": 5}, {"tick": 9})] == [9] and clock.partitions({"tick": 5}, {"tick": 5}) == []


def test_changed_files_come_once_each(spark, tmp_path):
    folder, log = tmp_path / "states", str(tmp_path / "log")
    folder.mkdir()

    def put(name, text, second):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + second,) * 2)

    def poll(number):
        state_files.log_changes(spark, f"{folder}/*.json", log, number)

    put("a.json", "{1}", 0)
    put("b.json", "{2}", 1)
    poll(0)
    poll(1)  # nothing changed
    put("a.json", "{3}\nmore", 5)
    put("c.json", "", 6)
    (folder / "d.txt").write_text("no state")
    poll(2)
    poll(2)  # runs again after a crash
    put("b.json", "{4}", 7)
    poll(3)
    rows = spark.read.parquet(log).collect()
    got = sorted((os.path.basename(r.instance_id), r.seq // 1000 - 1_700_000_000, r.payload) for r in rows)
    assert [x for x in got if x[0] != "c.json"] == [("a.json", 0, "{1}"), ("a.json", 5, "{3}\nmore"), ("b.json", 1, "{2}"), ("b.json", 7, "{4}")]
    # only what may have changed is read
    plan = spark.read.text(f"{folder}/*.json", wholetext=True).where(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(1_700_000_007_000)))
    assert plan.count() == 1


def test_many_files_are_rewritten_and_listed_by_few_tasks(spark, tmp_path):
    """Files of keys that are written again keep their paths; odd names are those of Spark's writer; no task for each folder."""
    folder, log, keys = str(tmp_path / "states"), str(tmp_path / "log"), ["a b", "x=1/2", "100%", 'q"\'', "ü", None]
    rows = spark.range(300).select(F.coalesce(*(F.when(F.col("id") == i, k) for i, k in enumerate(keys[:-1])), F.when(F.col("id") != 5, F.col("id").cast("string"))).alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    write_files(rows, folder, "key")
    named = {d for d in os.listdir(folder) if d.startswith("key=")}
    state_files.log_changes(spark, folder, log, 0, F.regexp_extract("_metadata.file_path", r"/key=([^/]*)/", 1))
    write_files(rows, folder, "key", mode="overwrite")
    first = set(glob.glob(f"{folder}/key=*/*"))
    assert {d for d in os.listdir(folder) if d.startswith("key=")} == named and len(first) == 300
    write_files(rows.where("key IS NULL OR length(key) < 3 OR key = '299'").withColumn("value", F.lit("new\nlines")), folder, "key", mode="overwrite")
    assert set(glob.glob(f"{folder}/key=*/*")) == first
    for k in named:
        new = k == "key=299" or k == "key=__HIVE_DEFAULT_PARTITION__" or k[4:].isdigit() and len(k) < 7 or k == "key=ü"
        (file,) = os.listdir(f"{folder}/{k}")
        text = open(f"{folder}/{k}/{file}").read()
        assert text == "new\nlines\n" if new else text.startswith("v")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        state_files.log_changes(spark, folder, log, 1, F.regexp_extract("_metadata.file_path", r"/key=([^/]*)/", 1))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert 1 < max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(log).where("poll = 1").count() == 300


SCHEMA = "k bigint, n bigint, v string"


def store(spark, path, **limits):
    return LatestStore(spark, path, ["k"], "n", SCHEMA, **limits)


def latest(batches):
    out = {}
    for number, rows in batches:
        for k, n, v in rows:
            if k not in out or (n, number) >= out[k][:2]:
                out[k] = (n, number, v)
    return sorted((k, n, v) for k, (n, _, v) in out.items())


def test_store_equals_a_dictionary(spark, tmp_path):
    """Batches, some of which run again, with compactions between them: always the last row of each key."""
    r, s, batches = random.Random(1), store(spark, str(tmp_path / "s"), most_deltas=3, share=100.0), []
    assert s.read().collect() == []
    for number in range(8):
        rows = [(k, number * 10 + r.randint(0, 15), f"{number}/{k}") for k in r.sample(range(12), 5)]
        for _ in range(r.choice([1, 2])):  # a repeated batch
            s.put(spark.createDataFrame(rows, SCHEMA), number)
        batches.append((number, rows))
        assert sorted(map(tuple, s.read().collect())) == latest(batches)
    s.put(spark.createDataFrame([(0, 10**9, "old")], SCHEMA), 0)  # a batch that a base holds
    assert sorted(map(tuple, s.read().collect())) == latest(batches)


def test_store_reads_live_keys(spark, tmp_path):
    """After many batches of the same keys, files and rows that a reader meets follow the keys."""
    path = str(tmp_path / "s")
    s = store(spark, path, share=2.0)
    for number in range(12):
        s.put(spark.range(20).select(F.col("id").alias("k"), F.lit(number).cast("bigint").alias("n"), F.lit("x").alias("v")), number)
        version, upto, _ = s.version()
        assert s._rows(version, upto).count() <= 20 * 4
    assert len(glob.glob(f"{path}/base/*")) <= 2 and len(glob.glob(f"{path}/delta/*")) <= 4
    assert s.read().where("n = 11").count() == 20


def test_store_survives_crashes(spark, tmp_path):
    """A compaction that stops before its manifest, one that stops before it has cleaned, a batch without an end."""
    path = str(tmp_path / "s")
    s = store(spark, path, most_deltas=100, share=1000.0)
    batches = [(n, [(k, n, f"{n}") for k in range(n, n + 4)]) for n in range(4)]
    for n, rows in batches:
        s.put(spark.createDataFrame(rows, SCHEMA), n)
    want = latest(batches)

    class Crash(Exception):
        pass

    def stop(*_):
        raise Crash

    base = s.version()[0]
    s._commit = stop
    with pytest.raises(Crash):
        s.compact()
    s = store(spark, path, most_deltas=100, share=1000.0)
    assert s.version()[0] == base and sorted(map(tuple, s.read().collect())) == want
    s._clean = stop
    with pytest.raises(Crash):
        s.compact()
    s = store(spark, path, most_deltas=100, share=1000.0)
    assert s.version()[:2] == (base + 1, 3) and sorted(map(tuple, s.read().collect())) == want
    # a batch and a manifest that were begun only
    for part in ("delta/batch=4", f"manifest/version={base + 2}"):
        shutil.copytree(glob.glob(f"{path}/{part.split('/')[0]}/*")[0], f"{path}/{part}")
        os.remove(f"{path}/{part}/_SUCCESS")
    assert s.version()[0] == base + 1 and sorted(map(tuple, s.read().collect())) == want
    s = store(spark, path, most_deltas=1)
    s.put(spark.createDataFrame([(0, 9, "new")], SCHEMA), 4)
    assert s.version()[:2] == (base + 2, 4) and sorted(map(tuple, s.read().collect())) == sorted([(0, 9, "new"), *want[1:]])
