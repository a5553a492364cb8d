"""Keys of any size: scans in two levels, long conversations, many tasks; and typed router replies."""

from __future__ import annotations

import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from chatloom.operators import hooks, lifecycle, memory, routing, scan, state
from chatloom.operators.scan import Running, Split


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scan_equals_window(spark, descending, inclusive):
    r = random.Random(7)
    rows = [(k, i, r.choice([None, *range(50)])) for k, n in (("hot", 900), ("warm", 40), ("one", 1)) for i in r.sample(range(10 * n), n)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    values = {kind: Running(kind, F.struct("v", "o") if kind == "first" else F.col("v"), inclusive) for kind in ("sum", "max", "min", "first", "last")}
    values["first"] = Running("first", F.when(F.col("v") > 20, F.struct("v", "o")), inclusive)
    want = sorted(map(str, scan.running(df, ["k"], "o", values, None, descending).collect()))
    for split in (Split(30, 8), Split(0, 64), Split(10_000, 8)):
        assert sorted(map(str, scan.running(df, ["k"], "o", values, split, descending).select("k", "o", "v", *values).collect())) == want


def messages(n):
    """Half of all messages are one conversation's, the others spread over many."""
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    return lambda spark: spark.range(n).select(F.when(F.col("id") < n // 2, -1).otherwise(F.col("id") % 997).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("text "), F.repeat(F.lit("y"), (F.col("id") % 90).cast("int")), F.col("id").cast("string")).alias("text"))


def test_one_conversation_of_half_the_table(spark):
    """Same result as the window's, and no task holds the conversation."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = messages(40_000)(spark)
        split = Split(2000, 32)
        for f in (lambda s: memory.number_exchanges(rows, s).select("conv_id", "turn", "xid"), lambda s: memory.rolling_summary(memory.build_excerpts(rows, s), split=s), lambda s: memory.last_exchange_asof(rows, s)):
            one, two = f(None), f(split)
            assert two.columns == one.columns
            assert two.exceptAll(one).count() == 0 and one.count() == two.count()
        tasks = [r["count"] for r in memory.number_exchanges(rows, split).where("conv_id = -1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("xid")).collect()]
        assert sum(tasks) == 20_000 and len(tasks) >= 12 and max(tasks) <= 20_000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_summary_tails_cross_ranges(spark):
    """Excerpts of one character in ranges of a few rows: a summary's end comes from many ranges."""
    texts = ["x" * random.Random(i).choice([0, 1, 2, 700, 2500]) + str(i % 10) for i in range(600)]
    df = spark.createDataFrame([(c, i, x) for c in (1, 2) for i, x in enumerate(texts)], "conv_id long, xid long, excerpt string")
    initial = spark.createDataFrame([(1, "before")], "conv_id long, summary string")
    for start in (None, initial):
        one, two = memory.rolling_summary(df, start), memory.rolling_summary(df, start, split=Split(10, 200))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_split_intervals_and_loops(spark):
    r = random.Random(3)
    starts = spark.createDataFrame([(1, 3 * i, r.choice(["loop", "timer"]), f"i#{i}") for i in range(500)], "bus_id long, seq long, name string, instance_id string")
    stops = spark.createDataFrame([(1, 3 * i + 1, r.choice(["loop", "i#7", "i#300", "none"])) for i in range(0, 500, 9)], "bus_id long, seq long, key string")
    one, two = (lifecycle.running_intervals(starts, stops, split=s) for s in (None, Split(20, 16)))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))
    rows = [("a", i, f"g{i}", "do" if i > 40 and r.random() < 0.5 else "", ["c"], r.choice([None, 9]), r.randint(0, 30), "o", i > 300 and r.random() < 0.1, r.choice(["", "why"])) for i in range(400)]
    states = spark.createDataFrame(rows, "instance_id string, seq long, goal string, action string, exit_criteria array<string>, max_iterations long, iterations long, last_observation string, terminated boolean, termination_reason string")
    one, two = (state.reconcile_loop(states, split=s) for s in (None, Split(20, 16)))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_a_million_excerpts_of_one_conversation(spark):
    """The fold of a user's function holds a batch, not the conversation."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("xid"), F.concat(F.repeat(F.lit("e"), 230), (F.col("id") % 10).cast("string")).alias("excerpt"))

        def longest(existing: str, excerpt: str) -> str:
            used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            return f"{max(used, int(existing.split()[0]) if existing[0].isdigit() else 0)} MB{excerpt[-1]}"

        got = hooks.merged_summaries(df, longest).agg(F.count("*").alias("n"), F.max_by("summary", "xid").alias("last"), F.count_if(F.col("branch") == "merge").alias("merged")).first()
        assert (got.n, got.merged) == (n, n - 1)
        assert int(got.last.split()[0]) < 400 and got.last.endswith("9")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_tasks_in_many_snapshots(spark):
    """2,000 tasks in 2,000 snapshots: four times the work of 1,000 in 1,000, not sixteen."""

    def seconds(n):
        tasks = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.cast("string").alias("id"), F.lit("t").alias("title"), (F.col("id") == i).alias("done")))
        rows = spark.range(n).repartition(4).select(F.lit(1).alias("instance_id"), F.col("id").alias("seq"), F.lit("g").alias("goal"), F.array(F.lit("c")).alias("constraints"), tasks.alias("tasks"), F.array(F.lit("l")).alias("log"))
        began = time.perf_counter()
        done = state.reconcile_project(rows).select(F.size(F.filter("tasks", lambda t: t["done"])).alias("done"), "seq").where(F.col("done") != F.col("seq"))
        assert done.count() == 0
        return time.perf_counter() - began

    seconds(200)
    assert seconds(2000) < 8 * seconds(1000) + 5


@pytest.mark.parametrize(
    ("reply", "want"),
    [('["a", {"b": 1}]', None), ('["a", 5, null, true, "b"]', ["a", "b"]), ("[5]", []), ('["a", "x\\"y", "é"]', ["a", 'x"y', "é"]), ("[{}]", None), ('["5"]', ["5"]), ("[null]", []), ('["a",]', None), (None, None), ("", None), ('{"x": ["a"]}', ["a"])],
)
def test_typed_replies(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "r string").select(routing.requested_names(F.col("r")).alias("n")).first().n == want


def test_required_tools_once_each(spark):
    columns = "domain string, kind string, pos long, name string, required_tools array<string>"
    items = spark.createDataFrame([("d", "skill", 0, "s", ["t", "u", "t", "no"]), ("d", "skill", 1, "s2", ["t"]), ("d", "tool", 2, "t", None), ("d", "tool", 3, "u", None), ("d", "tool", 4, "t", None), ("d", "skill", None, "s3", None), ("e", "tool", 0, "u", None)], columns)
    chosen = spark.createDataFrame([(1, "d", "skill", 0, "s"), (1, "d", "skill", 1, "s2"), (1, "d", "tool", 3, "u"), (2, "d", "skill", None, "s3"), (3, "e", "tool", 0, "u")], "turn_id long, domain string, kind string, pos long, name string")
    got = sorted(map(tuple, routing.add_required_tools(chosen, items).collect()), key=str)
    assert got == sorted([(1, "d", "skill", 0, "s"), (1, "d", "skill", 1, "s2"), (1, "d", "tool", 3, "u"), (1, "d", "tool", 2, "t"), (1, "d", "tool", 4, "t"), (2, "d", "skill", None, "s3"), (3, "e", "tool", 0, "u")], key=str)
