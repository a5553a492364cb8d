"""Queries on tables that the small ones have no case of: long logs, many files, large domains."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from chatloom.operators import hooks, routing
from chatloom.plans import catalogue
from chatloom.sources import io
from chatloom.streaming import processors


def _against_sql(spark, folder, name: str) -> list[tuple]:
    """The query's rows over the tables in ``folder``, which have to be those of its SQL."""
    duck = duckdb.connect()
    for file in os.listdir(folder):
        duck.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = sorted(str(tuple(r)) for r in want.fetchall())
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).select(columns).collect()]
    assert sorted(map(str, got)) == rows
    return got


def test_status_detail_has_all_iterations(spark, tmp_path):
    """An instance of 60 iterations, more than a log keeps, one of them failed."""
    events = [{"event_id": 1000 * i + 1 + 9 * (i == 7), "user_id": 3, "event_type": "view", "value": 1.0, "props": '{"k": 1}'} for i in range(60)]
    pq.write_table(pa.Table.from_pylist(events), str(tmp_path / "events.parquet"))
    got = dict(_against_sql(spark, tmp_path, "a5_status_detail"))
    assert got[3].startswith("=== 3 — 59 iteration(s) ===\n[1]")


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """A few thousand bytes in many files are no work for one task."""
    rows = spark.range(200).coalesce(1).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    for key in (None, "id"):
        path = str(tmp_path / str(key))
        io.write_files(rows, path, key)
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_name").substr(1, 10).alias("task"), "_metadata.file_path").collect()
        assert sorted(r.value for r in files) == sorted(f"v{i}\n" for i in range(200))
        assert len({r.file_path for r in files}) == 200 and len({r.task for r in files}) > 8
    io.write_files(rows.where("id < 3").withColumn("value", F.lit("new")), path, "id", mode="overwrite")
    back = {r.id: r.value for r in spark.read.text(path, wholetext=True).collect()}
    assert len(back) == 200 and back[2] == "new\n" and back[3] == "v3\n"


def test_schedules_of_one_time_share_state(spark, tmp_path):
    """Thousands of schedules for two times are a few keys, not one each; repeated ids fire once."""
    rows = spark.range(4000).select("id", F.lit("2024-01-01").cast("timestamp").alias("submitted"), F.when(F.col("id") % 2 == 0, "2024-01-01 10:00:00").otherwise("2024-01-03 10:00:00").cast("timestamp").alias("due"))
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("2024-01-02").cast("timestamp").alias("submitted"), F.lit("2025-01-01").cast("timestamp").alias("due")).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = processors.stream_schedules(source, "submitted", "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run = run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in got) == list(range(0, 4000, 2))
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("operatorId", 0).option("stateVarName", "pending").load()
    assert held.select("key").distinct().count() <= processors.Schedules.buckets + 1


def _catalog(spark, n: int):
    items = spark.range(n).coalesce(1).select(F.lit("d").alias("domain"), F.when(F.col("id") % 2 == 0, "skill").otherwise("tool").alias("kind"), F.col("id").alias("pos"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    return items.withColumn("required_tools", F.array(F.concat(F.lit("n"), (F.col("pos") + 1).cast("string")), F.lit("nobody")))


def test_large_domain_is_the_work_of_many_tasks(spark):
    """Turns that select all of one domain of 2,500 items; with the tools that named skills require."""
    items = _catalog(spark, 2500)
    replies = spark.range(20).coalesce(1).select(F.col("id").alias("turn_id"), F.lit("d").alias("domain"), F.when(F.col("id") < 4, F.concat(F.lit('["n'), (2 * F.col("id")).cast("string"), F.lit('"]'))).otherwise("all").alias("reply"))
    got = routing.select_routed(replies, items).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.turn_id, r.pos) for r in got) == sorted([(i, 2 * i) for i in range(4)] + [(i, k) for i in range(4, 20) for k in range(2500)])
    assert len({r.task for r in got if r.turn_id >= 4}) > 1
    whole = routing.add_required_tools(routing.select_routed(replies, items), items).collect()
    both = routing.select_with_tools(replies, items).collect()
    assert sorted(map(str, both)) == sorted(map(str, whole)) and len(both) == len(got) + 4


def test_prompts_of_a_domain_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    """A file's turns of one large domain, some without a domain, some of a small one; a stream's turns too."""
    monkeypatch.setattr(routing, "SLICE_BYTES", 1 << 20, raising=False)
    items = _catalog(spark, 2500).withColumn("description", F.when(F.col("pos") != 7, F.repeat("name", F.lit(20))).otherwise(""))
    items = items.unionByName(items.where("pos < 2").withColumn("domain", F.lit("e")))
    domain = F.when(F.col("id") % 50 == 0, "e").when(F.col("id") % 50 == 1, "none").when(F.col("id") % 50 != 2, "d")
    turns = spark.range(400).coalesce(1).select(F.col("id").alias("turn_id"), domain.alias("domain"), F.lit("go on").alias("request"), F.lit(None).cast("string").alias("summary"), F.lit("x").alias("last_exchange"))
    got = routing.build_routing_prompts(turns, items).withColumn("task", F.spark_partition_id()).collect()
    texts = {d: "\n".join(f"- [{kind.upper()}] n{i}: {'' if i == 7 else f'n{i}' * 20}" for kind in ("skill", "tool") for i in range(kind == "tool", n, 2)) for d, n in (("d", 2500), ("e", 2))}
    want = {i: texts["e" if i % 50 == 0 else "d"] for i in range(400) if i % 50 not in (1, 2)}
    assert {r.turn_id: r.routing_prompt for r in got} == {i: f'Last exchange:\nx\n\nUser request: "go on"\n\nAvailable skills and tools:\n{t}\n\n{routing.RULES}' for i, t in want.items()}
    assert len(got) == len(want) and len({r.task for r in got if r.domain == "d"}) >= 4
    turns.write.parquet(str(tmp_path / "turns"))
    stream = routing.build_routing_prompts(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), items)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_batches_of_long_prompts_are_bounded(spark, tmp_path, monkeypatch):
    """A hundred prompts of a million letters don't stand in one batch of a Python worker."""
    log = str(tmp_path / "sizes")

    def noted(fn, failed):
        def run(batches):
            for batch in batches:
                with open(log, "a") as f:
                    f.write(f"{batch.str.len().sum()}\n")
                yield batch.map(fn)

        return run

    monkeypatch.setattr(hooks, "_per_row", noted)
    prompts = spark.range(100).coalesce(1).select(F.col("id").alias("turn_id"), F.lit("d").alias("domain"), F.repeat(F.lit("x"), F.lit(1_000_000)).alias("routing_prompt"))
    assert hooks.routed(prompts, lambda p: f'["n{len(p) % 7}"]', _catalog(spark, 5)).count() == 100
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) == 100_000_000 and max(sizes) < 50_000_000


def test_states_are_parsed_in_projections_of_many_tasks(spark, sf_dir):
    """A table of one file is dealt out before its states are parsed; no generator, which may be interpreted, parses."""
    for name in ("p8_normalise_loop_state", "p9_normalise_project_state"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        parsing = [line for line in plan.splitlines() if "Generate explode(array(" in line]
        assert "hashpartitioning(" in plan and len(parsing) > 1 and all("explode(array(_once#" in line for line in parsing)


def test_prompts_reach_a_classifier_without_rows_that_hold_them(spark, sf_dir, monkeypatch):
    """Turns of a large domain, of a small one, of none, one without a request, and a classifier that fails: as with prompts in rows;
    copies of a domain's text go by its share of all bytes, and no queue of rows keeps prompts."""
    monkeypatch.setattr(routing, "SLICE_BYTES", 1 << 14)
    items = _catalog(spark, 500).withColumn("description", F.when(F.col("pos") != 7, F.repeat("name", F.lit(20))).otherwise(""))
    items = items.unionByName(items.where("pos < 2").withColumn("domain", F.lit("e")))
    domain = F.when(F.col("id") % 50 == 0, "e").when(F.col("id") % 50 == 1, "none").when(F.col("id") % 50 != 2, "d")
    turns = spark.range(400).coalesce(1).select(F.col("id").alias("turn_id"), domain.alias("domain"), F.when(F.col("id") != 3, F.concat(F.lit("go "), F.col("id").cast("string"))).alias("request"), F.when(F.col("id") % 3 == 0, "s").alias("summary"), F.lit("x").alias("last_exchange"))

    def pick(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ValueError
        return f'["n{len(prompt) % 400}", "n{sum(map(ord, prompt)) % 400}"]'

    want = hooks.routed(routing.build_routing_prompts(turns, items), pick, items).collect()
    got = hooks.routed_turns(turns, pick, items).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.turn_id for r in got if r.domain == "d"}) > 300
    parts = routing.prompts_in_parts(turns, items).withColumn("task", F.spark_partition_id()).where("catalog_text IS NOT NULL").collect()
    assert 4 <= len({r.task for r in parts if r.domain == "d"}) and len(parts) <= 4 * routing.SLICES + 2
    plan = catalogue.QUERIES["f2_routed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_selections_are_cut_finely(spark):
    """Turns that select all of two domains of 40 blocks: no task makes many times the rows of a core's share."""
    items = _catalog(spark, 40_000)
    items = items.unionByName(items.withColumn("domain", F.lit("e")))
    replies = spark.range(20).coalesce(1).select(F.col("id").alias("turn_id"), F.when(F.col("id") % 2 == 0, "d").otherwise("e").alias("domain"), F.lit("all").alias("reply"))
    rows = routing.select_routed(replies, items).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 800_000 and len(rows) > 30 and max(r["count"] for r in rows) < 80_000
