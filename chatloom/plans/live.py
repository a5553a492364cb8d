"""Queries of streams whose input is out of order, late, polled or changing, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import lifecycle as lc
from chatloom.operators import state as st
from chatloom.sources import state_files
from chatloom.sources.io import write_files
from chatloom.sources.polls import poll
from chatloom.sources.store import LatestStore
from chatloom.streaming import processors as p
from chatloom.streaming.runs import available_now, run_to_end, shared_path

from . import io as pi
from . import memory as pm
from . import watch as pw
from .registry import ORACLES, query, table

# --- rows in any order -------------------------------------------------------------------------------


def swapped(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``rows`` (with seq) as a stream of many files, and the delay that it needs: of four quarters of the range of
    seq the second comes first, then the first, the fourth and the third. The time is seq in seconds."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, f"{name}-swapped")
    rows = rows.withColumn("at", F.timestamp_seconds("seq"))
    span = rows.agg(F.max("seq")).first()[0] + 1
    quarter = F.floor(4 * F.col("seq") / span)
    for n in (1, 0, 3, 2):
        rows.where(quarter == n).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return stream, f"{span // 2 + 1} seconds"


def in_order(rows: DataFrame, key: str, fold: p.Fold, names: list[str], name: str) -> DataFrame:
    """The fold's results over ``rows`` that come in out of order."""
    stream, delay = swapped(rows, name)
    return run_to_end(lambda s: p.on_time(p.run_fold(s, key, fold, names, "at", delay)), stream, "at", name)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.captures(spark, sf_dir).select("monitor_id", F.col("event_id").alias("seq"), "frame")


@query(ORACLES["w6_detect_changes"])
def t2_unordered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(frames(spark, sf_dir), "monitor_id", p.Changes(), ["event_id", "hash", "previous_hash"], "changes")


@query(ORACLES["j5_drain_polls"])
def t3_unordered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(pi.session_log(table(spark, sf_dir, "events")), "sid", p.Sessions(), ["seq", "tokens", "done", "error"], "sessions")


@query(ORACLES["w3_rolling_summary"])
def t4_unordered_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), "role", "text")
    return in_order(rows, "conv_id", p.RollingMemory(), ["xid", "excerpt", "summary", "branch"], "memory")


@query(ORACLES["w8_reconcile_loop"])
def t5_unordered_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, delay = swapped(pw.loop_states(spark, sf_dir), "loops")
    rows = run_to_end(lambda s: p.stream_states(s, p.LoopStates(), time="at", delay=delay), stream, "at", "loops")
    return pw.shown_loops(rows)


@query(ORACLES["t6_stream_think_filter"])
def t6_unordered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = in_order(pi.answer_chunks(table(spark, sf_dir, "conversations")), "turn_id", p.ThinkFilter(), ["seq", "visible"], "visible")
    return pi.shown_answers(spark, sf_dir, pieces)


@query(ORACLES["t7_stream_event_log"])
def t7_unordered_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("seq"))
    log = in_order(rows, "instance_id", p.EventLog(), ["iteration", "position", "dropped"], "event-log")
    return log.withColumn("dropped", F.col("dropped").cast("string"))


@query(f"""WITH {pw.CAPTURES}, odd AS (SELECT monitor_id, max(event_id) AS last FROM framed WHERE event_id % 2 = 1 GROUP BY 1)
SELECT monitor_id, event_id AS late_seq, coalesce(frame, '') AS frame FROM framed JOIN odd USING (monitor_id) WHERE event_id % 2 = 0 AND event_id < last""")
def t2_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of odd numbers come in first and nothing waits, so those of even numbers below the last
    one of their monitor are too late: each of them comes out as such."""
    path, out, checkpoint = (shared_path(spark, f"late-{x}") for x in ("in", "out", "checkpoint"))
    rows = frames(spark, sf_dir)
    for odd in (1, 0):
        rows.where(F.col("seq") % 2 == odd).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        late = p.too_late(p.run_fold(stream, "monitor_id", p.Changes(), ["event_id", "hash", "previous_hash"]))
        late.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    frame = F.coalesce(F.from_json("late_row", "frame string")["frame"], F.lit(""))
    return spark.read.schema(late.schema).parquet(out).select("monitor_id", "late_seq", frame.alias("frame"))


# --- schedules on the stream's own time --------------------------------------------------------------


@query(f"""WITH {pw.PLANNED}, timed AS (SELECT *, try_strptime(w, '%d-%m-%Y-%H-%M') + to_days(CAST(id % 40 AS INTEGER)) AS due FROM planned)
SELECT id, strftime(greatest(due, submitted), '%Y-%m-%d %H:%M') AS fire_ts FROM timed WHERE due <= (SELECT max(submitted) - INTERVAL 3 DAY FROM timed)""")
def t8_watermark_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are schedules for up to 39 days after their own day. They fire as the watermark, three days behind the
    latest order, passes them; what is due after its last position stays pending."""
    path = shared_path(spark, "planned")
    rows = lc.parse_schedules(pw.planned(spark, sf_dir)).select("id", "submitted", (F.col("due") + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("due"))
    rows.write.parquet(path)
    fired = available_now(p.stream_schedules(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), "submitted", "3 days"), "watermark-schedules")
    return fired.select("id", F.date_format("fire_ts", "yyyy-MM-dd HH:mm").alias("fire_ts"))


# --- captures by a function --------------------------------------------------------------------------


def _look(user: int, tick: int) -> str | None:
    """What a poll of a user sees: changes every third tick; nothing at some, an error at others."""
    if (user + tick) % 11 == 5:
        raise OSError("gone")
    return None if (user + tick) % 5 == 3 else f"state {(user + tick) // 3}"


@query("""WITH users AS (SELECT DISTINCT user_id FROM events), polls AS (SELECT user_id, tick, 'exit_code: 0' || chr(10) || '--stdout--' || chr(10) || 'state ' || ((user_id + tick) // 3) AS frame
  FROM users, unnest(range(1, 10)) AS t(tick) WHERE (user_id + tick) % 11 <> 5 AND (user_id + tick) % 5 <> 3)
SELECT user_id, tick, hash, previous_hash FROM (SELECT user_id, tick, sha256(frame) AS hash, lag(sha256(frame)) OVER (PARTITION BY user_id ORDER BY tick) AS previous_hash FROM polls) WHERE hash <> previous_hash""")
def f4_poll_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is polled at nine ticks, in two runs of the stream: the second goes on after the first's last tick."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    out, checkpoint = shared_path(spark, "polls"), shared_path(spark, "polls-checkpoint")
    for last in (4, 9):
        frames = poll(spark, users, _look, "user_id", first=1, last=last, missed="replay").withColumnRenamed("tick", "seq")
        changes = p.on_time(p.run_fold(frames.select("user_id", "seq", "frame"), "user_id", p.Changes(), ["tick", "hash", "previous_hash"]))
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(out)


# --- summaries in a store ----------------------------------------------------------------------------


def summary_store(spark: SparkSession, path: str, **limits: float) -> LatestStore:
    """The last summary of each conversation."""
    return LatestStore(spark, path, ["conv_id"], "xid", "conv_id bigint, xid bigint, summary string", **limits)


@query(ORACLES["s3_write_summaries"])
def s3_store_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a stream that takes in the conversations in four batches; every second batch is followed by a compaction."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), "role", "text")
    path, store = shared_path(spark, "message-batches"), summary_store(spark, shared_path(spark, "summary-store"), most_deltas=2)
    checkpoint = shared_path(spark, "store-checkpoint")
    part = F.floor(4 * F.col("seq") / (rows.agg(F.max("seq")).first()[0] + 1))
    for n in range(4):
        rows.where(part == n).write.mode("append").parquet(path)
        rolled = p.on_time(p.run_fold(spark.readStream.schema(rows.schema).parquet(path), "conv_id", p.RollingMemory(), ["xid", "excerpt", "summary", "branch"]))
        store.stream(rolled, checkpoint).awaitTermination()
    return store.read().select("conv_id", "summary")


# --- state files that change -------------------------------------------------------------------------


@query(f"""WITH bounds AS (SELECT max(event_id) + 1 AS span FROM events), cuts AS (SELECT span * i // 4 AS cut FROM bounds, unnest(range(1, 5)) AS t(i)),
polled AS (SELECT DISTINCT max(event_id) AS event_id FROM events JOIN cuts ON event_id < cut GROUP BY user_id, cut),
{pw.RECONCILED.replace("FROM events WHERE", "FROM events WHERE event_id IN (FROM polled) AND")}
SELECT instance_id, goal, action, criteria, CAST(max_iterations AS VARCHAR) AS max_iterations, iterations, last_observation, terminated, termination_reason FROM rec""")
def s4_stream_state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop state files that are rewritten: at four points in the order of events every user with new ones gets
    its last snapshot, the glob is polled, and the log goes on into the live reconciliation."""
    snapshots = pw.loop_snapshots(table(spark, sf_dir, "events"))
    files, log, out = (shared_path(spark, f"state-{x}") for x in ("files", "log", "loops"))
    checkpoints = shared_path(spark, "state-checkpoints")
    user = F.regexp_extract("_metadata.file_path", r"/user_id=(\d+)/", 1)
    span, before = snapshots.agg(F.max("seq")).first()[0] + 1, -1
    for n in range(1, 5):
        upto = span * n // 4
        last = snapshots.where((F.col("seq") > before) & (F.col("seq") < upto)).groupBy(F.col("instance_id").alias("user_id")).agg(F.max_by("payload", "seq").alias("value"))
        write_files(last, files, "user_id", mode="overwrite")
        state_files.follow(spark, files, log, f"{checkpoints}/polls", user, {"availableNow": True}, first=1, last=n, missed="replay").awaitTermination()
        states = p.stream_states(st.normalise_loop_state(state_files.read_log(spark, log)), p.LoopStates())
        states.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoints}/loops").trigger(availableNow=True).start().awaitTermination()
        before = upto - 1
    rows = spark.read.schema(states.schema).parquet(out)
    return pw.shown_loops(rows.withColumn("instance_id", F.col("instance_id").cast("bigint"))).drop("seq")
