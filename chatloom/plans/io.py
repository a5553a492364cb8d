"""Queries of sources, sinks, plug-in points and streams, over tables derived from the driver's."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import monitor_id
from chatloom.operators import hooks as h
from chatloom.operators import lifecycle as lc
from chatloom.operators import memory as m
from chatloom.operators import monitor as mo
from chatloom.operators import state as st
from chatloom.operators.routing import RULES
from chatloom.sources import io
from chatloom.streaming import processors as p
from chatloom.streaming.runs import available_now, shared_path, stream_table, until_idle

from . import memory as pm
from . import trace as pt
from . import watch as pw
from .registry import ORACLES, query, table
from .trace import kay

# --- sources and sinks -------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM conversations")
def s1_read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_messages(spark, f"{sf_dir}/conversations.parquet")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') ELSE '' END AS summary FROM conversations")
def s2_parse_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts of version 2, of version 1, and cut off."""
    stored = io.summary_json(F.col("text"))
    stored = F.when(F.col("turn") % 3 == 1, F.regexp_replace(stored, '"version":2', '"version":1')).when(F.col("turn") % 3 == 2, F.left(stored, F.lit(9))).otherwise(stored)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", io.parse_summary(stored).alias("summary"))


@query(f"WITH {pm.X1} SELECT conv_id, max_by(summary, xid) AS summary FROM rolled GROUP BY 1")
def s3_write_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "summaries")
    io.write_summaries(m.rolling_summary(m.build_excerpts(pm.messages(spark, sf_dir))), path)
    return spark.read.parquet(path)


@query(f"WITH {pm.X1} SELECT conv_id, max_by(summary, xid) AS summary FROM rolled GROUP BY 1")
def s2_read_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file for each conversation, written and read back."""
    path = shared_path(spark, "summary-files")
    last = io.latest_summaries(m.rolling_summary(m.build_excerpts(pm.messages(spark, sf_dir))))
    io.write_files(last.select("conv_id", io.summary_json(F.col("summary")).alias("value")), path, "conv_id")
    return io.read_summaries(spark, path)


@query(ORACLES["s3_write_summaries"])
def s3_stream_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    rolled = p.on_time(p.run_fold(rows, "conv_id", p.RollingMemory(), ["xid", "excerpt", "summary", "branch"]))
    path = shared_path(spark, "summary-batches")
    io.stream_summaries(rolled.select("conv_id", "xid", "summary"), path, shared_path(spark, "summary-checkpoint")).awaitTermination()
    return io.read_summary_batches(spark, path)


@query("""SELECT user_id, '{"n": ' || count(*) || '}' AS payload, true AS has_time FROM events GROUP BY user_id""")
def s4_read_state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state file for each user, written and read back."""
    path = shared_path(spark, "states")
    state = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"n": '), F.count("*").cast("string"), F.lit("}")).alias("value"))
    io.write_files(state, path, "user_id")
    rows = io.read_state_snapshots(spark, path)
    user = F.regexp_extract("instance_id", r"/user_id=(\d+)/", 1).cast("long")
    return rows.select(user.alias("user_id"), F.regexp_replace("payload", "\n", "").alias("payload"), (F.col("seq") > 0).alias("has_time"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 7 > 0 THEN 'makes: ' || p_type END AS description,
  CASE WHEN p_partkey % 5 > 0 THEN 'Do ' || p_partkey || '.' || chr(10) || 'Then stop.' ELSE '' END AS instructions, CASE WHEN p_partkey % 5 > 0 THEN 'a,b c' ELSE '' END AS tools, p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS rejected FROM part""")
def s5_parse_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    described = F.when(key % 7 > 0, F.concat(F.lit("description: makes: "), "p_type", F.lit("\n"))).otherwise("")
    tools = F.when(key % 2 == 0, "tools: [a, b c]").otherwise("tools: a, b c,")
    body = F.concat(F.lit("\n---\n\nDo "), key.cast("string"), F.lit(".\nThen stop.\n"))
    text = F.when(key % 5 == 0, "no frontmatter").otherwise(F.concat(F.lit("---\nname: old\nname:  "), "p_name", F.lit(" \n"), described, F.lit("# note\n"), tools, body))
    rows = io.parse_skills(table(spark, sf_dir, "part").select(key.alias("id"), text.alias("text")))
    return rows.withColumn("tools", F.array_join("required_tools", ",")).drop("required_tools")


@query("""SELECT conv_id, regexp_replace(string_agg(CASE role WHEN 'user' THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**You:** ' || text WHEN 'assistant' THEN chr(10) || chr(10) || '**Agent:** ' || text END, '' ORDER BY turn), '^\\n\\n(---\\n\\n)?', '') AS transcript
FROM conversations WHERE role <> 'system' GROUP BY 1""")
def s6_render_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.render_transcripts(table(spark, sf_dir, "conversations"))


@query("""SELECT 'n' || s_suppkey AS name, 'helps ' || s_name AS description, 'Do ' || s_name || '.' AS instructions FROM supplier WHERE s_suppkey % 5 > 0""")
def s5_read_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files, some without frontmatter, written and read back."""
    path, key = shared_path(spark, "skills"), F.col("s_suppkey")
    text = F.when(key % 5 == 0, "no frontmatter").otherwise(F.concat(F.lit("---\nname: n"), key.cast("string"), F.lit("\ndescription: helps "), "s_name", F.lit("\n---\nDo "), "s_name", F.lit(".")))
    io.write_files(table(spark, sf_dir, "supplier").select(text.alias("value")), path)
    skills, _ = io.read_skills(spark, path)
    return skills.select("name", "description", "instructions")


@query(ORACLES["s6_render_transcripts"])
def s6_write_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "transcripts")
    io.write_transcripts(io.render_transcripts(table(spark, sf_dir, "conversations")), path)
    back = spark.read.text(path, wholetext=True)
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.regexp_replace("value", r"\n\z", "").alias("transcript"))


# --- plug-in points ----------------------------------------------------------------------------------


def _never(existing: str, excerpt: str) -> str:
    raise RuntimeError("no summariser here")


@query(ORACLES["w3_rolling_summary"])
def f1_merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge function that always fails gives the built-in summary."""
    return h.merged_summaries(m.build_excerpts(pm.messages(spark, sf_dir)), _never)


def _first_item(prompt: str) -> str:
    """A stand-in for a classifier: names the first tool of the catalog, and fails on every ninth length."""
    if len(prompt) % 9 == 0:
        raise ValueError("no answer")
    return json.dumps([prompt.split("- [TOOL] ", 1)[1].split(":", 1)[0]])


@query(f"""WITH {pt.CATALOG}, texts AS (SELECT domain, string_agg('- [' || upper(kind) || '] ' || name || ': ' || description, chr(10) ORDER BY kind, pos) AS c, min_by(name, pos) FILTER (kind = 'tool') AS tool FROM catalog GROUP BY 1),
picks AS (SELECT turn_id, domain, CASE WHEN length('User request: "' || reply || '"' || chr(10) || chr(10) || 'Available skills and tools:' || chr(10) || c || chr(10) || chr(10) || '{RULES.replace("'", "''")}') % 9 > 0 THEN tool END AS pick FROM replies JOIN texts USING (domain))
SELECT turn_id, i.domain, kind, pos, name FROM picks p JOIN catalog i ON i.domain = p.domain AND (pick IS NULL OR i.name = pick)""")
def f2_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pt.catalog(spark, sf_dir)
    turns = pt.replies(spark, sf_dir).select("turn_id", "domain", F.col("reply").alias("request"), F.lit("").alias("summary"), F.lit("").alias("last_exchange"))
    return h.routed_turns(turns, _first_item, items)


def _double(k: int) -> int:
    if k % 10 == 0:
        raise ValueError(f"bad {k}")
    return 2 * k


@query("""SELECT event_id, CASE WHEN event_type <> 'click' THEN 'Error: Tool ''' || event_type || ''' not found.' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0
  THEN '[Tool Error] ValueError: bad ' || json_extract_string(props, '$.k') ELSE CAST(2 * CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) END AS result FROM events""")
def f3_call_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return h.call_tools(calls, {"click": _double}).select("event_id", "result")


def _look(command: str) -> str | None:
    if command.endswith("7"):
        raise OSError("gone")
    return None if command.endswith("3") else command.upper()


@query("SELECT event_id, 'exit_code: 0' || chr(10) || '--stdout--' || chr(10) || upper(event_type || event_id) AS frame FROM events WHERE event_id % 10 NOT IN (3, 7)")
def f4_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.col("event_id").cast("string")).alias("command"))
    return h.captured(rows, _look).select("event_id", "frame")


@query("SELECT event_id, CASE WHEN value > 100 THEN 'high ' || event_type ELSE '' END AS fired_message, value <= 100 AS notify_only FROM events WHERE event_type = 'purchase' AND value > 20")
def f5_fire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("value") > 100, F.concat(F.lit("high "), "event_type"))
    fired = h.fire_events(table(spark, sf_dir, "events"), (F.col("event_type") == "purchase") & (F.col("value") > 20), message)
    return fired.select("event_id", "fired_message", "notify_only")


# --- streams: each equals its batch twin -------------------------------------------------------------


@query(ORACLES["w6_detect_changes"])
def t2_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    status = F.when(F.col("event_id") % 13 == 0, "timeout").when(F.col("event_id") % 17 == 0, "failed").otherwise("ok")
    rows = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("watch "), F.col("user_id").cast("string")).alias("command"), status.alias("status"), F.when(error, 1).otherwise(0).alias("exit_code"), F.col("event_type").alias("stdout"), F.when(error, F.col("props")).otherwise("").alias("stderr"))
    frames = mo.frame_captures(rows).select(monitor_id(F.col("command")).alias("monitor_id"), "seq", "frame")
    return available_now(p.on_time(p.run_fold(frames, "monitor_id", p.Changes(), ["event_id", "hash", "previous_hash"])), "changes")


def session_log(e: DataFrame) -> DataFrame:
    """Of events, a session's tokens, polls and ends: sid, seq, kind, value."""
    kind = F.when(F.col("event_type") == "purchase", "poll").when(F.col("event_type") == "error", "finish").when((F.col("event_type") == "signup") & (kay() < 3), "discard").otherwise("token")
    return e.select(F.col("user_id").alias("sid"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("value"))


@query(ORACLES["j5_drain_polls"])
def t3_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = session_log(stream_table(spark, sf_dir, "events"))
    return available_now(p.on_time(p.run_fold(log, "sid", p.Sessions(), ["seq", "tokens", "done", "error"])), "sessions")


@query(ORACLES["w3_rolling_summary"])
def t4_stream_rolling_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    return available_now(p.on_time(p.run_fold(rows, "conv_id", p.RollingMemory(), ["xid", "excerpt", "summary", "branch"])), "memory")


@query("""SELECT path, seq, mtime, previous_mtime FROM (SELECT user_id AS path, event_id AS seq, CASE WHEN event_type = 'error' THEN 0.0 ELSE floor(value / 100) END AS mtime,
  lag(CASE WHEN event_type = 'error' THEN 0.0 ELSE floor(value / 100) END) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_mtime FROM events) WHERE mtime <> previous_mtime""")
def t2_stream_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a poll of the file of its user."""
    mtime = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 100).cast("double"))
    polls = stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), mtime.alias("mtime"))
    return available_now(p.on_time(p.run_fold(polls, "path", p.FileTimes(), ["seq", "mtime", "previous_mtime"])), "file-changes")


@query(f"""{pm.STORED_SQL}""")
def t4_stream_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other conversation goes on from a stored summary."""
    stored = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("stored "), F.col("conv_id").cast("string")))
    rows = stream_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text", stored.alias("stored"))
    return available_now(p.on_time(p.run_fold(rows, "conv_id", p.RollingMemory(), ["xid", "excerpt", "summary", "branch"])), "stored-memory")


@query(ORACLES["w8_reconcile_loop"])
def t5_stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State files as they come in; those that cannot be taken are skipped, as in the batch."""
    snapshots = pw.loop_snapshots(stream_table(spark, sf_dir, "events"))
    rows = available_now(p.stream_states(st.normalise_loop_state(snapshots), p.LoopStates()), "loops")
    return pw.shown_loops(rows)


@query(ORACLES["w9_reconcile_project"])
def t5_stream_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project snapshots, put down as files and read as a stream."""
    path = shared_path(spark, "project-snapshots")
    snapshots = pw.project_snapshots(spark, sf_dir)
    snapshots.write.parquet(path)
    stream = spark.readStream.schema(snapshots.schema).parquet(path)
    rows = available_now(p.stream_states(st.normalise_project_state(stream), p.ProjectStates()), "projects")
    return pw.shown_projects(rows)


def answer_chunks(conversations: DataFrame) -> DataFrame:
    """Answers with thinking in them, in chunks of 16 characters: turn_id, seq, content."""
    rows = conversations.where("role = 'assistant'")
    n = F.col("conv_id") + F.col("turn")
    closed = F.concat(F.lit("<think>"), F.left("text", F.lit(40)), F.lit("</think>"), F.expr("substr(text, 41)"))
    text = F.when(n % 5 == 0, F.concat("text", F.lit("<th"))).when(n % 3 == 0, F.concat(F.lit("<think>"), "text")).otherwise(closed)
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), text.alias("text")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.expr("cast(ceil(length(text) / 16.0) AS int) - 1"))))
    return rows.select("turn_id", F.col("seq").cast("long").alias("seq"), F.expr("substr(text, 16 * seq + 1, 16)").alias("content"))


def shown_answers(spark: SparkSession, sf_dir: str, pieces: DataFrame) -> DataFrame:
    """The visible pieces of each answer, put together in order."""
    shown = pieces.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "visible"))), lambda x: x["visible"]), "").alias("visible"))
    return pt.tagged(spark, sf_dir).select("turn_id").join(shown, "turn_id", "left").fillna("", "visible")


@query(f"WITH {pt.TAGGED} SELECT turn_id, {pt.THINK_SQL} AS visible FROM tagged")
def t6_stream_think_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = answer_chunks(stream_table(spark, sf_dir, "conversations"))
    pieces = available_now(p.on_time(p.run_fold(chunks, "turn_id", p.ThinkFilter(), ["seq", "visible"])), "visible")
    return shown_answers(spark, sf_dir, pieces)


@query("""SELECT user_id AS instance_id, event_id AS iteration, least(n, 50) AS position, CAST(CASE WHEN n > 50 THEN old END AS VARCHAR) AS dropped FROM (
  SELECT user_id, event_id, row_number() OVER w AS n, lag(event_id, 50) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def t7_stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("seq"))
    log = available_now(p.on_time(p.run_fold(rows, "instance_id", p.EventLog(), ["iteration", "position", "dropped"])), "event-log")
    return log.withColumn("dropped", F.col("dropped").cast("string"))


@query(f"WITH {pw.PLANNED} SELECT id, strftime(try_strptime(w, '%d-%m-%Y-%H-%M'), '%Y-%m-%d %H:%M') AS due FROM planned WHERE try_strptime(w, '%d-%m-%Y-%H-%M') IS NOT NULL")
def t8_stream_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All are past, so each fires at once."""
    o = stream_table(spark, sf_dir, "orders")
    when = F.when(F.col("o_orderkey") % 50 == 0, "31-02-2026-10-00").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy-HH-mm"))
    rows = lc.parse_schedules(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("submitted"), F.lit("").alias("message"), when.alias("when")))
    fired = until_idle(p.stream_schedules(rows), "schedules")
    return fired.select("id", F.date_format("due", "yyyy-MM-dd HH:mm").alias("due"))
