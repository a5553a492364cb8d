"""Queries of the lifecycle, monitor and state operators, over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import monitor_id
from chatloom.operators import lifecycle as lc
from chatloom.operators import monitor as mo
from chatloom.operators import state as st
from chatloom.operators.trace import keep_last
from chatloom.streaming.runs import shared_path

from .registry import query, table
from .trace import SQL_K, kay

# --- instances ---------------------------------------------------------------------------------------
BUS = f"""
starts AS (SELECT user_id AS bus_id, event_id AS seq, ['loop', 'timer', 'monitor'][{SQL_K} % 3 + 1] AS name FROM events WHERE event_type = 'signup'),
ids AS (SELECT *, name || '#' || row_number() OVER (PARTITION BY bus_id ORDER BY seq) AS instance_id FROM starts),
stops AS (SELECT user_id AS bus_id, event_id AS seq, CASE WHEN {SQL_K} % 2 = 0 THEN ['loop', 'timer', 'monitor'][{SQL_K} % 3 + 1] ELSE ['loop', 'timer', 'monitor'][{SQL_K} % 3 + 1] || '#' || ({SQL_K} + 1) END AS key FROM events WHERE event_type = 'error')
"""


def event_name() -> Column:
    return F.element_at(F.array(F.lit("loop"), F.lit("timer"), F.lit("monitor")), kay() % 3 + 1)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return lc.assign_instance_ids(e.select(F.col("user_id").alias("bus_id"), F.col("event_id").alias("seq"), event_name().alias("name")))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    key = F.when(kay() % 2 == 0, event_name()).otherwise(F.concat(event_name(), F.lit("#"), (kay() + 1).cast("string")))
    return e.select(F.col("user_id").alias("bus_id"), F.col("event_id").alias("seq"), key.alias("key"))


def still_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lc.running_intervals(instances(spark, sf_dir), stops(spark, sf_dir)).where("stop_seq IS NULL")
    return ids.select(F.concat(F.col("bus_id").cast("string"), F.lit("/"), "instance_id").alias("instance_id"), "bus_id", "name")


@query(f"WITH {BUS} SELECT * FROM ids")
def w10_assign_instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir)


INTERVALS = "spans AS (SELECT i.*, (SELECT min(s.seq) FROM stops s WHERE s.bus_id = i.bus_id AND s.seq > i.seq AND s.key IN (i.instance_id, i.name)) AS stop_seq FROM ids i)"


@query(f"WITH {BUS}, {INTERVALS} SELECT * REPLACE (CAST(stop_seq AS VARCHAR) AS stop_seq) FROM spans")
def j6_running_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lc.running_intervals(instances(spark, sf_dir), stops(spark, sf_dir))
    return spans.withColumn("stop_seq", F.col("stop_seq").cast("string"))


@query(f"""WITH {BUS}, {INTERVALS}, running AS (SELECT DISTINCT bus_id || '/' || instance_id AS id FROM spans WHERE stop_seq IS NULL),
logged AS (SELECT id, least(count(*), 50) AS n FROM (SELECT user_id || '/' || ['loop', 'timer', 'monitor'][{SQL_K} % 3 + 1] || '#' || ({SQL_K} + 1) AS id FROM events WHERE event_type = 'view') GROUP BY 1),
live AS (SELECT DISTINCT bus_id || '/' || instance_id AS id FROM spans WHERE stop_seq IS NULL AND seq % 4 = 0), alls AS (SELECT id FROM running UNION SELECT id FROM logged UNION SELECT id FROM live)
SELECT id AS instance_id, CASE WHEN id IN (FROM live) THEN 'generating' WHEN id IN (FROM running) THEN 'running' ELSE 'stopped' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_iterations FROM alls LEFT JOIN logged USING (id)""")
def a4_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    ids = F.concat(F.col("user_id").cast("string"), F.lit("/"), event_name(), F.lit("#"), (kay() + 1).cast("string"))
    logged = keep_last(views.select(ids.alias("instance_id"), F.col("event_id").alias("iteration")))
    spans = lc.running_intervals(instances(spark, sf_dir), stops(spark, sf_dir)).where("stop_seq IS NULL")
    running = spans.select(F.concat(F.col("bus_id").cast("string"), F.lit("/"), "instance_id").alias("instance_id"), "seq")
    return lc.status_summary(logged, running.where("seq % 4 = 0"), running)


@query(f"WITH {BUS}, {INTERVALS} SELECT n.name, n.name IN (SELECT name FROM spans WHERE stop_seq IS NULL AND name <> 'timer') AS is_running FROM (SELECT DISTINCT name FROM starts UNION SELECT 'file') n")
def a8_running_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = instances(spark, sf_dir).select("name").distinct().union(table(spark, sf_dir, "region").limit(1).select(F.lit("file").alias("name")))
    running = lc.running_intervals(instances(spark, sf_dir), stops(spark, sf_dir)).where("stop_seq IS NULL AND name <> 'timer'")
    return lc.running_by_name(running.select("instance_id"), catalog)


# --- schedules and ticks -----------------------------------------------------------------------------
PLANNED = "planned AS (SELECT o_orderkey AS id, o_orderpriority AS message, o_orderdate + INTERVAL 12 HOUR AS submitted, CASE WHEN o_orderkey % 50 = 0 THEN '31-02-2026-10-00' ELSE strftime(o_orderdate, '%d-%m-%Y-%H-%M') END AS w FROM orders)"


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    when = F.when(F.col("o_orderkey") % 50 == 0, "31-02-2026-10-00").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy-HH-mm"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("message"), (F.col("o_orderdate") + F.expr("INTERVAL 12 HOUR")).alias("submitted"), when.alias("when"))


@query(f"""WITH {PLANNED} SELECT id, 'Scheduled ' || strftime(due, '%d/%m/%Y %H:%M') || ': ' || left(message, 50) AS label, CASE WHEN due IS NULL THEN 'invalid time: ' || w END AS error
FROM (SELECT *, try_strptime(w, '%d-%m-%Y-%H-%M') AS due FROM planned)""")
def p10_parse_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.parse_schedules(planned(spark, sf_dir)).select("id", "label", "error")


@query(f"""WITH {PLANNED} SELECT id, strftime(greatest(due, CASE WHEN id % 2 = 0 THEN submitted ELSE due END), '%Y-%m-%d %H:%M') AS fire_ts FROM (SELECT *, try_strptime(w, '%d-%m-%Y-%H-%M') AS due FROM planned)
WHERE due <= TIMESTAMP '1997-01-01' AND id % 7 <> 0""")
def j8_due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lc.parse_schedules(planned(spark, sf_dir)).withColumn("submitted", F.when(F.col("id") % 2 == 0, F.col("submitted")).otherwise(F.col("due")))
    fired = rows.where("id % 7 = 0").select("id")
    due = lc.due_schedules(rows, F.lit("1997-01-01").cast("timestamp"), fired)
    return due.select("id", F.date_format("fire_ts", "yyyy-MM-dd HH:mm").alias("fire_ts"))


@query("""SELECT id, strftime(s + to_seconds(20 * CAST(i AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS tick FROM (SELECT user_id AS id, date_trunc('minute', min(ts)) AS s FROM events GROUP BY 1), unnest(range(1, CAST(id % 7 AS BIGINT) + 1)) AS u(i)""")
def t1_timer_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.date_trunc("minute", F.min("ts")).alias("start"))
    timers = e.withColumn("end", F.expr("start + make_dt_interval(0, 0, 0, 20 * (id % 7) + 5)"))
    return lc.timer_ticks(timers).select("id", F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"))


# --- captures and files ------------------------------------------------------------------------------
CAPTURES = """captures AS (SELECT user_id, event_id, 'watch ' || user_id AS command, CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, event_type AS stdout, CASE WHEN event_type = 'error' THEN props ELSE '' END AS stderr FROM events),
framed AS (SELECT *, CASE WHEN status <> 'failed' THEN 'exit_code: ' || CASE WHEN status = 'timeout' THEN -1 ELSE exit_code END || chr(10) || '--stdout--' || chr(10) || stdout || CASE WHEN stderr <> '' OR status = 'timeout' THEN chr(10) || '--stderr--' || chr(10) || stderr || CASE WHEN status = 'timeout' THEN '[monitor] command timed out after 30s' || chr(10) ELSE '' END ELSE '' END END AS frame,
  left(sha1(command), 12) AS monitor_id FROM captures)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, error = table(spark, sf_dir, "events"), F.col("event_type") == "error"
    status = F.when(F.col("event_id") % 13 == 0, "timeout").when(F.col("event_id") % 17 == 0, "failed").otherwise("ok")
    rows = e.select("user_id", "event_id", F.concat(F.lit("watch "), F.col("user_id").cast("string")).alias("command"), status.alias("status"), F.when(error, 1).otherwise(0).alias("exit_code"), F.col("event_type").alias("stdout"), F.when(error, F.col("props")).otherwise("").alias("stderr"))
    return mo.frame_captures(rows).withColumn("monitor_id", monitor_id(F.col("command")))


@query(f"WITH {CAPTURES} SELECT event_id, frame FROM framed")
def p11_frame_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("event_id", "frame")


@query(f"WITH {CAPTURES} SELECT DISTINCT command, monitor_id FROM framed")
def p12_monitor_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("command", "monitor_id").distinct()


@query(f"""WITH {CAPTURES} SELECT monitor_id, event_id, hash, previous_hash FROM (SELECT monitor_id, event_id, sha256(frame) AS hash, lag(sha256(frame)) OVER (PARTITION BY monitor_id ORDER BY event_id) AS previous_hash FROM framed WHERE frame IS NOT NULL) WHERE hash <> previous_hash""")
def w6_detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.detect_changes(captures(spark, sf_dir), order="event_id")


@query("""WITH polls AS (SELECT user_id AS path, CAST(floor(epoch(date_trunc('second', ts)) / 7200) AS BIGINT) AS bucket, max_by(CASE WHEN event_type = 'error' THEN 0.0 ELSE floor(value / 100) END, ts) AS mtime FROM events GROUP BY 1, 2)
SELECT * FROM (SELECT path, bucket, mtime, lag(mtime) OVER (PARTITION BY path ORDER BY bucket) AS previous_mtime FROM polls) WHERE mtime <> previous_mtime""")
def w7_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mtime = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 100).cast("double"))
    stats = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", mtime.alias("mtime"))
    return mo.file_changes(stats, poll_seconds=7200)


# --- loop and project states -------------------------------------------------------------------------
LOOPS = f"""loops AS (SELECT user_id AS instance_id, event_id AS seq, 'g' || event_id AS goal, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS action, ['c' || event_id, 'd'] AS criteria,
   CASE WHEN {SQL_K} % 7 > 0 THEN CAST({SQL_K} % 7 + 5 AS BIGINT) END AS cap, CAST({SQL_K} % 20 AS BIGINT) AS it, 'o' || event_id AS obs, {SQL_K} % 25 = 0 AS ter, CASE WHEN {SQL_K} % 2 = 0 THEN event_type ELSE '' END AS reason, {SQL_K} AS k FROM events WHERE {SQL_K} <> 99)"""
RECONCILED = f"""{LOOPS},
plan AS (SELECT *, min(CASE WHEN action <> '' THEN seq END) OVER (PARTITION BY instance_id ORDER BY seq) AS at FROM loops),
rec AS (SELECT p.instance_id, p.seq, coalesce(f.goal, p.goal) AS goal, coalesce(f.action, p.action) AS action, array_to_string(coalesce(f.criteria, p.criteria), ',') AS criteria, CASE WHEN f.seq IS NULL THEN p.cap ELSE f.cap END AS max_iterations,
   CASE WHEN p.at IS NULL THEN p.it ELSE max(CASE WHEN p.at IS NOT NULL THEN p.it END) OVER w END AS iterations, p.obs AS last_observation, CASE WHEN p.at IS NULL THEN p.ter ELSE bool_or(p.at IS NOT NULL AND p.ter) OVER w END AS terminated,
   CASE WHEN p.at IS NULL THEN p.reason ELSE coalesce(first_value(CASE WHEN p.at IS NOT NULL AND p.ter AND p.reason <> '' THEN p.reason END IGNORE NULLS) OVER w, '') END AS termination_reason, p.obs
   FROM plan p LEFT JOIN loops f ON f.instance_id = p.instance_id AND f.seq = p.at WINDOW w AS (PARTITION BY p.instance_id ORDER BY p.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _json(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), value)


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def loop_snapshots(e: DataFrame) -> DataFrame:
    """Of events, state files as JSON: changing names of the iteration count, caps as numbers, texts or words, and
    one in a hundred that cannot be taken."""
    id_ = F.col("event_id").cast("string")
    alias = F.element_at(F.array(F.lit("iterations"), F.lit("iter"), F.lit("iters"), F.lit("iterations_done")), (F.col("event_id") % 4 + 1).cast("int"))
    cap = F.when(kay() % 7 == 0, F.lit('"unlimited"')).when(F.col("event_id") % 2 == 0, (kay() % 7 + 5).cast("string")).otherwise(_quoted((kay() % 7 + 5).cast("string")))
    count = F.when(kay() == 99, F.lit("7.5")).when(F.col("event_id") % 3 == 0, _quoted((kay() % 20).cast("string"))).otherwise((kay() % 20).cast("string"))
    parts = [
        _json("goal", _quoted(F.concat(F.lit(" g"), id_))), _json("action", F.when(F.col("event_type") == "click", '""').otherwise(_quoted(F.col("event_type")))),
        _json("exit_criteria", F.concat(F.lit('["c'), id_, F.lit('", true, "d "]'))), _json("max_iterations", cap), F.concat(F.lit('"'), alias, F.lit('": '), count),
        _json("last_observation", _quoted(F.concat(F.lit("o"), id_))), _json("terminated", F.when(kay() % 25 == 0, F.lit("true")).otherwise(F.lit('"no"'))),
        _json("termination_reason", F.when(kay() % 2 == 0, _quoted(F.col("event_type"))).otherwise('""')), _json("score", kay().cast("string")),
    ]
    return e.select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("seq"), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("payload"))


def loop_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.normalise_loop_state(loop_snapshots(table(spark, sf_dir, "events")))


@query(f"""WITH {LOOPS} SELECT instance_id, seq, goal, action, array_to_string(criteria, ',') AS criteria, CAST(cap AS VARCHAR) AS max_iterations, it AS iterations, obs AS last_observation, ter AS terminated, reason AS termination_reason, 'score=' || k AS extras FROM loops""")
def p8_normalise_loop_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    extras = F.array_join(F.transform(F.map_entries("extras"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return dealt_loops(spark, sf_dir).withColumns({"criteria": F.array_join("exit_criteria", ","), "extras": extras, "max_iterations": F.col("max_iterations").cast("string")}).drop("exit_criteria")


def shown_loops(rows: DataFrame) -> DataFrame:
    shown = {"criteria": F.array_join("exit_criteria", ","), "max_iterations": F.col("max_iterations").cast("string")}
    return rows.withColumns(shown).drop("exit_criteria", "extras")


def dealt_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop states, dealt out by instance while they are still narrow texts: the windows need that exchange anyway, and
    parsing runs in as many tasks."""
    return st.normalise_loop_state(loop_snapshots(table(spark, sf_dir, "events")).repartition("instance_id"))


@query(f"WITH {RECONCILED} SELECT instance_id, seq, goal, action, criteria, CAST(max_iterations AS VARCHAR) AS max_iterations, iterations, last_observation, terminated, termination_reason FROM rec")
def w8_reconcile_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_loops(st.reconcile_loop(dealt_loops(spark, sf_dir)))


@query(f"""WITH {RECONCILED}, ph AS (SELECT *, CASE WHEN action = '' THEN 'plan' WHEN terminated OR coalesce(iterations >= max_iterations, false) THEN 'done' ELSE 'iterate' END AS phase FROM rec)
SELECT instance_id, seq, phase, CASE WHEN phase = 'iterate' THEN CASE WHEN max_iterations IS NULL THEN 'Iteration ' || (iterations + 1) || ' (no iteration cap — the loop runs until an exit criterion fires).' ELSE 'Iteration ' || (iterations + 1) || ' of up to ' || max_iterations || '.' END END AS header,
  CASE WHEN phase = 'done' THEN CASE WHEN termination_reason <> '' THEN termination_reason WHEN terminated THEN 'an exit criterion was met' ELSE 'reached max_iterations (' || max_iterations || ') without an exit criterion firing' END END AS reason,
  'Exit criteria (stop when any of these holds):' || chr(10) || '  • ' || replace(criteria, ',', chr(10) || '  • ') || chr(10) AS criteria FROM ph""")
def p18_loop_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.loop_phase(st.reconcile_loop(dealt_loops(spark, sf_dir))).select("instance_id", "seq", "phase", "header", "reason", "criteria")


PROJECTS = """lines AS (SELECT DISTINCT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey, l_linenumber) AS done FROM lineitem),
tasks AS (SELECT o_custkey AS instance_id, o_orderkey AS seq, CAST(l_linenumber AS VARCHAR) AS id, 't' || l_linenumber || '-' || o_orderkey AS title, done FROM orders JOIN lines ON l_orderkey = o_orderkey),
projects AS (SELECT instance_id, seq, count(*) AS n, list(struct_pack(id := id, title := title, done := done) ORDER BY id) AS tasks FROM tasks GROUP BY 1, 2)"""
FIXED = f"""{PROJECTS},
first AS (SELECT instance_id, min(seq) AS at FROM projects GROUP BY 1),
frozen AS (SELECT p.instance_id, p.seq, t.id, t.title FROM projects p JOIN first f USING (instance_id) JOIN tasks t ON t.instance_id = f.instance_id AND t.seq = f.at),
held AS (SELECT z.*, EXISTS (SELECT 1 FROM tasks d WHERE d.instance_id = z.instance_id AND d.id = z.id AND d.done AND d.seq <= z.seq) AS done FROM frozen z),
logs AS (SELECT instance_id, seq, max(n) OVER (PARTITION BY instance_id ORDER BY seq) AS n_log FROM projects)"""


def project_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as JSON: a customer is a project, an order a snapshot, a line number a task with a numeric
    id and changing names of its done flag; the log has as many lines as the order has tasks."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("done"))
    flag = F.element_at(F.array(F.lit("done"), F.lit("completed"), F.lit("is_done")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    number, key = F.col("l_linenumber").cast("string"), F.col("o_orderkey").cast("string")
    task = F.concat(F.lit('{"id": '), number, F.lit(', "title": "t'), number, F.lit("-"), key, F.lit('", "'), flag, F.lit('": '), F.col("done").cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey").withColumn("task", task)
    each = rows.groupBy(F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "task"))), lambda x: x["task"]), ", ").alias("tasks"), F.count("*").alias("n"))
    log = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.lit('"e'), i.cast("string"), F.lit('"'))), ", ")
    return each.select("instance_id", "seq", F.concat(F.lit('{"goal": "g", "constraints": "c", "tasks": ['), "tasks", F.lit('], "log": ['), log, F.lit("]}")).alias("payload"))


def project_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.normalise_project_state(project_snapshots(spark, sf_dir))


def written_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project states, parsed once and written: their reconciliation reads them for plans, done tasks and rows."""
    states, path = project_states(spark, sf_dir).drop("extras"), shared_path(spark, "project-states")
    states.write.parquet(path)
    return spark.read.schema(states.schema).parquet(path)


@query(f"WITH {PROJECTS} SELECT instance_id, seq, 'c' AS constraints, id, title, done, n AS n_log FROM tasks JOIN projects USING (instance_id, seq)")
def p9_normalise_project_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project_states(spark, sf_dir).select("instance_id", "seq", F.array_join("constraints", ",").alias("constraints"), F.explode("tasks").alias("t"), F.size("log").cast("long").alias("n_log"))
    return rows.select("instance_id", "seq", "constraints", "t.*", "n_log")


def shown_projects(states: DataFrame) -> DataFrame:
    rows = states.select("instance_id", "seq", F.explode("tasks").alias("t"), F.size("log").cast("long").alias("n_log"))
    return rows.select("instance_id", "seq", "t.*", "n_log")


@query(f"WITH {FIXED} SELECT instance_id, seq, id, title, done, n_log FROM held JOIN logs USING (instance_id, seq)")
def w9_reconcile_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_projects(st.reconcile_project(written_projects(spark, sf_dir)))


@query(f"""WITH {FIXED}, cur AS (SELECT instance_id, seq, min(id) FILTER (NOT done) AS current_id, count(*) AS n_tasks, count(*) FILTER (done) AS n_done FROM held GROUP BY 1, 2)
SELECT instance_id, seq, CASE WHEN current_id IS NULL THEN 'done' ELSE 'task' END AS phase, current_id, n_done, n_tasks,
  string_agg('  ' || CASE WHEN done THEN '[x] ' ELSE '[ ] ' END || id || ': ' || title || CASE WHEN id = current_id THEN '  <- CURRENT' ELSE '' END, chr(10) ORDER BY id) || chr(10) AS task_list FROM held JOIN cur USING (instance_id, seq) GROUP BY ALL""")
def p19_project_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.project_phase(st.reconcile_project(written_projects(spark, sf_dir))).select("instance_id", "seq", "phase", "current_id", "n_done", "n_tasks", "task_list")


@query(f"WITH {PROJECTS} SELECT instance_id, seq, count(*) FILTER (done) AS n_done, count(*) AS n_tasks, bool_and(done) AS all_done FROM tasks GROUP BY 1, 2")
def a7_project_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.project_progress(project_states(spark, sf_dir)).select("instance_id", "seq", "n_done", "n_tasks", "all_done")
