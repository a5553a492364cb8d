"""Order-dependent rules against sequential folds written from the rules, on seeded random logs, and
literal cases."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chatloom.functions import text as t
from chatloom.operators import hooks, lifecycle, memory, monitor, routing, sessions, state, trace
from chatloom.sources import io
from chatloom.streaming import processors, runs
from chatloom.streaming.processors import ThinkFilter


def _log(seed: int, n: int) -> list[tuple]:
    """Conversations with system rows, tool rounds, empty answers and turns that were stopped."""
    r, rows = random.Random(seed), []
    for conv in range(n):
        turn = 0
        for _ in range(r.randint(1, 30)):
            role = r.choices(["user", "assistant", "tool", "system"], [4, 4, 1, 1])[0]
            calls = [("c", "t", "{}")] if role == "assistant" and r.random() < 0.3 else None
            text = "" if r.random() < 0.15 else r.choice("abcde") * r.randint(1, 900)
            rows.append((conv, turn, role, text, calls))
            turn += r.randint(1, 3)
    return rows


MESSAGES = "conv_id long, turn long, role string, text string, tool_calls array<struct<id:string,name:string,arguments:string>>"


def _fold(rows: list[tuple]) -> dict:
    """Memory of each conversation, message by message."""
    out, by = {}, {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    for conv, messages in by.items():
        held, summary, last, xid = [], "", "", 0
        for _, _, role, text, calls in sorted(messages, key=lambda m: m[1]):
            if role == "system":
                continue
            held.append((role, text))
            if role != "assistant" or calls:
                continue
            excerpt = "\n".join(f"{r}: {x}" for r, x in held if r in ("user", "assistant") and x)[-1500:]
            if excerpt:
                users = [i for i, m in enumerate(held) if m[0] == "user"]
                answers = [i for i, m in enumerate(held) if m[0] == "assistant" and m[1]]
                user, answer = held[users[-1]][1] if users else "", held[answers[-1]][1] if answers else ""
                if user or answer:
                    last = f"user: {user}\nassistant: {answer}".strip()
                held = [held[i] for i in sorted(users[-1:] + answers[-1:])]
                branch = "inline" if len(excerpt) < 200 else "merge" if summary else "seed"
                summary = (f"{summary}\n{excerpt}" if summary else excerpt)[-2000:]
                out[conv, xid] = (excerpt, summary, branch, last)
            xid += 1
    return out


def test_memory_equals_fold(spark):
    rows = _log(1, 60)
    df = spark.createDataFrame(rows, MESSAGES)
    rolled = memory.rolling_summary(memory.build_excerpts(df))
    got = {(r.conv_id, r.xid): (r.excerpt, r.summary, r.branch) for r in rolled.collect()}
    want = _fold(rows)
    assert got == {k: v[:3] for k, v in want.items()}
    last = {(r.conv_id, r.xid): r.last_exchange for r in memory.last_exchange_asof(df).collect()}
    assert {k: last[k] for k in want} == {k: v[3] for k, v in want.items()}
    folded = hooks.merged_summaries(memory.build_excerpts(df), lambda a, b: 1 / 0)
    assert {(r.conv_id, r.xid): (r.excerpt, r.summary, r.branch) for r in folded.collect()} == got


def test_memory_bounds_and_one_exchange(spark):
    df = spark.createDataFrame(_log(2, 20), MESSAGES)
    rolled = memory.rolling_summary(memory.build_excerpts(df))
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1 and plan.count("Exchange") == 1
    assert all(len(r.summary) <= 2000 and len(r.excerpt) <= 1500 for r in rolled.collect())


def test_initial_summary_goes_in_front(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", None), (1, 1, "assistant", "yo", None)], MESSAGES)
    initial = spark.createDataFrame([(1, "old")], "conv_id long, summary string")
    row = memory.rolling_summary(memory.build_excerpts(df), initial).first()
    assert (row.summary, row.branch) == ("old\nuser: hi\nassistant: yo", "inline")


def _visible(chunks: list[str]) -> str:
    fold, state_, out = ThinkFilter(), None, []
    state_ = fold.start()
    for i, c in enumerate(chunks):
        out += [x[1] for x in fold.step(state_, Row(seq=i, content=c))]
    return "".join(out)


def test_think_filter_is_chunk_invariant(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["<think>", "</think>", "<th", "</", "<", "a", " b", "\n", "think>"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    want = {}
    for text in texts:
        cut = sorted(r.randint(0, len(text)) for _ in range(4))
        pieces = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
        assert _visible(pieces) == _visible([text])
        want[text] = _visible([text])
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert all(r.v == want[r.text].strip() for r in df.select("text", t.strip_think(F.col("text")).alias("v")).collect())
    segments = t.think_segments(df.distinct().withColumn("id", F.col("text"))).where("NOT is_thinking").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "segment"))).alias("s"))
    got = {r.id: "".join(x.segment for x in r.s) for r in segments.collect()}
    assert {x: got.get(x, "") for x in set(texts)} == {x: want[x] for x in set(texts)}


def test_pairing_equals_fold(spark):
    r, rows, want = random.Random(4), [], {}
    for inst in range(40):
        open_ = []
        for seq in range(r.randint(1, 40)):
            name, kind = r.choice("ab"), r.choice(["call", "result"])
            rows.append((str(inst), 0, seq, kind, name, "{}", f"r{seq}"))
            if kind == "call":
                open_.append([seq, name, None])
                want[str(inst), seq] = None
            else:
                for c in reversed(open_):
                    if c[1] == name and c[2] is None:
                        c[2] = want[str(inst), c[0]] = f"r{seq}"
                        break
    df = spark.createDataFrame(rows, "instance_id string, iteration int, seq long, kind string, name string, args string, result string")
    assert {(x.instance_id, x.seq): x.result for x in trace.pair_results(df).collect()} == want


def test_running_intervals_equal_fold(spark):
    r, starts, stops, want = random.Random(5), [], [], {}
    for bus in range(10):
        live, count = {}, 0
        for seq in range(60):
            name = r.choice(["loop", "timer"])
            if r.random() < 0.6:
                count += 1
                live[f"{name}#{count}"] = name
                starts.append((bus, seq, name))
                want[bus, f"{name}#{count}"] = None
            else:
                key = name if r.random() < 0.5 or not live else r.choice(list(live))
                stops.append((bus, seq, key))
                for i in [key] if key in live else [i for i, n in live.items() if n == key]:
                    want[bus, i] = seq
                    del live[i]
    ids = lifecycle.assign_instance_ids(spark.createDataFrame(starts, "bus_id long, seq long, name string"))
    got = lifecycle.running_intervals(ids, spark.createDataFrame(stops, "bus_id long, seq long, key string"))
    assert {(x.bus_id, x.instance_id): x.stop_seq for x in got.collect()} == want


def test_reconciled_project_never_loses(spark):
    r, rows = random.Random(6), []
    for inst in range(20):
        for seq in range(15):
            tasks = [(str(i), f"t{i}", r.random() < 0.3) for i in r.sample(range(6), r.randint(0, 6))]
            rows.append((inst, seq, f"g{seq}", [f"c{seq}"], tasks, [f"l{seq}"] * r.randint(0, 4)))
    df = spark.createDataFrame(rows, "instance_id long, seq long, goal string, constraints array<string>, tasks array<struct<id:string,title:string,done:boolean>>, log array<string>")
    got = {(x.instance_id, x.seq): x for x in state.reconcile_project(df).collect()}
    for inst in range(20):
        plan, done, log = None, set(), []
        for _, seq, goal, constraints, tasks, lines in (x for x in rows if x[0] == inst):
            if plan is None and tasks:
                plan = (goal, constraints, [(i, title) for i, title, _ in tasks])
            x = got[inst, seq]
            if plan is None:
                assert (x.goal, x.log, [tuple(y) for y in x.tasks]) == (goal, lines, tasks)
                continue
            done |= {i for i, _, d in tasks if d}
            log = lines if len(lines) > len(log) else log
            assert (x.goal, x.constraints, x.log) == (plan[0], plan[1], log)
            assert [tuple(y) for y in x.tasks] == [(i, title, i in done) for i, title in plan[2]]


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ('{"iters": "7", "action": "a"}', 7), ('{"iterations": 7.0}', 7), ('{"iterations": true}', 1), ('{"iterations": 7.5}', None), ('{"iterations": null}', None), ("{", None),
        ('{"goal": 5}', None), ('{"terminated": 2}', None), ('{"terminated": "yes"}', 0), ("[1]", None), ('{"iterations": " 8 "}', 8),
    ],
)
def test_loop_state_coercion(spark, payload, want):
    got = state.normalise_loop_state(spark.createDataFrame([(1, 1, payload)], "instance_id long, seq long, payload string")).collect()
    assert [x.iterations for x in got] == ([] if want is None else [want])


@pytest.mark.parametrize(("cap", "want"), [('"unlimited"', None), ("0", None), ("-3", None), ("true", None), ('"7"', 7), ("7", 7), ('""', None), ("null", None)])
def test_loop_caps(spark, cap, want):
    row = state.normalise_loop_state(spark.createDataFrame([(1, 1, f'{{"max_iterations": {cap}, "x": [1, "a"]}}')], "instance_id long, seq long, payload string")).first()
    assert row.max_iterations == want and row.extras == {"x": '[1,"a"]'}


def test_commands(spark):
    lines = ["/timer 30", '/file news.md 5.0 "Up date!"', '/loop "Poll until ready" 30', '/schedule "Run it" 10-10-2026-11-30', "/TIMER 5", "/ loop x", "/timer abc", '/loop "open', "/stopwatch", "hello", "/nosuch"]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = {x.text: x.params for x in sessions.parse_commands(df).collect()}
    assert got["/timer 30"] == {"interval": "30.0"} and got["/TIMER 5"] == {"interval": "5.0"} and got["/timer abc"] == {"interval": "abc"}
    assert got['/file news.md 5.0 "Up date!"'] == {"path": "news.md", "poll_interval": "5.0", "message": "Up date!"}
    assert got['/loop "Poll until ready" 30']["max_iterations"] == "30" and got['/loop "open']["goal"] == '"open'
    known = spark.createDataFrame([(n,) for n in sessions.SIGNATURES], "name string")
    kinds = {x.text: x.input_kind for x in sessions.classify_inputs(df, known).collect()}
    assert (kinds["/stopwatch"], kinds["hello"], kinds["/nosuch"], kinds["/ loop x"]) == ("built_in", "prompt", "unknown", "event")


@pytest.mark.parametrize(("reply", "want"), [('["a","b"]', ["a", "b"]), ("x [] y", []), ("none", None), ('["a" "b"]', None), ('[["a"]]', None), ("['a']", None), ('["a"] ["b"]', ["a"]), ('[\n"a"\n]', ["a"])])
def test_router_replies(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "r string").select(routing.requested_names(F.col("r")).alias("n")).first().n == want


def test_session_poll_sequence(spark):
    kinds = ["token", "poll", "token", "token", "poll", "finish", "poll", "discard", "token", "poll"]
    df = spark.createDataFrame([("s", i, k, f"v{i}") for i, k in enumerate(kinds)], "sid string, seq long, kind string, value string")
    got = [(x.tokens, x.done) for x in sessions.drain_polls(df).orderBy("seq").collect()]
    assert got == [(["v0"], False), (["v2", "v3"], False), ([], True), (None, None)]


@pytest.mark.parametrize(("when", "ok"), [("10-10-2026-11-30", True), ("1-1-2026-1-5", True), ("31-02-2026-10-00", False), ("bad", False), ("1-1-26-1-5", False)])
def test_schedules(spark, when, ok):
    row = lifecycle.parse_schedules(spark.createDataFrame([("m", when)], "message string, when string")).first()
    assert (row.due is not None) == ok and (row.error is None) == ok


def test_skills_and_summaries(spark):
    texts = ["---\nname: a\ndescription: x: y\ntools: [p, q]\n---\nDo it.\n", "no", "---\nname: a\n---\nb", "---\nname: a\nname: b\ndescription: d\n---\n"]
    rows = io.parse_skills(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [r.rejected for r in rows] == [False, True, True, False]
    assert (rows[0].description, rows[0].required_tools, rows[0].instructions, rows[3].name) == ("x: y", ["p", "q"], "Do it.", "b")
    stored = spark.createDataFrame([('{"version": 2, "summary": "s"}',), ('{"version": 1, "summary": "s"}',), ("{",), ('{"version": 2}',)], "t string")
    assert [r.s for r in stored.select(io.parse_summary(F.col("t")).alias("s")).collect()] == ["s", "", "", ""]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], MESSAGES)
    assert memory.rolling_summary(memory.build_excerpts(empty)).count() == 0
    assert monitor.detect_changes(spark.createDataFrame([], "monitor_id string, ts long, frame string")).count() == 0
    assert sessions.drain_polls(spark.createDataFrame([], "sid string, seq long, kind string, value string")).count() == 0


def test_think_segments_of_long_mixed_text(spark):
    text = "<think>" + "a🙂" * 250_000 + "</think>" + "é🙂b" * 200_000 + "</thi"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = t.think_segments(df).select("pos", F.length("segment").alias("n"), "is_thinking").collect()
    assert [tuple(r) for r in got] == [(0, 500_000, True), (1, 600_005, False)]
    assert df.select(F.length(t.strip_think(F.col("text")))).first()[0] == 600_005


def test_own_end_of_an_instance(spark):
    ids = spark.createDataFrame([(1, 1, "loop", "loop#1"), (1, 2, "loop", "loop#2"), (1, 3, "loop", "loop#3")], "bus_id long, seq long, name string, instance_id string")
    stops = spark.createDataFrame([(1, 9, "loop")], "bus_id long, seq long, key string")
    ends = spark.createDataFrame([(1, 5, "loop#2"), (1, 20, "loop#3")], "bus_id long, seq long, instance_id string")
    got = {r.instance_id: r.stop_seq for r in lifecycle.running_intervals(ids, stops, ends).collect()}
    assert got == {"loop#1": 9, "loop#2": 5, "loop#3": 9}


def _seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def test_one_key_costs_its_rows(spark):
    """Twice the rows of one bus, and of one project, must not take four times as long."""

    def intervals(n: int) -> float:
        ids = spark.range(n).select(F.lit(1).alias("bus_id"), (2 * F.col("id")).alias("seq"), F.lit("loop").alias("name"), F.concat(F.lit("loop#"), F.col("id").cast("string")).alias("instance_id"))
        stops = spark.range(n).select(F.lit(1).alias("bus_id"), (2 * F.col("id") + 1).alias("seq"), F.lit("loop").alias("key"))
        return _seconds(lambda: lifecycle.running_intervals(ids, stops).write.format("noop").mode("overwrite").save())

    def projects(n: int) -> float:
        tasks = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.cast("string").alias("id"), F.lit("t").alias("title"), (F.col("id") % 20 == i).alias("done")))
        rows = spark.range(n).select(F.lit(1).alias("instance_id"), F.col("id").alias("seq"), F.lit("g").alias("goal"), F.array(F.lit("c")).alias("constraints"), tasks.alias("tasks"), F.array(F.lit("l")).alias("log"))
        return _seconds(lambda: state.reconcile_project(rows).write.format("noop").mode("overwrite").save())

    for run, n in ((intervals, 40_000), (projects, 10_000)):
        run(1000)
        assert run(2 * n) < 3 * run(n) + 3


def test_arguments_as_python_shows_them(spark):
    args = ['{"a": 1, "b": true, "c": null}', '{"s": "x", "t": "it\'s", "u": "a\\\\b\\n"}', '{"f": 2.50, "g": 1e-7, "h": 5.0, "i": -0.125, "j": 12345678901234567890}', '{"l": [1, {"k": "v"}], "d": {}}', "", "{}", None, "{", '{"e": "", "n": "5", "z": 0, "é": "日本🙂"}', '{"w": "a\u00a0b"}']
    tools = [(str(i), 1, "ok", [(0, "t", a, None)]) for i, a in enumerate(args)]
    df = spark.createDataFrame(tools, "instance_id string, position long, response string, tools array<struct<seq:long,name:string,args:string,result:string>>")
    got = {int(r.instance_id): r.detail.split("\n")[2] for r in trace.status_detail(df).collect()}

    def shown(a):
        try:
            return ", ".join(f"{k}={v!r}" for k, v in json.loads(a or "{}").items())
        except ValueError:
            return ""

    assert got == {i: f"  ↳ t({shown(a)})" for i, a in enumerate(args)}


def test_status_of_live_waiting_and_unknown(spark):
    done = spark.createDataFrame([("a", 1, "", [])], "instance_id string, position long, response string, tools array<struct<seq:long,name:string,args:string,result:string>>")
    live = spark.createDataFrame([("a", " \n", [("t", "{}", None), ("u", None, "")]), ("b", " so far ", None)], "instance_id string, text string, tools array<struct<name:string,args:string,result:string>>")
    ids = [spark.createDataFrame([(x,) for x in xs], "instance_id string") for xs in ("abc", "acx")]
    got = {r.instance_id: r.detail for r in trace.status_detail(done, live, *ids).collect()}
    assert got == {
        "a": "=== a — 1 iteration(s) ===\n[1]\n(no output)\n\n[generating]\n  ↳ t()\n    (running…)\n  ↳ u()\n…", "b": "=== b — 0 iteration(s) ===\n[generating]\nso far",
        "c": "=== c — 0 iteration(s) ===\n[waiting for next trigger]", "x": "No event found for 'x'.",
    }


def test_summary_is_exact_for_any_excerpts(spark):
    """Excerpts of one character, and of thousands."""
    r = random.Random(9)
    texts = ["x" * r.choice([0, 1, 1, 2, 3, 900, 2500]) + str(i % 10) for i in range(1500)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "conv_id long, xid long, excerpt string")
    got, so_far = {x.xid: x.summary for x in memory.rolling_summary(df).collect()}, ""
    for i, x in enumerate(texts):
        so_far = (f"{so_far}\n{x}" if i else x)[-2000:]
        assert got[i] == so_far


def test_schedule_fires_at_its_time(spark, tmp_path):
    """A schedule that is due after the last row fires while the stream runs; each fires once."""
    now = spark.sql("SELECT current_timestamp() AS now").first().now
    spark.createDataFrame([(1, -60), (2, 12), (3, 3600), (2, 12)], "id long, after int").selectExpr("id", f"timestamp'{now}' AS submitted", f"timestamp'{now}' + make_dt_interval(0, 0, 0, after) AS due").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, submitted timestamp, due timestamp").parquet(str(tmp_path / "in"))
    run = processors.stream_schedules(source).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while spark.table("fired").count() < 2 and time.time() < until:
            time.sleep(1)
        rows = sorted((x.id, (x.fire_ts - now).total_seconds()) for x in spark.table("fired").collect())
    finally:
        run.stop()
    assert rows == [(1, 0.0), (2, 12.0)]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        runs.shared_path(Cluster, "x")
