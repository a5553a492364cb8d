"""Versioned JSON state of loops and projects: tolerant reading, reconciliation, and the phase it implies.

Payloads are parsed once, to a map of field names and values; a payload with one field that cannot be taken counts as
missing, as does malformed JSON. Integers take whole numbers, also as text or true; booleans take true,
false, 0, 1 and their usual words; texts take only strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import strip
from chatloom.operators.scan import RANGE, Running, Split, running, with_ranges

# Other names that fields go by, the first one present counts.
ITERATIONS = ("iterations", "iterations_done", "iterations_completed", "iter_count", "iter", "iters", "current_iteration")
DONE = ("done", "complete", "completed", "is_done", "finished")
_TRUE, _FALSE = ("true", "1", "yes", "y", "on", "t"), ("false", "0", "no", "n", "off", "f")


def _raw(fields: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))


def _shown(v: Column) -> Column:
    return F.struct(v.alias("v"), F.to_json(v).alias("json"))


def _value(x: Column) -> Column:
    """Of ``_shown``: the JSON text (json) and, of a string, the string (text), else the same."""
    return F.struct(x["json"].alias("json"), F.when(x["json"].startswith('"'), F.try_variant_get(x["v"], "$", "string")).otherwise(x["json"]).alias("text"))


def _kind(raw: Column) -> Column:
    json = raw["json"]
    return F.when(json.startswith('"'), "text").when(json.startswith("["), "list").when(json.startswith("{"), "object").when(json.isin("true", "false"), "bool").when(json == "null", "null").otherwise("number")


def _text(raw: Column) -> Column:
    """The value of a JSON string, and the JSON of anything else."""
    return raw["text"]


def _string(raw: Column) -> tuple[Column, Column]:
    """Value and whether it can be taken."""
    return F.when(raw.isNull(), F.lit("")).otherwise(strip(_text(raw))), raw.isNull() | (_kind(raw) == "text")


def _whole(raw: Column) -> tuple[Column, Column]:
    number = F.when(raw["json"] == "true", "1").when(raw["json"] == "false", "0").otherwise(strip(_text(raw))).try_cast("double")
    good = raw.isNull() | (_kind(raw).isin("text", "number", "bool") & number.isNotNull() & (number == F.floor(number)))
    return F.coalesce(number.cast("long"), F.lit(0)), good


def _flag(raw: Column) -> tuple[Column, Column]:
    word = F.lower(_text(raw))
    good = raw.isNull() | (_kind(raw).isin("bool", "text", "number") & (word.isin(*_TRUE, *_FALSE) | word.isin("1.0", "0.0")))
    return F.coalesce(word.isin(*_TRUE, "1.0"), F.lit(False)), good


def _strings(raw: Column) -> Column:
    """A text becomes a list of one; of a list, texts and numbers are kept, stripped."""
    listed = F.when(_kind(raw) == "list", raw["json"])
    items = F.from_json(listed, "array<string>")
    shapes = F.from_json(listed, "array<variant>")
    plain = F.filter(F.transform(F.arrays_zip(items.alias("v"), shapes.alias("s")), lambda x: F.when(F.schema_of_variant(x["s"]).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), strip(x["v"]))), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(_kind(raw) == "text", F.array(_text(raw))).when(_kind(raw) == "list", plain), empty)


def _cap(raw: Column) -> Column:
    """A positive whole number, or null for uncapped."""
    value = strip(_text(raw))
    number = F.when(_kind(raw) == "number", value.try_cast("double").cast("long")).when((_kind(raw) == "text") & value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("long"))
    return F.when(number > 0, number)


def _fields(payload: Column) -> Column:
    """The payload's fields; null if it is no JSON object."""
    # in two steps, as a lambda works out each mention of a value anew
    return F.transform_values(F.transform_values(F.from_json(payload, "map<string,variant>"), lambda _, v: _shown(v)), lambda _, x: _value(x))


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row: explode stands between it and those who use it, so
    the optimizer does not copy the expression into each of them. The value is computed below the explode, in a
    projection, which is compiled and computes common parts once; a generator's argument may be interpreted."""
    return rows.withColumn("_once", value).select(*rows.columns, F.explode(F.array("_once")).alias(name))


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return F.coalesce(out, F.lit(False))


def normalise_loop_state(snapshots: DataFrame) -> DataFrame:
    """Valid loop states of snapshots (payload; all other columns stay): goal, action, exit_criteria,
    max_iterations (null: uncapped), iterations, last_observation, terminated, termination_reason,
    extras (raw JSON of every other field)."""
    rows = _once(snapshots, _fields(F.col("payload")), "_f")
    f = F.col("_f")
    texts = {n: _string(_raw(f, (n,))) for n in ("goal", "action", "last_observation", "termination_reason")}
    iterations, flag = _whole(_raw(f, ITERATIONS)), _flag(_raw(f, ("terminated",)))
    present = F.coalesce(*(F.when(F.map_contains_key(f, n), F.lit(n)) for n in ITERATIONS))
    known = F.array(*map(F.lit, (*texts, "exit_criteria", "max_iterations", "terminated")))
    extras = F.transform_values(F.map_filter(f, lambda k, v: ~F.array_contains(known, k) & ~k.eqNullSafe(present)), lambda _, v: v["json"])
    out = {n: v for n, (v, _) in texts.items()} | {"exit_criteria": _strings(_raw(f, ("exit_criteria",))), "max_iterations": _cap(_raw(f, ("max_iterations",))), "iterations": iterations[0], "terminated": flag[0], "extras": extras}
    good = _all(f.isNotNull(), iterations[1], flag[1], *(ok for _, ok in texts.values()))
    rows = _once(rows, F.struct(*(c.alias(n) for n, c in out.items()), good.alias("_good")), "_s")
    keep = [c for c in snapshots.columns if c != "payload"]
    return rows.where("_s._good").select(*keep, *(F.col("_s")[n].alias(n) for n in out))


def normalise_project_state(snapshots: DataFrame) -> DataFrame:
    """Valid project states: goal, constraints, tasks (array of id, title, done), log, extras."""
    rows = _once(snapshots, _fields(F.col("payload")), "_f")
    f = F.col("_f")
    parts = {"id": ("id",), "title": ("title",), "done": DONE}

    def each_part(tasks: Column, make) -> Column:
        return F.transform(tasks, lambda t: F.when(t.isNotNull(), F.struct(*(make(t, n).alias(n) for n in parts))))

    found = each_part(F.from_json(_raw(f, ("tasks",))["json"], "array<map<string,variant>>"), lambda t, n: _raw(t, parts[n]))
    shown = each_part(found, lambda t, n: F.when(t[n].isNotNull(), _shown(t[n])))
    rows = _once(rows, each_part(shown, lambda t, n: F.when(t[n].isNotNull(), _value(t[n]))), "_raw_tasks")

    def task(each: Column) -> Column:
        title, title_ok = _string(each["title"])
        done, done_ok = _flag(each["done"])
        text = strip(_text(each["id"]))
        return F.struct(text.alias("id"), title.alias("title"), done.alias("done"), _all(text != "", _kind(each["id"]) != "null", title_ok, done_ok).alias("ok"))

    empty = F.array().cast("array<struct<id:string,title:string,done:boolean,ok:boolean>>")
    rows = _once(rows, F.when(F.map_contains_key(f, "tasks"), F.transform("_raw_tasks", task)).otherwise(empty), "_tasks")
    goal, goal_ok = _string(_raw(f, ("goal",)))
    known = F.array(*map(F.lit, ("goal", "constraints", "tasks", "log")))
    plain = F.transform("_tasks", lambda t: F.struct(t["id"].alias("id"), t["title"].alias("title"), t["done"].alias("done")))
    out = {"goal": goal, "constraints": _strings(_raw(f, ("constraints",))), "log": _strings(_raw(f, ("log",))), "tasks": plain, "extras": F.transform_values(F.map_filter(f, lambda k, _: ~F.array_contains(known, k)), lambda _, v: v["json"])}
    good = _all(f.isNotNull(), goal_ok, F.col("_tasks").isNotNull(), F.forall("_tasks", lambda t: t["ok"]))
    rows = _once(rows, F.struct(*(c.alias(n) for n, c in out.items()), good.alias("_good")), "_s")
    keep = [c for c in snapshots.columns if c != "payload"]
    return rows.where("_s._good").select(*keep, *(F.col("_s")[n].alias(n) for n in out))


def reconcile_loop(states: DataFrame, operator_cap: Column | None = None, split: Split | None = None) -> DataFrame:
    """Loop states (instance_id, seq and the fields above) as they hold after each snapshot.

    From the first state with an action on, goal, action, exit_criteria and the cap stay as they were
    there (an operator's cap before the file's), iterations never fall, terminated stays, and the first
    reason given with it stays. Earlier states pass through. An instance of very many snapshots can be
    split (see ``scan``).
    """
    cap = F.col("max_iterations") if operator_cap is None else F.coalesce(F.when(operator_cap > 0, operator_cap), F.col("max_iterations"))
    plan = F.when(F.col("action") != "", F.struct("goal", "action", "exit_criteria", cap.alias("max_iterations")))
    rows = states if split is None else with_ranges(states, ["instance_id"], "seq", split)
    rows = running(rows, ["instance_id"], "seq", {"_p": Running("first", plan)}, split).withColumn("_on", F.col("_p").isNotNull())
    on = F.col("_on")
    reason = F.when(on & F.col("terminated") & (F.col("termination_reason") != ""), F.col("termination_reason"))
    moving = {"_most": Running("max", F.when(on, F.col("iterations"))), "_ended": Running("max", on & F.col("terminated")), "_reason": Running("first", reason)}
    rows = running(rows, ["instance_id"], "seq", moving, split)
    held = {n: F.when(on, F.col("_p")[n]).otherwise(F.col(n)) for n in ("goal", "action", "exit_criteria", "max_iterations")} | {
        "iterations": F.when(on, F.greatest(F.lit(0), "_most")).otherwise(F.col("iterations")),
        "terminated": F.when(on, F.col("_ended")).otherwise(F.col("terminated")),
        "termination_reason": F.when(on, F.coalesce("_reason", F.lit(""))).otherwise(F.col("termination_reason")),
    }
    return rows.withColumns(held).drop("_p", "_on", RANGE, *moving)


def reconcile_project(states: DataFrame, split: Split | None = None) -> DataFrame:
    """Project states (instance_id, seq, goal, constraints, tasks, log, …) as they hold after each snapshot.

    From the first state with tasks on, goal, constraints and the tasks' ids, titles and order stay,
    done tasks stay done, and the longest log so far stays (the first of equally long ones). Lost tasks
    come back, new ones are left out. Tasks are rows here: for each instance and task the first snapshot that has it
    done is found by a grouping and joined to the plan's tasks, so a state costs one comparison for each
    task of its plan, however long plan and history are. ``states`` is read three times; write it first where
    it is costly.
    """
    filled = states.where(F.size("tasks") > 0)
    plan = F.min_by(F.struct("goal", "constraints", "tasks"), "seq")
    plans = filled.groupBy("instance_id").agg(plan.alias("_p"), F.min("seq").alias("_from"))
    done = filled.select("instance_id", "seq", F.explode(F.filter("tasks", lambda t: t["done"])).alias("t"))
    done = done.groupBy("instance_id", F.col("t.id").alias("id")).agg(F.min("seq").alias("since"))
    tasks = plans.select("instance_id", F.posexplode("_p.tasks").alias("at", "t")).select("instance_id", "at", "t.id", "t.title").join(done, ["instance_id", "id"], "left")
    tasks = tasks.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "title", "since"))).alias("_tasks"))
    plans = plans.select("instance_id", "_from", F.col("_p.goal").alias("_goal"), F.col("_p.constraints").alias("_constraints")).join(tasks, "instance_id")
    rows = states.join(plans, "instance_id", "left").withColumn("_on", F.coalesce(F.col("seq") >= F.col("_from"), F.lit(False)))
    on = F.col("_on")
    longest = F.when(on & (F.size("log") > 0), F.struct(F.size("log").alias("n"), (-F.col("seq")).alias("s"), F.col("log").alias("log")))
    rows = running(rows, ["instance_id"], "seq", {"_longest": Running("max", longest)}, split)
    fixed = F.transform("_tasks", lambda t: F.struct(t["id"].alias("id"), t["title"].alias("title"), F.coalesce(t["since"] <= F.col("seq"), F.lit(False)).alias("done")))
    out = {"tasks": fixed, "goal": F.col("_goal"), "constraints": F.col("_constraints"), "log": F.coalesce("_longest.log", F.array().cast("array<string>"))}
    return rows.withColumns({name: F.when(on, value).otherwise(F.col(name)) for name, value in out.items()}).drop("_from", "_goal", "_constraints", "_tasks", "_on", "_longest")


def _bullets(items: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("  • "), x)), "\n")


def loop_phase(states: DataFrame) -> DataFrame:
    """Adds phase (plan, iterate, done), header, reason and criteria to reconciled loop states."""
    capped = F.col("max_iterations").isNotNull() & (F.col("max_iterations") > 0)
    done = F.col("terminated") | F.coalesce(capped & (F.col("iterations") >= F.col("max_iterations")), F.lit(False))
    phase = F.when(F.col("action") == "", "plan").when(done, "done").otherwise("iterate")
    n, m = (F.col("iterations") + 1).cast("string"), F.col("max_iterations").cast("string")
    header = F.when(capped, F.concat(F.lit("Iteration "), n, F.lit(" of up to "), m, F.lit("."))).otherwise(F.concat(F.lit("Iteration "), n, F.lit(" (no iteration cap — the loop runs until an exit criterion fires).")))
    fallback = F.when(F.col("terminated"), "an exit criterion was met").otherwise(F.concat(F.lit("reached max_iterations ("), m, F.lit(") without an exit criterion firing")))
    criteria = F.when(F.size("exit_criteria") > 0, F.concat(F.lit("Exit criteria (stop when any of these holds):\n"), _bullets("exit_criteria"), F.lit("\n"))).otherwise("")
    rows = states.withColumn("phase", phase)
    reason = F.coalesce(F.nullif("termination_reason", F.lit("")), fallback)
    return rows.withColumns({"header": F.when(F.col("phase") == "iterate", header), "reason": F.when(F.col("phase") == "done", reason), "criteria": criteria})


def project_progress(states: DataFrame) -> DataFrame:
    """Adds n_done, n_tasks and all_done (false without tasks)."""
    done, total = F.size(F.filter("tasks", lambda t: t["done"])), F.size("tasks")
    return states.withColumns({"n_done": done.cast("long"), "n_tasks": total.cast("long"), "all_done": (total > 0) & (done == total)})


def project_phase(states: DataFrame) -> DataFrame:
    """Adds phase (plan, task, done), current_id (the first task in plan order that is not done),
    task_list, constraint_list, history and the progress columns."""
    rows = project_progress(states)
    current = F.try_element_at(F.filter("tasks", lambda t: ~t["done"]), F.lit(1))["id"]
    rows = rows.withColumns({"current_id": current, "phase": F.when(F.col("n_tasks") == 0, "plan").when(F.col("all_done"), "done").otherwise("task")})

    def line(t: Column) -> Column:
        mark = F.when(t["done"], "  [x] ").otherwise("  [ ] ")
        return F.concat(mark, t["id"], F.lit(": "), t["title"], F.when(t["id"].eqNullSafe(F.col("current_id")), "  <- CURRENT").otherwise(""))

    lists = {
        "task_list": F.concat(F.array_join(F.transform("tasks", line), "\n"), F.lit("\n")),
        "constraint_list": F.when(F.size("constraints") > 0, F.concat(F.lit("Constraints (must hold throughout):\n"), _bullets("constraints"), F.lit("\n"))).otherwise(""),
        "history": F.when(F.size("log") > 0, F.concat(F.lit("## History of completed tasks\n"), _bullets("log"), F.lit("\n\n"))).otherwise(""),
    }
    return rows.withColumns(lists)
