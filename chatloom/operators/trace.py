"""Agent turns: streamed deltas, tool calls, results, iteration logs and their status texts.

``chunks``: turn_id, round (from 0), seq (unique in a round), content, call_index, call_id, name,
arguments; one row for each piece. ``trace``: instance_id, iteration, seq (unique), kind (call or
result), name, args (JSON), result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import is_blank, prefix, result_preview, strip, strip_think

MAX_ROUNDS, KEPT_ITERATIONS = 50, 50
# What stands for a missing text.
EXCEEDED, NO_OUTPUT = "(tool loop exceeded max rounds)", "(no output)"
# Marks of the status texts.
GENERATING, STILL_RUNNING, WAITING = "[generating]", "(running…)", "[waiting for next trigger]"


def _joined(column: str) -> Column:
    """Aggregate: the pieces of a column in order of seq; empty where there are none."""
    pieces = F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct("seq", column))))
    return F.array_join(F.transform(pieces, lambda x: x[column]), "")


def assemble_content(chunks: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """turn_id, n_rounds, last_content (of the last round that has any), final (null while unfinished).

    A turn ends with a round without calls, or after ``max_rounds`` rounds with its last content.
    """
    rounds = chunks.groupBy("turn_id", "round").agg(_joined("content").alias("content"), F.bool_or(F.col("call_index").isNotNull()).alias("calls"))
    turn = rounds.groupBy("turn_id").agg(
        (F.max("round") + 1).alias("n_rounds"),
        F.max_by("content", F.when(F.col("content") != "", F.col("round"))).alias("last_content"),
        F.max_by(F.struct("content", "calls"), "round").alias("end"),
    )
    final = F.when(~F.col("end.calls"), F.col("end.content")).when(F.col("n_rounds") >= max_rounds, F.coalesce("last_content", F.lit(EXCEEDED)))
    return turn.select("turn_id", "n_rounds", "last_content", final.alias("final"))


def assemble_tool_calls(chunks: DataFrame) -> DataFrame:
    """turn_id, round, call_index, position (by first appearance, from 0), call_id (the last one
    given), name, arguments."""
    calls = chunks.where("call_index IS NOT NULL").groupBy("turn_id", "round", "call_index")
    built = calls.agg(F.max_by("call_id", F.when(F.col("call_id") != "", F.col("seq"))).alias("call_id"), _joined("name").alias("name"), _joined("arguments").alias("arguments"), F.min("seq").alias("first"))
    order = W.partitionBy("turn_id", "round").orderBy("first")
    position = (F.row_number().over(order) - 1).cast("long")
    return built.select("turn_id", "round", "call_index", position.alias("position"), F.coalesce("call_id", F.lit("")).alias("call_id"), "name", "arguments")


def _is_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()


def check_tool_arguments(calls: DataFrame) -> DataFrame:
    """Adds shown_args (what is shown: {} for none or malformed) and args_error (null if well-formed)."""
    empty = F.coalesce("arguments", F.lit("")) == ""
    good = empty | _is_json(F.col("arguments"))
    error = F.concat(F.lit("[Tool Error] Invalid JSON arguments for '"), "name", F.lit("': '"), "arguments", F.lit("'"))
    return calls.withColumns({"shown_args": F.when(empty | ~good, "{}").otherwise(F.col("arguments")), "args_error": F.when(~good, error)})


def dispatch_calls(calls: DataFrame, selected: DataFrame) -> DataFrame:
    """Adds outcome (skill, tool, not_found, bad_arguments) and text to calls (turn_id, name, arguments).

    ``selected``: turn_id, kind (skill or tool), pos, name; only a turn's selected items resolve, skills
    before tools. A skill runs whatever its arguments are.
    """
    first = W.partitionBy("turn_id", "name").orderBy((F.col("kind") != "skill").cast("int"), "pos")
    chosen = selected.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("turn_id", "name", F.col("kind").alias("_kind"))
    rows = check_tool_arguments(calls).join(chosen, ["turn_id", "name"], "left")
    skill, bad, none = F.col("_kind") == "skill", F.col("args_error").isNotNull(), F.col("_kind").isNull()
    outcome = F.when(skill, "skill").when(bad, "bad_arguments").when(none, "not_found").otherwise("tool")
    activated = F.concat(F.lit("Skill '"), "name", F.lit("' activated. Follow the <skill:"), "name", F.lit("> block in your system instructions: execute each step in order by calling the appropriate tools."))
    text = F.when(skill, activated).when(bad, F.col("args_error")).when(none, F.concat(F.lit("Error: Tool '"), "name", F.lit("' not found.")))
    return rows.withColumns({"outcome": outcome, "text": text}).drop("_kind", "shown_args", "args_error")


def pair_results(trace: DataFrame) -> DataFrame:
    """Calls with the result that closed them (null: none): instance_id, iteration, seq, name, args, result.

    A result closes the most recent call of its name in its iteration that is still open; one without
    an open call is dropped. Depth counts open calls; a call and the result that closes it stand at the
    same level, one directly after the other.
    """
    key = ["instance_id", "iteration", "name"]
    upto = W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("kind") == "call", 1).otherwise(-1)
    rows = trace.where(F.col("kind").isin("call", "result")).withColumn("s", F.sum(step).over(upto))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("s").over(upto)))
    rows = rows.withColumn("before", F.lag("low", 1, 0).over(W.partitionBy(*key).orderBy("seq")))
    call = F.col("kind") == "call"
    # a result that finds no open call sets a new minimum and closes nothing
    level = F.when(call, F.col("s") - F.col("low")).otherwise(F.col("s") + 1 - F.col("before"))
    rows = rows.withColumn("level", level).where(call | (F.col("level") > 0))
    after = W.partitionBy(*key, "level").orderBy("seq")
    rows = rows.withColumns({"next_kind": F.lead("kind").over(after), "next_result": F.lead("result").over(after)})
    return rows.where(call).select("instance_id", "iteration", "seq", "name", "args", F.when(F.col("next_kind") == "result", F.col("next_result")).alias("result"))


def build_iterations(responses: DataFrame, trace: DataFrame) -> DataFrame:
    """The event log: instance_id, iteration, response (without thinking), tools (array of seq, name,
    args, result). ``responses``: instance_id, iteration, text, status; only those with status ok stay."""
    tools = pair_results(trace).groupBy("instance_id", "iteration").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "args", "result"))).alias("tools"))
    rows = responses.where("status = 'ok'").select("instance_id", "iteration", strip_think(F.col("text")).alias("response"))
    empty = F.array().cast("array<struct<seq:bigint,name:string,args:string,result:string>>")
    return rows.join(tools, ["instance_id", "iteration"], "left").withColumn("tools", F.coalesce("tools", empty))


def keep_last(iterations: DataFrame, n: int = KEPT_ITERATIONS) -> DataFrame:
    """The last ``n`` iterations of each instance, with position from 1."""
    newest = W.partitionBy("instance_id").orderBy(F.col("iteration").desc())
    return number_iterations(iterations.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n"))


def number_iterations(iterations: DataFrame) -> DataFrame:
    """All iterations of each instance, with position from 1."""
    return iterations.withColumn("position", F.row_number().over(W.partitionBy("instance_id").orderBy("iteration")).cast("long"))


def active_skills(trace: DataFrame) -> DataFrame:
    """Active skills of each turn: turn_id, name, instructions, position; the last activation of a name
    counts and stands where it was made. ``trace``: turn_id, seq, name, instructions."""
    newest = W.partitionBy("turn_id", "name").orderBy(F.col("seq").desc())
    kept = trace.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    position = F.row_number().over(W.partitionBy("turn_id").orderBy("seq")).cast("long")
    return kept.select("turn_id", "name", "instructions", position.alias("position"))


def format_tool_status(events: DataFrame) -> DataFrame:
    """Adds status to rows of kind (route or tool), names (array), name, args (JSON of a map)."""
    first = F.coalesce(F.try_element_at(F.map_values(F.from_json("args", "map<string,string>")), F.lit(1)), F.lit(""))
    short = F.when(F.length(first) > 60, F.concat(prefix(first, 57), F.lit("..."))).otherwise(first)
    running = F.concat(F.lit("Running "), "name", F.when(first != "", F.concat(F.lit(": "), short)).otherwise(""))
    tool = F.when(F.coalesce("name", F.lit("")) != "", running).otherwise("Thinking...")
    route = F.when(F.size("names") > 0, F.concat(F.lit("Loading: "), F.array_join("names", ", ")))
    return events.withColumn("status", F.when(F.col("kind") == "route", route).when(F.col("kind") == "tool", tool))


def _python_args(args: str) -> str:
    try:
        return ", ".join(f"{k}={v!r}" for k, v in json.loads(args).items())
    except (ValueError, AttributeError):
        return ""


#: JSON numbers that Python shows as they are written.
_PLAIN_NUMBER = r"^(-?[1-9][0-9]{0,11}|0)(\.([0-9]{0,3}[1-9]|0))?$"


def _shown_args(args: Column) -> Column:
    """k=v of each argument, values as Python shows them; null where these expressions cannot tell.

    Texts without quotes, escapes and unprintable letters, plain numbers, booleans and nulls can be told.
    """
    kinds = F.map_values(F.transform_values(F.from_json(args, "map<string,variant>"), lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))))
    entries = F.arrays_zip(F.map_entries(F.from_json(args, "map<string,string>")).alias("e"), kinds.alias("k"))

    def shown(x: Column) -> Column:
        value, kind = x["e"]["value"], x["k"]
        text = F.when((kind == "STRING") & ~value.rlike(r"['\\]|[^\p{L}\p{N}\p{P}\p{S} ]"), F.concat(F.lit("'"), value, F.lit("'")))
        word = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(value))
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & value.rlike(_PLAIN_NUMBER), value)
        return F.concat(x["e"]["key"], F.lit("="), F.coalesce(text, word, number))

    return F.transform(entries, shown)


def _tool_lines(rows: DataFrame, key: list[str], missing: str) -> DataFrame:
    """``key`` and lines (array of texts) of the tools (array with name, args, result) of rows.

    Arguments that need Python's own quoting pass through an Arrow batch function, no others.
    """
    each = rows.select(*key, F.posexplode("tools").alias("pos", "t")).select(*key, "pos", "t.name", "t.args", "t.result")
    each = each.select("*", F.explode(F.array(_shown_args(F.col("args")))).alias("parts"))  # computed once a row
    told = F.when(F.coalesce(F.trim("args"), F.lit("")).isin("", "{}"), "").when(F.forall("parts", lambda p: p.isNotNull()), F.array_join("parts", ", "))
    each = each.withColumn("told", told)
    quoted = F.pandas_udf(lambda s: s.map(lambda a: _python_args(a) if a else ""), "string")
    each = each.withColumn("args", F.coalesce("told", quoted(F.when(F.col("told").isNull(), F.col("args")))))
    below = F.when(F.col("result").isNull(), missing).otherwise(result_preview(F.col("result")))
    line = F.concat(F.lit("  ↳ "), "name", F.lit("("), "args", F.lit(")"), F.when(below != "", F.concat(F.lit("\n    "), below)).otherwise(""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return each.groupBy(*key).agg(ordered.alias("lines"))


def status_detail(iterations: DataFrame, live: DataFrame | None = None, running: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """instance_id, detail: a header, a block for each kept iteration (instance_id, position, response,
    tools), and a last one for what is being generated.

    ``live``: instance_id, text (so far), tools (a null result: it still runs), one row each.
    ``running``: instance_id of those that run; one without iterations waits for its next trigger.
    ``asked``: instance_id of those that someone asks for; unknown ones get a text that says so.
    """
    none = F.array().cast("array<string>")

    def blocks(rows: DataFrame, key: list[str], missing: str) -> DataFrame:
        joined = rows.join(_tool_lines(rows, key, missing), key, "left")
        return joined.withColumn("block", F.array_join(F.concat(F.array("head"), F.coalesce("lines", none), F.array("body")), "\n"))

    logged = iterations.withColumns({"head": F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]")), "body": F.when(F.col("response") != "", F.col("response")).otherwise(NO_OUTPUT)})
    parts = blocks(logged, ["instance_id", "position"], "").select("instance_id", "position", "block", F.lit(1).alias("n"), F.lit(False).alias("runs"))
    if live is not None:
        now = live.withColumns({"head": F.lit(GENERATING), "body": F.when(is_blank(F.col("text")), "…").otherwise(strip(F.col("text")))})
        parts = parts.unionByName(blocks(now, ["instance_id"], STILL_RUNNING).select("instance_id", F.lit(1 << 62).alias("position"), "block", F.lit(0).alias("n"), F.lit(False).alias("runs")))
    nothing = [F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("block"), F.lit(0).alias("n")]
    for ids, runs in ((running, True), (asked, False)):
        if ids is not None:
            parts = parts.unionByName(ids.select("instance_id", *nothing, F.lit(runs).alias("runs")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("position", "block")))), lambda x: x["block"]), "\n\n")
    rows = parts.groupBy("instance_id").agg(texts.alias("blocks"), F.sum("n").cast("string").alias("n"), F.bool_or("runs").alias("runs"))
    name = F.col("instance_id").cast("string")
    header = F.concat(F.lit("=== "), name, F.lit(" — "), "n", F.lit(" iteration(s) ===\n"))
    detail = F.when(F.col("blocks") != "", F.concat(header, "blocks")).when(F.col("runs"), F.concat(header, F.lit(WAITING))).otherwise(F.concat(F.lit("No event found for '"), name, F.lit("'.")))
    return rows.select("instance_id", detail.alias("detail"))
