"""Sessions and commands: what each poll delivers, and what an input line means."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parameters of the known event commands, with type and default.
SIGNATURES = {
    "timer": (("interval", "double", "20.0"),),
    "file": (("path", "string", ""), ("poll_interval", "double", "2.0"), ("message", "string", "")),
    "monitor": (("command", "string", ""), ("capture_interval", "double", "60.0"), ("poll_interval", "double", "2.0"), ("timeout", "double", "30.0"), ("snapshot_path", "string", ""), ("message", "string", "")),
    "loop": (("goal", "string", ""), ("max_iterations", "long", "0"), ("state_file", "string", "loop_state.json")),
    "project": (("goal", "string", ""), ("state_file", "string", "project_state.json")),
    "schedule": (("message", "string", ""), ("when", "string", "")),
}
BUILT_IN = ("/clear", "/reset", "/help", "/events")


def drain_polls(log: DataFrame) -> DataFrame:
    """What each poll returns: sid, seq, tokens (array, only new ones), done, error; all null once the
    session is discarded. ``log``: sid, seq (unique in a session), kind (token, poll, finish, discard),
    value. The last finish counts; one without an error clears an earlier error.
    """
    order = W.partitionBy("sid").orderBy("seq")
    polls = F.count_if(F.col("kind") == "poll").over(order.rowsBetween(W.unboundedPreceding, -1))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = log.withColumns({"poll_no": F.coalesce(polls, F.lit(0)), "gone": F.count_if(F.col("kind") == "discard").over(upto) > 0})
    rows = rows.withColumn("finish", F.max(F.when((F.col("kind") == "finish") & ~F.col("gone"), F.struct("seq", "value"))).over(upto))
    token = F.when((F.col("kind") == "token") & ~F.col("gone"), F.struct("seq", "value"))
    poll = F.max(F.when(F.col("kind") == "poll", F.struct("seq", "gone", "finish")))
    each = rows.groupBy("sid", "poll_no").agg(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["value"]).alias("tokens"), poll.alias("poll")).where("poll IS NOT NULL")
    there = ~F.col("poll.gone")
    return each.select("sid", F.col("poll.seq").alias("seq"), F.when(there, F.col("tokens")).alias("tokens"), F.when(there, F.col("poll.finish").isNotNull()).alias("done"), F.when(there, F.col("poll.finish.value")).alias("error"))


def _name(text: Column) -> Column:
    """The command's name: after the slash and spaces, up to white space, lower-cased."""
    return F.lower(F.regexp_extract(text, r"^/\s*(\S+)", 1))


def classify_inputs(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds input_kind (prompt, built_in, event, unknown) and command (null for prompts).

    Built-in commands are exact, but /stop and /status count by prefix; others are events if ``known``
    (a column name) has them.
    """
    text = F.col("text")
    built_in = text.isin(*BUILT_IN) | text.startswith("/stop") | text.startswith("/status")
    rows = inputs.withColumn("_name", _name(text)).join(known.select(F.col("name").alias("_name"), F.lit(True).alias("_known")).distinct(), "_name", "left")
    slash = text.startswith("/")
    kind = F.when(~slash, "prompt").when(built_in, "built_in").when(F.col("_known"), "event").otherwise("unknown")
    return rows.withColumns({"input_kind": kind, "command": F.when(slash, F.col("_name"))}).drop("_name", "_known")


def _quoted_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def split(text: str) -> list[str]:
        try:
            return shlex.split(text)
        except ValueError:
            return text.split()

    for batch in batches:
        yield batch.map(split)


def parse_commands(inputs: DataFrame) -> DataFrame:
    """Known event commands (rows with text) with their parameters: all columns, command, params (map of
    parameter to value as text; a number that does not parse stays as it is).

    Quotes hold words together; with unbalanced quotes white space splits. Surplus words are dropped,
    missing ones take the defaults. Only texts with a quote or backslash go through Python.
    """
    rows = inputs.withColumn("command", _name(F.col("text"))).where(F.col("text").startswith("/") & F.col("command").isin(*SIGNATURES))
    args = F.regexp_extract("text", r"(?s)^/\s*\S+\s*(.*)$", 1)
    tokens = F.pandas_udf(_quoted_tokens, "array<string>")
    plain = F.filter(F.split(args, r"\s+"), lambda x: x != "")
    needs = args.rlike(r"[\"'\\]")
    rows = rows.withColumn("tokens", F.when(needs, tokens(F.when(needs, args).otherwise(""))).otherwise(plain))

    def value(i: int, kind: str, default: str) -> Column:
        word = F.try_element_at("tokens", F.lit(i + 1))
        number = F.coalesce(word.try_cast(kind).cast("string"), word) if kind != "string" else word
        return F.coalesce(number, F.lit(default))

    params = F.lit(None)
    for name, signature in SIGNATURES.items():
        pairs = [x for i, (p, kind, default) in enumerate(signature) for x in (F.lit(p), value(i, kind, default))]
        params = F.when(F.col("command") == name, F.create_map(*pairs)).otherwise(params)
    return rows.withColumn("params", params).drop("tokens")
