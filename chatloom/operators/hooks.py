"""Plug-in points: user functions over tables, with errors caught per row.

User functions run in Arrow batches (pandas); none of them can fail a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import INLINE_CHARS, SUMMARY_CHARS
from .monitor import frame_captures
from .routing import PROMPT_END, prompts_in_parts, select_routed

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def merged_summaries(excerpts: DataFrame, merge_fn: Callable[[str, str], str], inline_chars: int = INLINE_CHARS, cap: int = SUMMARY_CHARS) -> DataFrame:
    """The rolling summary with a real merge function: conv_id, xid, excerpt, summary, branch.

    Short excerpts are appended, the first long one seeds, others are merged by
    ``merge_fn(existing, excerpt)``; if that fails, they are appended. Conversations are sorted by Spark, which
    spills, and folded as their rows stream by in Arrow batches; a task holds one batch and one summary,
    so a conversation may be of any length.
    """
    rows = excerpts.where(F.col("excerpt") != "").select("conv_id", "xid", "excerpt")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, summary = object(), ""
        for batch in batches:
            out = []
            for conv_id, excerpt in zip(batch.column("conv_id").to_pylist(), batch.column("excerpt").to_pylist(), strict=True):
                if conv_id != conversation:
                    conversation, summary = conv_id, ""
                appended = (f"{summary}\n{excerpt}" if summary else excerpt)[-cap:]
                if len(excerpt) < inline_chars:
                    branch, summary = "inline", appended
                elif not summary:
                    branch, summary = "seed", excerpt[:cap]
                else:
                    branch = "merge"
                    try:
                        summary = merge_fn(summary, excerpt)
                    except Exception:  # whatever the user's function raises
                        summary = appended
                out.append((summary, branch))
            summaries, branches = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(summaries, pa.string()), pa.array(branches, pa.string())], names=["conv_id", "xid", "excerpt", "summary", "branch"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "xid")
    return ordered.mapInArrow(fold, f"conv_id {kinds['conv_id']}, xid {kinds['xid']}, excerpt string, summary string, branch string")


def _per_row(fn: Callable[..., str], failed: Callable[[Exception], str | None], *columns: str) -> Callable[[Iterator[tuple]], Iterator[pd.Series]]:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            series = batch if isinstance(batch, tuple) else (batch,)
            out = []
            for values in zip(*series, strict=True):
                try:
                    out.append(fn(*values))
                except Exception as error:  # whatever the user's function raises
                    out.append(failed(error))
            yield pd.Series(out, dtype=object)

    return run


def _bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "32m")


def routed(prompts: DataFrame, route_fn: Callable[[str], str], catalog: DataFrame) -> DataFrame:
    """Items that a classifier selects for prompts (turn_id, domain, routing_prompt); if it fails, all.

    A prompt holds its domain's catalog and may have megabytes, so batches are bounded by bytes too
    (a setting of the session, unless it has one)."""
    _bound_batches(prompts.sparkSession)
    inner = _per_row(lambda p: str(route_fn(p)), lambda _: "")

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from inner(batches)

    reply = F.pandas_udf(classify, "string")
    # kept, as names and full selections both read them: a prompt is put to the classifier once
    replies = prompts.select("turn_id", "domain", reply("routing_prompt").alias("reply")).persist(StorageLevel.DISK_ONLY)
    return select_routed(replies, catalog)


def routed_turns(turns: DataFrame, route_fn: Callable[[str], str], catalog: DataFrame) -> DataFrame:
    """``routed`` of the prompts of turns (turn_id, domain, request, summary, last_exchange).

    A prompt is put together in the Python worker that has the classifier, from its start and its domain's catalog, which the worker
    gets once for many turns: Spark's rows, queues and batches never hold prompts. One prompt at a time is in memory."""
    _bound_batches(turns.sparkSession)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = ""
        for batch in batches:
            ids, domains, replies = [], batch.column("domain"), []
            for i, (start, text) in enumerate(zip(batch.column("start"), batch.column("catalog_text"), strict=True)):
                if text.is_valid:
                    end = text.as_py() + PROMPT_END
                    continue
                ids.append(i)
                try:
                    replies.append(str(route_fn(start.as_py() + end if start.is_valid else None)))
                except Exception:  # whatever the user's function raises
                    replies.append("")
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("turn_id").take(at), domains.take(at), pa.array(replies, pa.string())], names=["turn_id", "domain", "reply"])

    parts = prompts_in_parts(turns, catalog)
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    replies = parts.mapInArrow(classify, f"turn_id {kinds['turn_id']}, domain {kinds['domain']}, reply string").persist(StorageLevel.DISK_ONLY)
    return select_routed(replies, catalog)


def call_tools(calls: DataFrame, tools: dict[str, Callable[..., str]]) -> DataFrame:
    """Adds result to calls (name, arguments): what the tool returns as text, or ``[Tool Error] …``."""
    import json

    def call(name: str, arguments: str | None) -> str:
        return str(tools[name](**(json.loads(arguments) if arguments else {})))

    inner = _per_row(call, lambda e: f"[Tool Error] {type(e).__name__}: {e}")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from inner(batches)

    known = F.col("name").isin(*tools) if tools else F.lit(False)
    wrapped = F.pandas_udf(run, "string")
    missing = F.concat(F.lit("Error: Tool '"), "name", F.lit("' not found."))
    return calls.withColumn("result", F.when(known, wrapped("name", F.when(known, F.col("arguments")))).otherwise(missing))


def captured(sources: DataFrame, capture_fn: Callable[..., str | None], key: str = "command", *more: str) -> DataFrame:
    """Frames of a custom capture function of the columns key, ``more``…; rows whose capture is None or
    fails are skipped."""
    inner = _per_row(capture_fn, lambda _: None)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from inner(batches)

    def run_more(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from inner(batches)

    rows = sources.withColumn("stdout", F.pandas_udf(run_more if more else run, "string")(key, *more)).where("stdout IS NOT NULL")
    return frame_captures(rows.withColumns({"exit_code": F.lit(0), "stderr": F.lit("")}))


def fire_events(df: DataFrame, predicate: Column, message: Column) -> DataFrame:
    """Rows for which a user's condition holds, with fired_message and notify_only (no message)."""
    fired = df.where(predicate).withColumn("fired_message", F.coalesce(message, F.lit("")))
    return fired.withColumn("notify_only", F.col("fired_message") == "")
