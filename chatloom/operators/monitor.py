"""Watching: framed captures of commands and sampled file times, and where they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_captures(captures: DataFrame, timeout: float = 30.0) -> DataFrame:
    """Adds frame to captures (exit_code, stdout, stderr, and optionally status: ok, timeout, failed).

    A failed spawn has a null frame; a timeout has exit code -1 and a note at the end of stderr.
    """
    status = F.col("status") if "status" in captures.columns else F.lit("ok")
    code = F.when(status == "timeout", F.lit(-1)).otherwise(F.col("exit_code"))
    note = F.when(status == "timeout", F.lit(f"[monitor] command timed out after {timeout:g}s\n")).otherwise("")
    errors = F.concat(F.coalesce("stderr", F.lit("")), note)
    frame = F.concat(F.lit("exit_code: "), code.cast("string"), F.lit("\n--stdout--\n"), F.coalesce("stdout", F.lit("")), F.when(errors != "", F.concat(F.lit("\n--stderr--\n"), errors)).otherwise(""))
    return captures.withColumn("frame", F.when(status != "failed", frame))


def detect_changes(captures: DataFrame, key: str = "monitor_id", order: str = "ts") -> DataFrame:
    """Captures (key, order, frame) whose SHA-256 differs from the one before: key, order, hash,
    previous_hash. The first capture is the baseline; null frames are skipped.

    Only hashes are shuffled; join the text back for the rows that changed.
    """
    rows = captures.where(F.col("frame").isNotNull()).select(key, order, F.sha2("frame", 256).alias("hash"))
    before = F.lag("hash").over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("previous_hash", before).where("hash <> previous_hash")


def file_changes(stats: DataFrame, poll_seconds: int = 2, origin: Column | None = None) -> DataFrame:
    """Changes of a file's time as seen by polling: path, bucket, mtime, previous_mtime.

    ``stats``: path, ts, mtime (null: missing, counts as 0). Of several samples within one poll interval
    the last counts; either direction is a change; the first poll is the baseline.
    """
    start = F.lit(0) if origin is None else F.unix_timestamp(origin)
    bucket = F.floor((F.unix_timestamp("ts") - start) / poll_seconds)
    polls = stats.groupBy("path", bucket.alias("bucket")).agg(F.max_by(F.coalesce("mtime", F.lit(0.0)), "ts").alias("mtime"))
    before = F.lag("mtime").over(W.partitionBy("path").orderBy("bucket"))
    return polls.withColumn("previous_mtime", before).where("mtime <> previous_mtime")
