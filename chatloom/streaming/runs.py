"""Runs of a stream over what there is, and where they keep their files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.streaming.processors import END, closing

_own_dir: str | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``).

    Where the session names none, a local master uses a temporary folder of this process; on a cluster
    that is an error, as each machine would write to a disk of its own.
    """
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="chatloom-")
        root = _own_dir
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, as a stream takes a plain path only if
    it is a folder and a table may be one file."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def available_now(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all that is available, into a table, and returns that."""
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def until_idle(stream: DataFrame, name: str) -> DataFrame:
    """As ``available_now``, for streams with timers, which go on without input: stops after a
    micro-batch that found none."""
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        while run.isActive and not ((seen := run.lastProgress) and seen["numInputRows"] == 0):
            run.awaitTermination(0.5)
    finally:
        run.stop()
    return spark.read.schema(stream.schema).parquet(out)


def end_folder(spark: SparkSession, name: str, time: str) -> str:
    """A new folder for ``processors.closing``, without rows."""
    path = shared_path(spark, f"{name}-end")
    spark.createDataFrame([], f"{time} timestamp").write.parquet(path)
    return path


def close_input(spark: SparkSession, folder: str, time: str) -> None:
    """Puts the row into the folder that ends the input: the watermark passes all rows, and what waits is released."""
    spark.range(1).select(F.lit(END).cast("timestamp").alias(time)).write.mode("append").parquet(folder)


def run_to_end(make, stream: DataFrame, time: str, name: str) -> DataFrame:
    """The whole result of ``make(stream)``, a fold with the given ``time``, over what the stream's source holds.

    One run takes in all there is, in micro-batches; then the input is closed, and a second run from the same
    checkpoint releases what was waiting."""
    spark = stream.sparkSession
    end = end_folder(spark, name, time)
    result = make(closing(stream, time, end))
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    for closed in (False, True):
        if closed:
            close_input(spark, end, time)
        run = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
