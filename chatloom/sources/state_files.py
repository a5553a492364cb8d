"""State files as a stream: files of a glob that are rewritten in place become rows in order of their times.

Spark's file stream takes each path once, so a file that changes would be read once only. Here a clock (see
``polls``) drives polls: each looks through the glob and adds what has changed to a log, one folder a
poll, which a file stream reads on. Only files that may have changed are read: their times are
compared while files are listed. A poll that runs again replaces its own folder; rows that it repeats are
known by instance and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.sources.polls import Polls

SCHEMA = "instance_id string, seq bigint, payload string"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, glob: str) -> DataFrame:
    """The files of ``glob``, a row each. Folders are listed by as many tasks as there are cores to fill: by Spark's setting each of the
    first ten thousand would have a task of its own, at every poll."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.text(glob, wholetext=True, recursiveFileLookup=True)
    finally:
        spark.conf.set(LISTING, before)


def log_changes(spark: SparkSession, glob: str, log: str, number: int, instance: Column | None = None, slack_ms: int = 600_000) -> None:
    """Poll ``number``: adds the files of ``glob`` (or of a folder and those below it) that are new or newer than the log has them.

    ``instance``: the instance's id, of ``_metadata.file_path`` if not that itself. Files older than the newest of the log by more than
    ``slack_ms`` (machines whose clocks differ, copies that keep a time) are not looked at.
    """
    seen = spark.createDataFrame([], "instance_id string, seq bigint")
    if number:
        before = spark.read.schema(f"{SCHEMA}, poll bigint").parquet(log).where(F.col("poll") < number)
        seen = before.groupBy("instance_id").agg(F.max("seq").alias("seen"))
    newest = seen.agg(F.max(F.col(seen.columns[1]))).first()[0]
    files = _listed(spark, glob)
    if newest is not None:
        files = files.where(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(newest - slack_ms)))
    rows = files.select((F.col("_metadata.file_path") if instance is None else instance).alias("instance_id"), F.unix_millis("_metadata.file_modification_time").alias("seq"), F.col("value").alias("payload"))
    rows = rows.join(seen.toDF("instance_id", "seen"), "instance_id", "left").where(F.coalesce(F.col("seq") > F.col("seen"), F.lit(True))).drop("seen")
    rows.write.mode("overwrite").parquet(f"{log}/poll={number}")


def follow(spark: SparkSession, glob: str, log: str, checkpoint: str, instance: Column | None = None, trigger: dict | None = None, **clock: object):
    """A running stream of polls of ``glob`` into ``log``. ``clock``: the options of ``Polls``; ``trigger``: of
    the stream, by default as often as there are ticks."""
    spark.dataSource.register(Polls)
    ticks = spark.readStream.format(Polls.name()).options(**clock).load()
    writer = ticks.writeStream.foreachBatch(lambda _, number: log_changes(spark, glob, log, number, instance)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log as a stream: instance_id, seq, payload. Polls that come later are found as well."""
    return spark.readStream.schema(SCHEMA).parquet(f"{log}/poll=*")
