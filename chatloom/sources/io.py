"""Sources and sinks: message logs, summaries, state files, skill files and transcripts.

Files are read with explicit schemas by Spark's readers, batch or stream; text rules are separate
functions on columns, so they also work on tables that hold the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import ordered_text, strip

MESSAGES = "conv_id bigint, turn bigint, role string, text string"
FRONTMATTER = r"(?s)^\s*---\s*\n(.*?)\n---\s*\n?(.*)$"


def write_files(rows: DataFrame, path: str, key: str | None = None, mode: str = "error") -> None:
    """One text file for each row (value): in a folder named by its ``key``, or, without one, all in one folder.

    Mode ``overwrite``: the files of these keys are replaced, and others stay; ``replace``: all that was there goes. Files cost by
    number, not by size, so rows are dealt out to all cores however few bytes there are.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    if key and mode == "overwrite" and (uri := _uri(rows.sparkSession, path)):
        return _replace_files(rows.select(F.col(key).cast("string").alias("key"), "value").repartition(tasks, "key"), uri, key)
    # tasks put their files in place themselves; the driver would move them one by one
    options = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "partitionOverwriteMode": "dynamic" if key and mode == "overwrite" else "static"}
    mode = "overwrite" if mode == "replace" else mode
    if key is None:
        rows.select("value").repartition(tasks).write.mode(mode).options(**options, maxRecordsPerFile="1").text(path)
    else:
        rows.select(key, "value").repartition(tasks, key).write.mode(mode).options(**options).partitionBy(key).text(path)


def _uri(spark: SparkSession, path: str) -> str | None:
    """The path in full, if it is in a store that tasks' Python workers reach as well."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    full = re.sub(r"^file:/+", "file:///", full)
    try:
        fs.FileSystem.from_uri(full)
    except (OSError, ValueError, NotImplementedError):
        return None
    return full


def _folder(key: str, value: str | None) -> str:
    """The name of a key's folder, as Spark's writers have it."""
    return f"{key}=" + ("__HIVE_DEFAULT_PARTITION__" if not value else re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda x: f"%{ord(x[0]):02X}", value))


def _replace_files(rows: DataFrame, uri: str, name: str) -> None:
    """Writes the files of ``rows`` (key, value) in their tasks: Spark's writer has the driver delete and move each folder
    that is replaced, one by one. A file is put in place whole, then what else its folder has goes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        pairs = (pair for batch in batches for pair in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True))
        for key, its in groupby(pairs, itemgetter(0)):
            folder = f"{root}/{_folder(name, key)}"
            store.create_dir(folder)
            with store.open_output_stream(part := f"{folder}/.{attempt}.tmp") as out:
                for _, value in its:
                    out.write(f"{value or ''}\n".encode())
            store.move(part, whole := f"{folder}/data.txt")
            for old in store.get_file_info(fs.FileSelector(folder)):
                if old.is_file and old.path != whole:
                    store.delete_file(old.path)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows.sortWithinPartitions("key").mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def read_messages(spark: SparkSession, path: str, kind: str = "parquet", stream: bool = False) -> DataFrame:
    """A message log; as a stream, new files are new messages."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(MESSAGES).format(kind).load(path)


def parse_summary(text: Column) -> Column:
    """The summary in a stored text; empty if it is malformed or of another version."""
    stored = F.from_json(text, "version int, summary string")
    return F.when(stored["version"] == 2, F.coalesce(stored["summary"], F.lit(""))).otherwise("")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """conv_id and summary of stored summaries, one JSON file each; the file's name, or that of its
    folder (``conv_id=…``), has the id."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", r"(?:/conv_id=(\d+)/[^/]*|/(\d+)[^/]*)$", 0)
    return files.select(F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("conv_id"), parse_summary(F.col("value")).alias("summary"))


def summary_json(summary: Column) -> Column:
    return F.to_json(F.struct(F.lit(2).alias("version"), summary.alias("summary")))


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The last summary of each conversation (conv_id, xid, summary)."""
    return summaries.groupBy("conv_id").agg(F.max_by("summary", "xid").alias("summary"))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """The last summary of each conversation, over what was there."""
    latest_summaries(summaries).write.mode("overwrite").parquet(path)


def stream_summaries(summaries: DataFrame, path: str, checkpoint: str):
    """A streaming write of summaries (conv_id, xid, summary): each micro-batch leaves the last one of
    each conversation in a folder of its number, so a batch that runs again replaces its own rows.
    ``read_summary_batches`` gives the latest of all."""

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("conv_id").agg(F.max("xid").alias("xid"), F.max_by("summary", "xid").alias("summary"))
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return summaries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_summary_batches(spark: SparkSession, path: str) -> DataFrame:
    """The last summary of each conversation (conv_id, summary) of what ``stream_summaries`` wrote."""
    rows = spark.read.schema("conv_id long, xid long, summary string, batch long").parquet(path)
    return rows.groupBy("conv_id").agg(F.max_by("summary", F.struct("batch", "xid")).alias("summary"))


def read_state_snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """State files of a glob or of a folder and those below it (whose listing is dealt out): instance_id (the file's path, so files of one name in different folders stay apart),
    seq (its time in milliseconds), payload."""
    files = spark.read.text(glob, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("instance_id"), F.unix_millis("_metadata.file_modification_time").alias("seq"), F.col("value").alias("payload"))


def parse_skills(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Skills of markdown texts: all other columns, name, description, instructions, required_tools,
    and rejected (true where the frontmatter, the name or the description is missing)."""
    head, body = (F.regexp_extract(text_col, FRONTMATTER, i) for i in (1, 2))
    lines = F.filter(F.transform(F.split(head, r"\r\n|\r|\n"), strip), lambda x: F.instr(x, ":") > 0)
    # of a repeated key the last line counts
    last = F.reverse(F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substr(x, F.instr(x, ":") + 1)).alias("v"))))
    rows = texts.withColumns({"_m": last, "_body": body, "_ok": F.col(text_col).rlike(FRONTMATTER)})

    def meta(key: str) -> Column:
        return F.try_element_at(F.filter("_m", lambda x: x["k"] == key), F.lit(1))["v"]

    tools = F.regexp_replace(F.coalesce(meta("tools"), F.lit("")), r"(?s)^\[(.*)\]$", "$1")
    required = F.filter(F.transform(F.split(tools, ","), strip), lambda x: x != "")
    rows = rows.withColumns({"name": meta("name"), "description": meta("description"), "instructions": strip(F.col("_body")), "required_tools": required})
    rejected = ~F.col("_ok") | F.col("name").isNull() | F.col("description").isNull()
    return rows.withColumn("rejected", rejected).drop("_m", "_body", "_ok", text_col)


def read_skills(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Skills of markdown files, and the files that are none."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    rows = parse_skills(files)
    return rows.where("NOT rejected").drop("rejected"), rows.where("rejected").select("file")


def render_transcripts(messages: DataFrame, speaker: str = "Agent") -> DataFrame:
    """conv_id and transcript: a block for each prompt with its reply, for each error and event.

    ``messages``: conv_id, turn, role (user, assistant, error, event), text, and event (its name) where
    there are events.
    """
    name = F.col("event") if "event" in messages.columns else F.lit("")
    block = (
        F.when(F.col("role") == "user", F.concat(F.lit("**You:** "), "text"))
        .when(F.col("role") == "assistant", F.concat(F.lit(f"**{speaker}:** "), "text"))
        .when(F.col("role") == "error", F.concat(F.lit("**Error:** "), "text", F.lit("\n")))
        .when(F.col("role") == "event", F.concat(F.lit("**◆ Event ["), name, F.lit("]:** "), "text"))
    )
    # a reply continues the block of its prompt
    joint = F.when(F.col("role") == "assistant", "\n\n").otherwise("\n\n---\n\n")
    rows = messages.withColumn("block", block).where("block IS NOT NULL").withColumn("block", F.concat(joint, "block"))
    text = F.regexp_replace(ordered_text("turn", "block", ""), r"^\n\n(---\n\n)?", "")
    return rows.groupBy("conv_id").agg(text.alias("transcript"))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """One folder for each conversation, with its transcript as text."""
    write_files(transcripts.select("conv_id", F.col("transcript").alias("value")), path, "conv_id", mode="replace")
