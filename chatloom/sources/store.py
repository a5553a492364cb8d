"""The latest row of every key as a log-structured store, written by batches and read at the cost of live keys.

Under a path that all machines share:

* ``delta/batch=N``: the last row of each key of batch N. A batch that runs again replaces its own.
* ``base/version=V``: the last row of each key of all batches up to some number.
* ``manifest/version=V``: one row, (upto, rows): the base of that version counts, with all batches after ``upto``.

A compaction joins base and deltas to a new base and then writes its manifest. Until that stands, the
former version counts with its deltas, so a crash at any point loses nothing and leaves at most a base
without a manifest, which the next compaction overwrites. What no version needs any more goes, but
for the former version, which readers may still be at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestStore:
    """``keys`` (columns), ``order`` (what makes a row later than another of its key) and the ``schema`` (DDL) of rows.

    ``most_deltas``: batches after which a compaction is due; it is due earlier when the deltas hold more rows
    than the base times ``share``. So a reader meets at most (1 + ``share``) rows for each live key, and the rows
    that compactions write stay in proportion to those that came.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema: str, most_deltas: int = 50, share: float = 1.0):
        self.spark, self.path, self.keys, self.order, self.schema = spark, path.rstrip("/"), keys, order, schema
        self.most_deltas, self.share = most_deltas, share
        self.columns = spark.createDataFrame([], schema).columns

    def _folder(self, *parts: object):
        """The Hadoop file system and path of a part of the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *map(str, parts))))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _numbers(self, part: str, name: str) -> list[int]:
        """The numbers of the finished folders ``name=N`` of a part: those with Spark's mark of success."""
        files, path = self._folder(part)
        if not files.exists(path):
            return []
        there = [x.getPath().getName() for x in files.listStatus(path)]
        return sorted(int(x.split("=")[1]) for x in there if x.startswith(f"{name}=") and files.exists(self._folder(part, x, "_SUCCESS")[1]))

    def version(self) -> tuple[int, int, int]:
        """The version that counts, the last batch in its base, and the base's rows; -1, -1, 0 where there is none."""
        found = self._numbers("manifest", "version")
        if not found:
            return -1, -1, 0
        row = self.spark.read.schema("upto bigint, rows bigint").parquet(f"{self.path}/manifest/version={found[-1]}").first()
        return found[-1], row.upto, row.rows

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(self.order, "_batch")).alias("_last"))
        return last.select(*(F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in self.columns))

    def _rows(self, version: int, upto: int) -> DataFrame:
        """The base's rows and those of the deltas that count with it."""
        parts = [self.spark.createDataFrame([], f"{self.schema}, _batch bigint")]
        if version >= 0:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/base/version={version}").withColumn("_batch", F.lit(-1).cast("bigint")))
        deltas = [n for n in self._numbers("delta", "batch") if n > upto]
        if deltas:
            read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/delta").parquet(*(f"{self.path}/delta/batch={n}" for n in deltas))
            parts.append(read.select(*self.columns, F.col("batch").cast("bigint").alias("_batch")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def read(self) -> DataFrame:
        """The latest row of each key. Rows of equal order: that of the later batch."""
        version, upto, _ = self.version()
        return self._latest(self._rows(version, upto))

    def put(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch, or replaces it if it is there. A batch that a base already holds changes nothing."""
        if batch <= self.version()[1]:
            return
        last = self._latest(rows.select(*self.columns).withColumn("_batch", F.lit(batch).cast("bigint")))
        last.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        if self.due():
            self.compact()

    def due(self) -> bool:
        version, upto, rows = self.version()
        deltas = [n for n in self._numbers("delta", "batch") if n > upto]
        if len(deltas) >= self.most_deltas:
            return True
        held = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/delta/batch={n}" for n in deltas)).count() if deltas else 0  # of the files' footers
        return len(deltas) > 1 and held > self.share * rows

    def compact(self) -> None:
        """Joins base and deltas to a new base, and removes what the former version did not need."""
        version, upto, _ = self.version()
        deltas = [n for n in self._numbers("delta", "batch") if n > upto]
        if not deltas:
            return
        base = f"{self.path}/base/version={version + 1}"
        self._latest(self._rows(version, upto)).write.mode("overwrite").parquet(base)
        self._commit(version + 1, deltas[-1], self.spark.read.schema(self.schema).parquet(base).count())
        self._clean(version, upto)

    def _commit(self, version: int, upto: int, rows: int) -> None:
        one = self.spark.range(1).select(F.lit(upto).cast("bigint").alias("upto"), F.lit(rows).cast("bigint").alias("rows"))
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _clean(self, version: int, upto: int) -> None:
        """Removes versions before ``version`` and the batches in its base."""
        old = [(part, f"version={n}") for part in ("manifest", "base") for n in self._numbers(part, "version") if n < version]
        for part, name in old + [("delta", f"batch={n}") for n in self._numbers("delta", "batch") if n <= upto]:
            files, path = self._folder(part, name)
            files.delete(path, True)

    def stream(self, rows: DataFrame, checkpoint: str):
        """A streaming write of ``rows`` into the store."""
        return rows.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
