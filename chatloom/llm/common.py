"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master uses a temporary folder of this process; on a cluster that is an
    error, as each machine would write to a disk of its own.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="chatloom-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, lets several readers share one
    computation, and gives the planner the true size, so that it broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold``.

    ``group_bytes``: for rows of megabytes, of which Parquet's writer takes a hundred before it looks at their size and its
    reader a whole row group at once. Then it looks after each row, and ends row groups at so many bytes.
    """
    path = new_path(df.sparkSession, name)
    options = {} if group_bytes is None else {"parquet.block.size": str(group_bytes)} | {f"parquet.{x}.size.row.check.min": "1" for x in ("block", "page")}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """For what runs within: Arrow batches on their way to Python end at ``size`` bytes (one row at least). Spark keeps each
    batch several times outside the heap while it fills and travels; by its setting it may have 64 MB."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


#: Bits of one page of Spark's bitmap aggregates.
_PAGE_BITS = 1 << 15


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """Bytes with a bit set for every number in the column ``bit`` (from 0, below ``size``).

    Spark's bitmap aggregates build it page by page; ``size`` is all that comes to the driver.
    """
    at = F.col("bit") + 1
    pages = bits.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(-(-size // _PAGE_BITS) * (_PAGE_BITS // 8), np.uint8)
    for row in pages.toLocalIterator():
        start = (row["page"] - 1) * (_PAGE_BITS // 8)
        out[start : start + _PAGE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``limit`` bytes of text (one row at least).

    It bounds the memory of a Python worker; every row is passed on whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker lives on for other stages


def texts_of(batch: pa.RecordBatch, text_col: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is the empty text."""
    return [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Hashes of word sequences of many documents at once.

    ``docs`` are words joined by single spaces, one word at least each. ``begin`` and ``end`` are the
    byte bounds of each word in ``text``, ``doc`` its document number, ``first`` the number of each
    document's first word. Equal sequences have equal hashes, wherever they stand.
    """

    def __init__(self, docs: list[bytes]):
        self.text = b" ".join(docs)
        raw = np.frombuffer(self.text, np.uint8)
        space = np.flatnonzero(raw == 32)
        self.begin, self.end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(raw)]])
        count = np.array([d.count(b" ") + 1 for d in docs])
        self.doc = np.repeat(np.arange(len(docs)), count)
        self.first = np.cumsum(count) - count
        terms = (raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw))
        self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self._inverse = _powers(pow(_BASE, -1, 1 << 64), len(raw))

    def sequences(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; also across documents, which the caller leaves out."""
        if n > len(self.begin):
            return np.zeros(0, np.uint64)
        low, high = self.begin[: len(self.begin) - n + 1], self.end[n - 1 :]
        h = (self._prefix[high] - self._prefix[low]) * self._inverse[low]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))
