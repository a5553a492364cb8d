"""Blocks of vectors: what the two searches over embeddings share.

Queries and rows are packed into blocks (binary columns of fixed-width values). Row blocks are dealt
over a fixed number of shards and every block of queries is sent to each shard, so what is shuffled
stays in proportion to the input: the rows once, the queries ``SHARDS`` times. In a shard the join streams
pairs of blocks; a task holds one pair and the best found so far for a bounded number of query blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 32
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Most values (rows times dimensions) of a sample that a model is fitted on, and its most rows.
SAMPLE_VALUES, SAMPLE_ROWS = 1 << 21, 1 << 14
#: Query blocks whose results a task holds before it passes them on.
HELD = 16


def usable(vec: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of doubles; those with fewer than ``dim`` components are filled up with zeros."""
    size = np.diff(vecs.offsets.to_numpy())
    values = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = values
    return out


def sample(rows: DataFrame, dim: int) -> np.ndarray:
    """At most ``SAMPLE_ROWS`` vectors, those of the smallest hashes of their ids: a bounded sample."""
    n = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").toArrow().column("vec").combine_chunks()
    return matrix(got, dim) if len(got) else np.zeros((0, dim))


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` consecutive rows: block (a number), n, shard, and every column's values as one binary.

    ``rows`` has columns of type long and binaries of one width. No shuffle; a task's last block is shorter.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, task = [], 0, TaskContext.get().partitionId()
        block = task << 32

        def out(part: pa.Table) -> pa.RecordBatch:
            packed = [part.column(c).to_numpy().tobytes() if pa.types.is_int64(part.schema.field(c).type) else b"".join(part.column(c).to_pylist()) for c in names]
            values = [[block], [part.num_rows], [(block + task) % SHARDS], *([p] for p in packed)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * len(names)], strict=True)], names=["block", "n", "shard", *names])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                whole = pa.Table.from_batches(held)
                yield out(whole.slice(0, size))
                held, count, block = whole.slice(size).to_batches(), count - size, block + 1
        if count:
            yield out(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "block long, n int, shard int, " + ", ".join(f"{c} binary" for c in names))


def each_pair(queries: DataFrame, rows: DataFrame, fold: Callable[[dict], object], schema: str) -> DataFrame:
    """All blocks of ``queries`` against all of ``rows``: ``fold(query columns)`` makes the state of a query
    block, ``state.meet(row columns)`` adds a block of rows, ``state.rows()`` gives a record batch of results.

    A query block gives results once for each task that meets it, or more often where a task meets more
    than ``HELD`` blocks in turn; the caller joins them.
    """
    sent = queries.drop("shard").select(*(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "shard"), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"))
    met = sent.join(rows, "shard").drop("shard")
    ours = [c for c in queries.columns if c != "shard"]
    theirs = [c for c in rows.columns if c != "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.column("q_block")[at].as_py()
                if block not in states:
                    if len(states) == HELD:
                        for old in states.values():
                            yield old.rows()
                        states.clear()
                    states[block] = fold({c: batch.column(f"q_{c}")[at] for c in ours})
                states[block].meet({c: batch.column(c)[at] for c in theirs})
        for old in states.values():
            yield old.rows()

    return met.mapInArrow(run, schema)


def values(packed: pa.Scalar, kind: str, width: int = 0) -> np.ndarray:
    """The values of a packed column; with a width, as rows of so many."""
    found = np.frombuffer(packed.as_buffer(), kind)
    return found.reshape(-1, width) if width else found


def to_rows(rows: DataFrame, dim: int, make: Callable[[np.ndarray], list[pa.Array]], columns: str) -> DataFrame:
    """``rows`` without vec, and the ``columns`` (DDL) that ``make`` gives for the matrix of their vectors."""
    kept = [c for c in rows.columns if c != "vec"]
    names = kept + [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = make(matrix(batch.column("vec"), dim))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=names)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, {columns}")
