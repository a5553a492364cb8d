"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments. Two fingerprints
that differ in at most two bits have count vectors at a Manhattan distance of two at most, so the
distance of the vectors is a lower bound. The range-join works on the grid of count vectors: every
occupied cell sends itself to the grid points within distance one, and two cells within distance two
meet at such a point. A fingerprint whose cell meets no other and that is alone in its cell has no
link. Only the others are verified, again by meeting points: two fingerprints differ in at most two
bits exactly if they share a point that differs from each in at most one. What meets at a point is
linked to the smallest there, so no group is expanded to pairs; a point can hold 65 cells or 65
fingerprints at most, whatever the input, and copies were collapsed before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import materialise, pieces, texts_of

BITS = 64
SHINGLE, SEED = 3, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles, repeats included; no words: zero."""
    words = text.lower().split()  # on bytes both mean ASCII only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hashed(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    values = np.fromiter((hashed(g, SEED) for g in grams), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[part : part + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id and ``fp`` (long) of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            fp = np.array([fingerprint(t, shingle) for t in texts_of(batch, "t")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _cell(fp: Column) -> Column:
    """The bit count of every two-bit segment, each in its own two bits."""
    one = F.lit(0x5555555555555555)
    even, odd = fp.bitwiseAND(one), F.shiftrightunsigned(fp, 1).bitwiseAND(one)
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # their sum, without a carry


def _near_cells() -> Column:
    """The grid points within Manhattan distance one of ``cell``; counts stay within 0 and 2."""
    count = "(shiftrightunsigned(cell, 2 * i) & 3L)"
    low = f"transform(sequence(0, 31), i -> if({count} < 2, cell ^ shiftleft(1L, 2 * i), null))"  # between 0 and 1
    high = f"transform(sequence(0, 31), i -> if({count} > 0, cell ^ shiftleft(3L, 2 * i), null))"  # between 1 and 2
    return F.expr(f"array_compact(concat(array(cell), {low}, {high}))")


def _met(distinct: DataFrame) -> DataFrame:
    """Each point that differs in one bit or none from several of the ``distinct`` fingerprints: point, fps.

    The few bytes of the cells are dealt out before each becomes up to 65 rows, which a size-based plan
    would leave to one or two tasks."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = distinct.groupBy(_cell(F.col("fp")).alias("cell")).agg(F.count("*").alias("n")).repartition(tasks, "cell")
    met = cells.withColumn("point", F.explode(_near_cells())).groupBy("point").agg(F.collect_list("cell").alias("cells"), F.sum("n").alias("n"))
    live = met.where(F.col("n") > 1).select(F.explode("cells").alias("cell")).distinct()
    kept = distinct.withColumn("cell", _cell(F.col("fp"))).join(live, "cell", "left_semi").select("fp")
    points = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    groups = kept.withColumn("point", F.explode(points)).groupBy("point").agg(F.collect_list("fp").alias("fps"))
    return groups.where(F.size("fps") > 1)


def links(distinct: DataFrame) -> DataFrame:
    """Links among distinct fingerprints that differ in two bits or fewer.

    ``distinct``: a column fp (long), each value once. Returns pairs (a, b), b < a as signed numbers,
    enough to connect whatever is linked: at each meeting point all others are tied to the smallest.
    """
    groups = _met(distinct)
    near = groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
    return near.where(F.col("a") != F.col("b")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from every node that has an edge: node, root.

    ``edges``: a, b (long). Rounds of: each node takes the smallest label among its neighbours', then
    the label of that label (pointer jumping), until nothing changes. Each round is written to the
    shared folder; only the number of changes comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("best"))
        best = label.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", "best").alias("mid"))
        best = materialise(best, "best")
        jump = best.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        label = materialise(best.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("root"), (F.least("mid", "far") != F.col("old")).alias("moved")), "labels")
        if not label.where("moved").limit(1).count():
            return label.select("node", "root")
        label = label.drop("moved")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id, fp (long) and component_id (the smallest id reachable by links) of every row.

    Null texts count as empty; texts without words have fingerprint zero and are linked like others.
    Rows with a null id take part in the linking but never name a component; a component of such rows
    only has a null id. Repeated rows each get a row. Other columns are ignored. An empty table gives
    an empty table.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "fingerprints")
    first = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    root = components(links(first.select("fp")))
    rooted = materialise(root.join(first.withColumnRenamed("fp", "node"), "node").select(F.col("node").alias("fp"), "root", "first"), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = rooted.join(smallest, "root").select("fp", "smallest")
    known = materialise(first.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")), "components")
    return prints.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = near_copies.SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of two near copies that meet the later one goes, in the
    order of ids, if the earlier one is compared with it.

    A row that is gone is compared no more, so in a chain of drifting texts a row that is like none but gone
    ones may stay, and which of these do depends on the buckets; no two near copies that met both stay. Near copies share four in five or more of their different ``shingle``-word shingles (Jaccard 0.8).
    The meeting points of fingerprints that the grid range-join links are candidates, and so are, since that
    similarity leaves some ten of 64 bits different and no grid of fingerprints reaches so far, the
    buckets of MinHash bands (see ``near_copies``); each candidate is verified exactly. Each row goes or
    stays by its own text, also where ids repeat. Null and empty texts are copies of one another; rows
    with a null id stay.
    """
    return near_copies.keep_first(docs, _groups, id_col, text_col, shingle)


def _groups(nodes: DataFrame) -> DataFrame:
    """node and a bucket for its fingerprint and for each point where that meets others, of nodes (node, fp)."""
    distinct = materialise(nodes.select("fp").distinct(), "distinct-fingerprints")
    points = materialise(_met(distinct).select("point", F.explode("fps").alias("fp")), "points")
    return nodes.select("node", F.col("fp").alias("bucket")).unionByName(nodes.join(points, "fp").select("node", F.col("point").alias("bucket")))
