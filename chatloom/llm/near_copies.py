"""Near copies by buckets of candidates and exact Jaccard similarity of word shingles.

Texts are sets of hashed five-word shingles. The caller gives buckets of its own (meeting points of
linked SimHash fingerprints); documents that share a band of four minimum hashes meet in a bucket too;
with 32 bands a pair of similarity 0.8 meets with probability 1 - 5e-8, a closer one more surely. Of
what meets, pairs that agree in fewer than 70 of the 128 minimum hashes are no near copies (one of
similarity 0.8 looks so with probability 1e-9); the others are verified exactly.

First every document is compared with the smallest of each of its buckets, so a group of n copies costs
about n comparisons and is gone, from every other bucket too. Buckets of what is left are compared
whole, each in one task, if they are small; a pair that shares several bands is compared in the first.
Larger ones go on by leaders, twice as many each round, until they are small. No two documents that met
and are similar enough both survive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bitmap, materialise, pieces, texts_of

SHINGLE = 5
#: Similarity from which on two documents are near copies, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 4
#: Minimum hashes, of the 128 in the bands, in which pairs agree that are verified. Of pairs of similarity
#: 0.8, one in 10^9 agrees in fewer (Chernoff bound of the binomial tail).
LEAST_EQUAL = 70
MOST_LEADERS = 64
#: Rows, and shingles in all of them, of the buckets that one task compares whole.
SMALL_ROWS, SMALL_SHINGLES = 2048, 1 << 22
#: A leader that more pairs than this ask for is sent out in several copies.
PAIRS_PER_COPY = 500
#: Size of the filter that tells whose shingles are needed (2 MB); its hits are joined exactly.
FILTER_BITS = 1 << 24

_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """A key of the words and the distinct shingle hashes of each text (all words, where there are
    fewer than ``shingle``; no words: no hashes). Words are lower-cased in ASCII."""
    docs = [b" ".join(t.lower().split()) for t in texts]
    full = [d for d in docs if d]
    if full:
        words = WordHashes(full)
        hashes = words.sequences(shingle)
        ends = np.append(words.first[1:], len(words.doc))
        bounds = iter(zip(words.first.tolist(), ends.tolist(), strict=True))
    for d in docs:
        found = np.zeros(0, np.uint64)
        if d:
            a, b = next(bounds)
            found = np.unique(hashes[a : b - shingle + 1]) if b - a >= shingle else np.array([xxhash.xxh64_intdigest(d)], np.uint64)
        yield xxhash.xxh64_intdigest(d) - (1 << 63), found


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The bands of each set: 16 bits of four minimum hashes each. Sets without hashes share theirs."""
    filled = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    size = np.array([len(s) for s in filled])
    values, first = np.concatenate(filled), np.cumsum(size) - size
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    for at, m in enumerate(_MULTIPLIERS):
        out[:, at] = np.minimum.reduceat((values ^ (m >> np.uint64(7))) * m, first) >> np.uint64(24) & np.uint64(0xFFFF)
    return out.view(np.int64)


def _fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """i, v (hash of the text), node (key of its words), n (number of shingles), fp, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            found = list(shingle_sets(texts_of(batch, "t"), shingle))
            buckets = bands([s for _, s in found])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, BANDS), pa.int32()), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("v"), pa.array([k for k, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([_fingerprint(s) for _, s in found], pa.int64()), lists], names=["i", "v", "node", "n", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"i {kind}, v long, node long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node and its shingles for the ``rows`` (i, v) that stand for nodes (and a few others).

    A bitmap of fixed size tells the rows, so no text is shuffled; a fuller one only lets more pass.
    """
    bit = F.xxhash64("i", "v").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(rows.select(bit), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            wanted = batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for piece in pieces(iter([wanted]), "t"):
                found = [(k, s) for k, s in shingle_sets(texts_of(piece, "t"), shingle) if not (k in seen or seen.add(k))]
                values = pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), values], names=["node", "shingles"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))
    return materialise(source.select(bit, "t").mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")


def _bucket(band: Column, value: Column) -> Column:
    """A hash of the value, with the number of the band in the lowest bits; ``BANDS`` stands for the caller's."""
    return F.shiftleft(F.xxhash64(value), 6).bitwiseOR(band.cast("long"))


def _agreeing(total: Column, differ: Column) -> Column:
    """``total`` and the number of minimum hashes of a band without a bit in ``differ``."""
    for i in range(ROWS):
        total = total + (F.shiftright(differ, 16 * i).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
    return total


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b), with i and v of both, in which b comes first, whose sizes allow the similarity
    and whose bands agree in ``LEAST_EQUAL`` minimum hashes or more."""
    part, whole = SIMILARITY
    ours = nodes.select(F.col("node").alias("a"), F.col("i").alias("ai"), F.col("v").alias("av"), F.col("n").alias("an"), F.col("bands").alias("ours"))
    theirs = nodes.select(F.col("node").alias("b"), F.col("i").alias("bi"), F.col("v").alias("bv"), F.col("n").alias("bn"), F.col("bands").alias("theirs"))
    both = pairs.join(ours, "a").join(theirs, "b").where(F.struct("ai", "a") > F.struct("bi", "b"))
    both = both.where(F.least("an", "bn") * whole >= F.greatest("an", "bn") * part)
    differ = F.zip_with("ours", "theirs", lambda x, y: x.bitwiseXOR(y))
    return both.where(F.aggregate(differ, F.lit(0), _agreeing) >= LEAST_EQUAL).select("a", "ai", "av", "b", "bi", "bv")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough. Leaders b that many ask for are salted."""
    part, whole = SIMILARITY
    copies = materialise(pairs.groupBy("b").agg(F.count("*").alias("asked")).select("b", (F.col("asked") / PAIRS_PER_COPY).cast("int").alias("last")), "leaders")
    leaders = sets.withColumnRenamed("node", "b").withColumnRenamed("shingles", "theirs").join(copies, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    asked = pairs.select("a", "b").join(copies, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("last") + 1).cast("int")).drop("last")
    met = asked.join(sets.withColumnRenamed("node", "a"), "a").join(leaders, ["b", "salt"])
    both = F.size(F.array_intersect("shingles", "theirs"))
    return met.where(both * (part + whole) >= part * (F.size("shingles") + F.size("theirs"))).select("a")


def _copies_in(rows: pa.Table) -> pa.Table:
    """node of the rows of one bucket (bucket, node, i, bands, shingles) that are similar to one before them.

    A pair that meets in several bands is compared in the first of them only. Rows that stand for one
    node more than once (a repeated document, read by several tasks) are not compared with each other."""
    part, whole = SIMILARITY
    rows = rows.sort_by([("i", "ascending"), ("node", "ascending")])
    band = rows.column("bucket")[0].as_py() & 63
    values = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    hashes, nodes = values.view(np.uint16), rows.column("node").to_numpy()
    sets = [x.values.to_numpy() for x in rows.column("shingles")]
    size = np.array([len(s) for s in sets])
    gone = np.zeros(len(sets), bool)
    for at in range(1, len(sets)):
        fits = (nodes[:at] != nodes[at]) & (np.minimum(size[:at], size[at]) * whole >= np.maximum(size[:at], size[at]) * part)
        near = np.flatnonzero(fits & ((hashes[:at] == hashes[at]).sum(1) >= LEAST_EQUAL))
        shared = values[near] == values[at]
        first = np.where(shared.any(1), shared.argmax(1), BANDS)
        for other in near[first == band].tolist():
            both = len(np.intersect1d(sets[at], sets[other], assume_unique=True))
            if both * (part + whole) >= part * (size[at] + size[other]):
                gone[at] = True
                break
    return rows.select(["node"]).filter(pa.array(gone))


def near_copies(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """i and v (xxhash64 of the text) of rows that are near copies of a row with a smaller id, so many that
    no two near copies that met are left. A near copy of gone rows only may be left.

    ``groups`` gives further buckets (node, bucket) of nodes (node, fp: the SimHash of its shingles).

    Texts of equal words (null and empty ones too) are copies whatever their length. Rows with a null
    id neither go nor make others go. Rows that repeat an id go only where they copy a smaller id's.
    """
    prints = materialise(_prints(docs, id_col, text_col, shingle), "shingle-prints")
    first = F.min(F.struct("i", "v")).alias("x")
    nodes = materialise(prints.groupBy("node").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("node", "x.i", "x.v", "n", "fp", "bands"), "shingle-nodes")
    own = materialise(groups(nodes.select("node", "fp")).select("node", _bucket(F.lit(BANDS), F.col("bucket")).alias("bucket")), "groups")
    in_bands = nodes.select("node", "i", F.posexplode("bands").alias("band", "value")).select("node", "i", _bucket(F.col("band"), F.col("value")).alias("bucket"))
    members = in_bands.unionByName(own.join(nodes.select("node", "i"), "node"))
    # Written first, so that its true size tells how to join: few buckets are shared.
    lead = members.groupBy("bucket").agg(F.min(F.struct("i", "node")).alias("x"), F.count("*").alias("held")).where("held > 1")
    lead = materialise(lead.select("bucket", F.array("x.node").alias("leaders")), "lead")
    members = in_bands.select("node", "bucket").unionByName(own)
    gone, leaders = [], 1
    while True:
        live = materialise(members.join(lead, "bucket").select("bucket", "node", "leaders"), "live")
        pairs = live.select(F.col("node").alias("a"), F.explode("leaders").alias("b")).where("a != b").distinct()
        pairs = materialise(_alike(pairs, nodes), "alike")
        needed = pairs.select(F.col("ai").alias("i"), F.col("av").alias("v")).union(pairs.select("bi", "bv"))
        gone.append(materialise(_similar(pairs, _sets(docs, needed, id_col, text_col, shingle)).select(F.col("a").alias("node")).distinct(), "lost"))
        left = live.where(~F.array_contains("leaders", F.col("node"))).select("bucket", "node").join(gone[-1], "node", "left_anti")
        left = materialise(left.join(nodes.select("node", "i", "v", "n"), "node"), "left")
        held = left.groupBy("bucket").agg(F.count("*").alias("held"), F.sum("n").alias("shingles")).where("held > 1")
        held = materialise(held.select("bucket", ((F.col("held") <= SMALL_ROWS) & (F.col("shingles") <= SMALL_SHINGLES)).alias("small")), "held")
        small = materialise(left.join(held.where("small"), "bucket", "left_semi"), "small")
        sets = _sets(docs, small.select("i", "v"), id_col, text_col, shingle)
        whole = small.select("bucket", "node", "i").join(nodes.select("node", "bands"), "node").join(sets, "node").select("bucket", "node", "i", "bands", "shingles")
        gone.append(materialise(whole.groupBy("bucket").applyInArrow(_copies_in, "node long").distinct(), "lost"))
        members = materialise(left.join(held.where("not small"), "bucket", "left_semi").join(gone[-1], "node", "left_anti"), "large")
        if not members.limit(1).count():
            break
        # A limit on the rank is applied before the shuffle, so hot buckets send their leaders only.
        leaders = min(2 * leaders, MOST_LEADERS)
        order = Window.partitionBy("bucket").orderBy("i", "node")
        lead = materialise(members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders).groupBy("bucket").agg(F.collect_list("node").alias("leaders")), "lead")
        members = members.select("node", "bucket")
    out = reduce(DataFrame.unionByName, gone).distinct().withColumn("gone", F.lit(True))
    heads = materialise(nodes.select("node", F.col("i").alias("head")).join(out, "node", "left"), "heads")
    return prints.select("i", "v", "node").join(heads, "node").where(F.coalesce("gone", F.lit(False)) | (F.col("i") != F.col("head"))).select("i", "v").distinct()


def keep_first(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_copies`` leaves.

    A bitmap of fixed size tells which rows may be gone; only these are joined, so the texts of the
    others are not shuffled. A fuller one only lets more rows into the join.
    """
    gone = materialise(near_copies(docs, groups, id_col, text_col, shingle), "near-copies")
    mask = F.lit(FILTER_BITS - 1)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("i", "v").bitwiseAND(mask).alias("bit")), FILTER_BITS))

    def set_at(at: pd.Series) -> pd.Series:
        return pd.Series((bits.value[at.to_numpy() >> 3] >> (at.to_numpy() & 7).astype(np.uint8) & 1).astype(bool))

    maybe = F.pandas_udf(set_at, "boolean")(F.xxhash64(docs[id_col], F.xxhash64(docs[text_col])).bitwiseAND(mask))
    match = (docs[id_col] == gone["i"]) & (F.xxhash64(docs[text_col]) == gone["v"])
    return docs.where(~maybe).union(docs.where(maybe).join(gone, match, "left_anti").select(docs.columns))
