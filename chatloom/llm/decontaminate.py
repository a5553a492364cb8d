"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of 13 words of the benchmark items (an item of fewer words is one
window). For strings of one length a shift table says, by the hash of the three words at the end of the
current position, how far the search can jump without missing an occurrence. Where the jump is zero,
the hash of the last and the first three words names the bucket of the strings that could stand here; a
position whose bucket is empty is passed over. What is left is joined with the test strings by bucket,
and the words themselves are compared.

The shift tables and the bitmap of filled buckets have a fixed size (below 4 MB), whatever the benchmark
holds, and Spark's bitmap aggregates build them: they alone are broadcast. A fuller benchmark makes jumps
shorter and leaves more to compare, nothing else changes. The test strings stay a table that Spark joins
as their size demands. No text is shuffled to find what occurs in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialise, pieces, texts_of

WINDOW, BLOCK = 13, 3
#: Slots of the shift table for whole windows, and for each shorter length; bits of the bucket map.
SLOTS, SHORT_SLOTS, BUCKETS = 1 << 20, 1 << 14, 1 << 24

#: A-Z to a-z; every ASCII character but letters and digits to a space; bytes above 127 stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MASK, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

Words = list[bytes]


def words_of(text: bytes) -> Words:
    return text.translate(_FOLD).split()


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def block(self, words: Words) -> int:
        h = 0
        for w in words:
            h = (h * _STEP + self[w]) & _MASK
        return h ^ h >> 32

    def bucket(self, words: Words, size: int) -> int:
        """Of a string: by its last and first block, and its length."""
        h = (self.block(words[-size:]) * _STEP + self.block(words[:size]) + len(words)) * _MIX & _MASK
        return h ^ h >> 29


def _tables(window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Length, block size, farthest jump, slots, and first bit in the map, of each length's shift table."""
    at = BUCKETS
    for m in range(1, window + 1):
        size = min(BLOCK, m)
        far, slots = m - size + 1, SLOTS if m == window else SHORT_SLOTS
        yield m, size, far, slots, at
        at += far * slots


def _strings(words: Words, window: int) -> Iterator[Words]:
    m = min(window, len(words))
    return (words[i : i + m] for i in range(len(words) - m + 1 if m else 0))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Searcher:
    """Finds where test strings may stand. ``bits``: the filled buckets, then for each length and jump
    the blocks that end so far before the end of a string."""

    def __init__(self, bits: bytes, window: int = WINDOW):
        import numpy as np

        self.buckets, self.hashes, self.lengths = bits[: BUCKETS // 8], _Hashes(), []
        for m, size, far, slots, at in _tables(window):
            rows = np.unpackbits(np.frombuffer(bits, np.uint8, far * slots // 8, at // 8), bitorder="little").reshape(far, slots)
            if rows[0].any():
                shift = np.full(slots, far, np.uint8)
                for jump in reversed(range(far)):
                    shift[rows[jump] > 0] = jump
                self.lengths.append((m, size, slots - 1, shift.tobytes()))

    def search(self, words: Words) -> list[tuple[int, int, int]]:
        """Bucket, start and length of each position that a test string may match."""
        found, n, block, filled = [], len(words), self.hashes.block, self.buckets
        for m, size, mask, shift in self.lengths:
            end = m
            while end <= n:
                jump = shift[block(words[end - size : end]) & mask]
                if jump:
                    end += jump
                    continue
                key = self.hashes.bucket(words[end - m : end], size)
                bit = key & (BUCKETS - 1)
                if filled[bit >> 3] >> (bit & 7) & 1:
                    found.append((_signed(key), end - m, m))
                end += 1
        return found


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t")).where("item IS NOT NULL AND t IS NOT NULL")


def test_strings(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """key, string (words joined by a space), items (array, sorted) of every distinct test string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in pieces(batches, "t", 1 << 18):
            keys, strings, items = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch, "t"), strict=True):
                for w in _strings(words_of(text), window):
                    keys.append(_signed(hashes.bucket(w, min(BLOCK, len(w)))))
                    strings.append(b" ".join(w))
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(strings, pa.binary()), pa.array(items, pa.string())], names=["key", "string", "item"])

    rows = _items(benchmark, item_col, text_col).mapInArrow(run, "key long, string binary, item string")
    return rows.groupBy("key", "string").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _searcher(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """The broadcast tables of the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tables = _Hashes(), {m: (size, slots, at) for m, size, _, slots, at in _tables(window)}
        for batch in pieces(batches, "t", 1 << 18):
            bits: set[int] = set()
            for text in texts_of(batch, "t"):
                for w in _strings(words_of(text), window):
                    m = len(w)
                    size, slots, at = tables[m]
                    bits.add(hashes.bucket(w, size) & (BUCKETS - 1))
                    bits.update(at + (m - end) * slots + (hashes.block(w[end - size : end]) & (slots - 1)) for end in range(size, m + 1))
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bit"])

    *_, (_, _, far, slots, at) = _tables(window)
    marks = _items(benchmark, item_col, text_col).select("t").mapInArrow(run, "bit long")
    return benchmark.sparkSession.sparkContext.broadcast(bitmap(marks, at + far * slots).tobytes())


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Every row's i, v (hash of the text), n_words; and of those with a hit i, v, ranges, items."""
    bits = _searcher(benchmark, item_col, item_text_col, window)
    made: list[Searcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Searcher(bits.value, window))
        for batch in pieces(batches, "t"):
            counts, found = [], []
            for text in texts_of(batch, "t"):
                words = words_of(text)
                counts.append(len(words))
                found.append([{"key": k, "start": s, "stop": s + m, "string": b" ".join(words[s : s + m])} for k, s, m in made[0].search(words)])
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("v"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["i", "v", "n_words", "found"])

    kind = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("string", pa.binary())]))
    source = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))
    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(source.mapInArrow(run, f"i {id_kind}, v long, n_words long, found array<struct<key:long,start:int,stop:int,string:binary>>"), "searched")
    places = rows.where(F.size("found") > 0).select("i", "v", F.inline("found")).distinct()
    strings = materialise(test_strings(benchmark, item_col, item_text_col, window), "test-strings")
    hits = places.join(strings, ["key", "string"])
    ranges = F.collect_set(F.struct("start", "stop")).alias("ranges")
    return rows.select("i", "v", "n_words"), materialise(hits.groupBy("i", "v").agg(ranges, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")), "hits")


def _n_hit() -> Column:
    """Words in at least one range."""
    step = "named_struct('total', x.total + greatest(0, r.stop - greatest(r.start, x.last)), 'last', greatest(x.last, r.stop))"
    return F.expr(f"coalesce(aggregate(array_sort(ranges), named_struct('total', 0, 'last', 0), (x, r) -> {step}, x -> cast(x.total AS long)), 0L)")


_CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def _judged(rows: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.select(F.col("i").alias("_i"), F.col("v").alias("_v"), "ranges", "items")
    joined = rows.join(hits, F.col("i").eqNullSafe(F.col("_i")) & (F.col("v") == F.col("_v")), "left").drop("_i", "_v")
    return joined.withColumn("n_hit", _n_hit()).withColumn("contaminated", F.expr(_CONTAMINATED))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit, n_items, items (sorted, comma-joined), contaminated.

    Contaminated: some word is hit, and 20 * n_hit >= n_words. Null texts have no words; benchmark
    rows with a null id or text hold no test strings. Items that repeat count once. Repeated
    documents and null ids each get a row. Other columns are ignored. Empty tables: no hits, no rows.
    """
    judged = _judged(*_found(docs, benchmark, id_col, text_col, item_col, item_text_col, window))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return judged.select(F.col("i").alias(id_col), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.array_join(items, ",").alias("items"), "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; rows of equal id and text share their
    verdict. Texts are shuffled only where the table of contaminated rows is too large to broadcast."""
    judged = _judged(*_found(docs, benchmark, id_col, text_col, item_col, item_text_col, window))
    gone = materialise(judged.where("contaminated").select(F.col("i").alias("_i"), F.col("v").alias("_v")).distinct(), "contaminated")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_i"]) & (F.xxhash64(docs[text_col]) == gone["_v"]), "left_anti").select(docs.columns)
