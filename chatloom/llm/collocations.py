"""Phrase collocations by language: Apriori levels counted with broadcast double-array tries.

Words that occur ``LEAST`` times in their language get numbers; texts become arrays of these, zero where
another word or the end of a piece stands. Level by level, longer phrases are counted:

* Candidates of k words are windows both of whose (k-1)-word parts are frequent (Apriori). Tasks report the
  windows that they hold, and those that can't reach ``LEAST`` together are left out.
* The candidates form a trie over words, laid out as a double array and broadcast: from state s the word c
  leads to base[s] + c, if check there says s. All text positions start at the root at once; each level
  takes every live position one word further, with a few numpy operations for all of them. Accepting states are
  counted by ``bincount``, added up within a task and summed over tasks by Spark.

Broadcasts are bounded: a vocabulary or trie of more than ``SHARD`` entries is cut into shards of at most
so many, each with a pass of its own over the arrays. Words are told apart by 63-bit hashes when they are
numbered, exactly when they are counted, and by number after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, materialise, pieces, texts_of

LEAST, LONGEST, TOP = 100, 5, 2000
#: A candidate goes if a longer one that holds it has at least this share, in percent, of its occurrences.
COVERED = 100
#: Most words of a broadcast vocabulary, and most phrases of a broadcast trie.
SHARD = 1 << 18
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 20
#: Bytes of text that become one array, of an Arrow batch and of a row group of arrays, and most rows that Python gives back at
#: once: a task's memory goes by these, not by the bytes of its partition.
PIECE, BATCH, GROUP, ROWS = 1 << 20, 2 << 20, 8 << 20, 1 << 15
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_OPEN = np.uint64(1 << 63)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_ODD = 0x9E3779B97F4A7C15


class Words:
    """The words of texts, in order: hash (of language and word, the highest bit set), doc, begin and end
    in ``raw``, and whether a piece starts with the word."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        self.raw = b"\n".join(texts).lower()  # on bytes: A-Z only; the joint ends a piece
        kind = _KIND[np.frombuffer(self.raw, np.uint8)]
        edge = np.flatnonzero(np.diff(np.r_[np.uint8(0), (kind == 0).view(np.uint8), np.uint8(0)]))
        self.begin, self.end = edge[::2], edge[1::2]
        stops = np.flatnonzero(kind == 2)
        self.starts = np.r_[True, np.diff(np.searchsorted(stops, self.begin)) > 0][: len(self.begin)]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(first, self.begin, "right") - 1
        salt = {lang: np.uint64(int.from_bytes(lang[:64] or b"\0", "big") * _ODD % (1 << 64)) for lang in set(langs)}
        salts = np.array([salt[x] for x in langs], np.uint64)
        self.hash = self._hashes() ^ salts[self.doc]
        self.hash = (self.hash ^ (self.hash >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        self.hash = (self.hash ^ (self.hash >> np.uint64(29))) | _OPEN

    def _hashes(self) -> np.ndarray:
        """Polynomial hash of every word, a stretch of the text at a time."""
        out, at = np.zeros(len(self.begin), np.uint64), 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + CHUNK)))
            low = self.begin[at]
            raw = np.frombuffer(self.raw, np.uint8, self.end[to - 1] - low, low)
            prefix = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(raw)))]
            inverse = _powers(pow(_ODD, -1, 1 << 64), len(raw))
            out[at:to] = (prefix[self.end[at:to] - low] - prefix[self.begin[at:to] - low]) * inverse[self.begin[at:to] - low]
            at = to
        return out


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, n of the words that occur ``least`` times; where word is null, n counts all words of lang.

    ``docs``: lang, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            langs = texts_of(batch, "lang")
            found = Words(texts_of(batch, "text"), langs)
            if not len(found.begin):
                continue
            _, first, n = np.unique(found.hash, return_index=True, return_counts=True)
            words = [found.raw[b:e] for b, e in zip(found.begin[first].tolist(), found.end[first].tolist(), strict=True)]
            names = [langs[d] for d in found.doc[first].tolist()]
            total: dict[bytes, int] = {}
            for lang, count in zip(names, n.tolist(), strict=True):
                total[lang] = total.get(lang, 0) + count
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, *total], pa.binary()).cast(pa.string()), pa.array([*words, *[None] * len(total)], pa.binary()).cast(pa.string()), pa.array([*n.tolist(), *total.values()], pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | F.col("word").isNull())


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` with a column ``number`` from 1 on without gaps, and how many there are. No sort, no shuffle:
    rows are numbered within their tasks, and what tasks before them hold is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at + 1, at + n + 1))], names=[*batch.schema.names, "part", "at"])
            at += n

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = materialise(rows.mapInArrow(run, f"{kinds}, part long, at long"), name)
    held = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.max("at").alias("n")).collect())  # a row for each task
    before = np.cumsum([0, *(n for _, n in held)])
    offsets = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(held, before, strict=False)], "part long, before long")
    return dealt.join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("at") + F.col("before")).alias("number")), int(before[-1])


def shards(rows: DataFrame, count: int, size: int) -> Iterator[pa.Table]:
    """The numbered rows, ``size`` at a time, each as a table on the driver."""
    for low in range(0, max(count, 1), size):
        yield rows.where((F.col("number") > low) & (F.col("number") <= low + size)).toArrow()


def encode(docs: DataFrame, vocabulary: DataFrame, count: int, size: int = SHARD) -> DataFrame:
    """``codes``: the numbers of the words of a stretch of text, as 32-bit integers; zero where the vocabulary
    (lang, word, number) has none and between pieces, and never twice in a row."""
    context = docs.sparkSession.sparkContext
    tables = max(1, -(-count // size))
    out = docs

    def known(shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        columns = [[x.encode() for x in shard.column(c).to_pylist()] for c in ("word", "lang")]
        hashes = Words(*columns).hash
        order = np.argsort(hashes)
        return hashes[order], shard.column("number").to_numpy()[order].astype(np.uint64)

    for i, shard in enumerate(shards(vocabulary, count, size)):
        names, last, first = context.broadcast(known(shard)), i == tables - 1, i == 0  # 16 bytes an entry

        def run(batches: Iterator[pa.RecordBatch], names=names, last=last, first=first) -> Iterator[pa.RecordBatch]:
            hashes, numbers = names.value

            def words(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
                for batch in batches:
                    if not first:
                        yield from (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("codes"))
                        continue
                    for piece in pieces(iter([batch]), "text", PIECE):
                        found = Words(texts_of(piece, "text"), texts_of(piece, "lang"))
                        # a zero before each word that starts a piece
                        yield np.insert(found.hash, np.flatnonzero(found.starts), np.uint64(0))

            for codes in words(batches):
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, codes), len(hashes) - 1)
                    codes = np.where(hashes[at] == codes, numbers[at], codes)
                if last:
                    codes = np.where(codes < _OPEN, codes, np.uint64(0)).astype(np.int32)
                    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)][: len(codes)]]
                if codes.any():
                    yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary())], names=["codes"])

        out = materialise(out.mapInArrow(run, "codes binary"), "codes", GROUP)
    return out


class Trie:
    """Double array over the words of phrases (rows of ``phrases``) of one length.

    States are slots: from state s the symbol c leads to slot base[s] + c, if check has s there. ``number``
    gives the row of the phrase that ends in a state. A word is ``digits`` symbols, the digits of its
    place among the trie's words, so that the slots of a state's children lie within ``WIDTH`` of each other and
    the array stays within a small multiple of the states.
    """

    WIDTH = 1 << 10

    def __init__(self, phrases: np.ndarray):
        self.size, self.length = phrases.shape
        self.words, place = np.unique(phrases, return_inverse=True)
        self.digits = max(1, -(-int(len(self.words)).bit_length() // 10))
        codes = self._symbols(place.reshape(phrases.shape)).reshape(self.size, -1)
        order = np.lexsort(codes.T[::-1])
        codes, width = codes[order], self.WIDTH
        # The root is slot 0; no base is below zero, as all others start at ``width``.
        free = np.ones(8 * width, bool)
        free[:width] = False
        parents, bases, taken = [], [], []
        state, low, top = np.zeros(self.size, np.int64), width, width
        for level in range(codes.shape[1]):
            # phrases of one prefix stand together; a child is where prefix and next symbol are new
            fresh = np.r_[True, (codes[1:, : level + 1] != codes[:-1, : level + 1]).any(1)]
            child = np.flatnonzero(fresh)
            parent, symbol = state[child], codes[child, level]
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            many = np.diff(np.r_[first, len(parent)])
            base = np.zeros(len(first), np.int64)
            for at in np.argsort(-many, kind="stable"):
                if many[at] == 1:
                    break
                if len(free) < max(low, top) + 8 * width:
                    free = np.r_[free, np.ones(len(free), bool)]
                mine = symbol[first[at] : first[at] + many[at]]
                base[at], low = self._place(free, mine, low, top)
                free[base[at] + mine] = False
                top = max(top, int(base[at] + mine[-1]) + 1)
            single = np.flatnonzero(many == 1)
            free = np.r_[free, np.ones(len(single), bool)]
            slots = np.flatnonzero(free)[: len(single)]
            base[single] = slots - symbol[first[single]]
            free[slots] = False
            top = max(top, int(slots.max(initial=0)) + 1)
            slot = np.repeat(base, many) + symbol
            parents, bases, taken = [*parents, parent], [*bases, np.repeat(base, many)], [*taken, slot]
            state = slot[np.cumsum(fresh) - 1]
        self.base, self.check, self.number = np.zeros(top + width, np.int32), np.full(top + width, -1, np.int32), np.zeros(top + width, np.int32)
        self.base[np.concatenate(parents)], self.check[np.concatenate(taken)] = np.concatenate(bases), np.concatenate(parents)
        self.number[state] = order

    def _symbols(self, place: np.ndarray) -> np.ndarray:
        """The digits of places, each from 0 to ``WIDTH`` - 1, along a new last axis."""
        return np.stack([place >> (10 * d) & (self.WIDTH - 1) for d in range(self.digits - 1, -1, -1)], -1)

    def _place(self, free: np.ndarray, symbols: np.ndarray, low: int, top: int) -> tuple[int, int]:
        """A base at which the slots of all ``symbols`` are free, and where to look next: the first that
        fits of the free slots after ``low``, or beyond all that are taken."""
        slots = np.flatnonzero(free[low : low + 4 * self.WIDTH]) + low
        if len(slots) < self.WIDTH // 8:
            low += self.WIDTH
        for part in (slots[:64], slots[64:]):
            tried = part - symbols[0]
            fits = np.flatnonzero(free[tried[:, None] + symbols].all(1))
            if len(fits):
                return int(tried[fits[0]]), low
        return max(low, top), low

    def ends(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``codes`` where a phrase starts, and the number of its row."""
        place = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        place = np.r_[np.where(self.words[place] == codes, place, -1), np.full(self.length, -1)]
        symbols = self._symbols(place)
        at = np.flatnonzero(place >= 0)
        state = np.zeros(len(at), np.int64)
        for level in range(self.length):
            live = place[at + level] >= 0
            at, state = at[live], state[live]
            for digit in range(self.digits):
                to = self.base[state] + symbols[at + level, digit]
                live = self.check[to] == state
                at, state = at[live], to[live]
        return at, self.number[state]


def _windows(codes: np.ndarray, found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The different windows of ``length`` words whose parts (numbers ``found`` where they start, else zero)
    both are frequent, as rows, and how often each occurs."""
    live = np.flatnonzero((found[:-1] > 0) & (found[1:] > 0))
    key = found[live].astype(np.int64) << 32 | found[live + 1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return codes[live[first][:, None] + np.arange(length)], n


def _pass(blobs: DataFrame, trie: Broadcast | None, offset: int, length: int, last: bool, more: bool) -> DataFrame:
    """One pass over the arrays: rows of number and n (phrases of the trie), of phrase and n (windows one
    word longer, if ``more``, after the last shard), and the arrays again where another shard follows.

    ``found`` has for each position the number of the phrase that starts there, as far as shards before found it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["codes", "found", "phrase", "number", "n"]
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64()]

        def out(rows: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, k)) for c, k in zip(names, kinds, strict=True)], names=names)

        total = np.zeros(trie.value.size if trie else 0, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int32)
                found = codes
                if trie:
                    held = batch.column("found")[row]
                    found = np.frombuffer(held.as_buffer(), np.int32).copy() if held.is_valid else np.zeros(len(codes), np.int32)
                    at, number = trie.value.ends(codes)
                    total += np.bincount(number, minlength=len(total))
                    found[at] = number + offset
                if not last:
                    yield out(1, codes=pa.array([codes.tobytes()], pa.binary()), found=pa.array([found.tobytes()], pa.binary()))
                elif more:
                    windows, n = _windows(codes, found, length + 1)
                    ends = pa.array(np.arange(ROWS + 1) * (length + 1), pa.int32())
                    for start in range(0, len(n), ROWS):
                        some = windows[start : start + ROWS]
                        yield out(len(some), phrase=pa.ListArray.from_arrays(ends[: len(some) + 1], pa.array(some.ravel())), n=pa.array(n[start : start + ROWS], pa.int64()))
        there = np.flatnonzero(total)
        yield out(len(there), number=pa.array(there + offset), n=pa.array(total[there]))

    source = blobs if "found" in blobs.columns else blobs.withColumn("found", F.lit(None).cast("binary"))
    return source.mapInArrow(run, "codes binary, found binary, phrase array<int>, number long, n long")


def _frequent(windows: DataFrame, least: int, name: str) -> tuple[DataFrame, int]:
    held = windows.where("phrase IS NOT NULL").groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return numbered(held.select("phrase"), name)


def phrases(codes: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> DataFrame:
    """phrase (array of word numbers) and a, of all phrases of two to ``longest`` words that occur ``least`` times."""
    context, spark = codes.sparkSession.sparkContext, codes.sparkSession
    found = [spark.createDataFrame([], "phrase array<int>, a long")]
    candidates, count = _frequent(_pass(codes, None, 1, 1, True, True), least, "candidates")
    length = 2
    while count:
        tables, blobs, counts = -(-count // size), codes, []
        for i, shard in enumerate(shards(candidates, count, size)):
            shard = shard.sort_by("number")
            rows = shard.column("phrase").combine_chunks().flatten().to_numpy().reshape(-1, length)
            trie = context.broadcast(Trie(rows))  # SHARD phrases at most
            done = materialise(_pass(blobs, trie, i * size + 1, length, i == tables - 1, length < longest), "counted", GROUP)
            counts.append(done.where("number IS NOT NULL").select("number", "n"))
            blobs = done.where("codes IS NOT NULL").select("codes", "found")
        summed = reduce(DataFrame.unionByName, counts).groupBy("number").agg(F.sum("n").alias("a"))
        found.append(candidates.join(summed, "number").where(F.col("a") >= least).select("phrase", "a"))
        if length == longest:
            break
        length += 1
        candidates, count = _frequent(done, least, "candidates")
    return reduce(DataFrame.unionByName, found)


def _part(name: str, start: Column, size: Column) -> Column:
    return F.slice("phrase", start, size).alias(name)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts, lower-cased in A-Z, are split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs
    into words. a is the number of a phrase's occurrences within pieces, n that of all words of the language.
    For a cut into two parts with l and r occurrences the score is floor(1000 a n / (l r)), in whole numbers;
    a phrase's lowest counts, of equal ones that of the first cut. Phrases within a longer candidate that has
    ``covered`` percent of their occurrences go. Order: score, a (both falling), phrase by its bytes.

    A null text has no words; a null language is ``und``. Repeated rows count each time. An empty table, or one
    without frequent words, gives an empty table. Other columns are ignored.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    with batches_of(docs.sparkSession, BATCH):
        counted = materialise(word_counts(source, least), "word-counts")
        totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
        words, count = numbered(counted.where("word IS NOT NULL"), "vocabulary")
        longer = materialise(phrases(encode(source, words, count, shard), least, longest, shard), "phrases")
    single = words.select(F.array(F.col("number").cast("int")).alias("phrase"), F.col("n").alias("a"))
    known = single.unionByName(longer)
    size = F.size("phrase")
    cuts = longer.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("phrase", "a", "cut", _part("left", F.lit(1), F.col("cut")), _part("right", F.col("cut") + 1, size - F.col("cut")))
    cuts = cuts.join(known.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    # Within a phrase n and a are the same for all cuts, so the language comes later.
    named = longer.select("phrase", F.posexplode("phrase").alias("at", "number")).join(words.select("number", "word", "lang"), "number")
    named = named.groupBy("phrase").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    inner = longer.where(size > 2).select("phrase", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("held"))
    inner = inner.select("a", "held", "phrase", F.explode(F.sequence(F.lit(1), size - F.col("held") + 1)).alias("at")).select(_part("phrase", F.col("at"), F.col("held")), "a")
    inner = inner.groupBy("phrase").agg(F.max("a").alias("most"))
    kept = longer.join(inner, "phrase", "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True))).select("phrase")
    exact = cuts.join(kept, "phrase").join(named, "phrase").join(totals, "lang").withColumns({c: F.col(c).cast("decimal(19,0)") for c in ("l", "r", "total")} | {"many": F.col("a").cast("decimal(19,0)")})
    scored = exact.withColumn("score", F.expr("(1000 * many * total) div (l * r)"))
    best = scored.groupBy("phrase").agg(*(F.first(c).alias(c) for c in ("lang", "text", "a", "total")), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "text")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    counts = {"l": F.col("best.l"), "r": F.col("best.r"), "n": F.col("total"), "score": F.col("best.score"), "rank": F.col("rank")}
    return ranked.select("lang", counts["rank"].cast("long").alias("rank"), F.col("text").alias("phrase"), "a", *(counts[c].cast("long").alias(c) for c in ("l", "r", "n", "score")))
