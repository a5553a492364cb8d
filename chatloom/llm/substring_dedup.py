"""Exact substring dedup over windows of words, partitioned by super-k-mers.

A window is ``k`` consecutive words of one document. Each window has a minimiser, the smallest hash of
its ``m``-word pieces; consecutive windows with the same minimiser travel as one packed string (a
super-k-mer) to the bucket of that minimiser, so equal windows meet in one bucket though a window is
not sent on its own. In the bucket the windows are sorted and each run of equal ones gives the smallest
document that has it. Words of later documents in such windows are removed.

Most minimisers stand in one document only; nothing can repeat there. So minimisers (eight bytes each)
go first, and only super-k-mers of those that two documents share are sent. One that a task has already seen in a smaller document needs no bucket: all
its windows repeat. So copies collapse in the tasks that read them, and a bucket gets at most one string for each
variant and task (a few where documents come in descending order), however large a group of copies is.

A minimiser that many documents share can have many variants (near copies, periodic texts). Its bucket is
split by window: each of its windows goes by its own 128-bit hash, once for each document that the task
has not seen it in a smaller one. Near copies share nearly all windows, so a task sends few, and the rows
of one window are bounded by the tasks, not by the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialise, pieces, texts_of

WINDOW = 50
MINIMISER = 6
#: Super-k-mers that a task remembers before it forgets them all; forgetting only sends more strings.
REMEMBERED = 1_000_000
#: Bytes of windows that are sorted at once.
SORTED_BYTES = 64 << 20

#: Documents that share a minimiser from which on its bucket is split by window.
HOT = 64
#: What a window's hash begins with; joined words never do.
_HASHED = b"  "

_ROW = "bucket long, i long, v long, start int, stop int, s binary, again array<int>"


def super_kmers(words: WordHashes, k: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """Of the words of documents: document number, first word, number of windows, minimiser, and the byte
    range in ``words.text``, of every super-k-mer."""
    doc, none = words.doc, np.zeros(0, np.int64)
    if len(doc) < k:
        return none, none, none, none, none, none
    piece = words.sequences(m)
    least, width, whole = piece, 1, k - m + 1
    while 2 * width <= whole:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    n = len(doc) - k + 1
    least = np.minimum(least[:n], least[whole - width : whole - width + n])
    valid = doc[:n] == doc[k - 1 :]
    same = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    starts = np.flatnonzero(valid & ~np.concatenate([[False], same]))
    stops = np.flatnonzero(valid & ~np.concatenate([same, [False]]))
    return doc[starts], starts - words.first[doc[starts]], stops - starts + 1, least[starts].view(np.int64), words.begin[starts], words.end[stops + k - 1]


def _documents(batch: pa.RecordBatch, k: int) -> tuple[list[int], list[bytes]]:
    """Rows that have an id and a window, and their words joined by single spaces."""
    rows, docs = [], []
    for row, (i, text) in enumerate(zip(batch.column("i").to_pylist(), texts_of(batch, "t"), strict=True)):
        words = text.split()
        if i is not None and len(words) >= k:
            rows.append(row)
            docs.append(b" ".join(words))
    return rows, docs


def _minimisers(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    """The distinct minimisers of each document."""
    for batch in pieces(batches, "t", 1 << 20):
        rows, docs = _documents(batch, k)
        if docs:
            doc, _, _, mini, _, _ = super_kmers(WordHashes(docs), k, m)
            pairs = np.unique(np.stack([doc, mini], 1), axis=0)
            row = pa.array(np.array(rows)[pairs[:, 0]])
            yield pa.RecordBatch.from_arrays([batch.column("i").take(row), batch.column("v").take(row), pa.array(pairs[:, 1])], names=["i", "v", "mini"])


class _Sender:
    """What a task sends: rows for the buckets, and ranges that it knows to repeat."""

    _TYPES = (("bucket", pa.int64()), ("i", pa.int64()), ("v", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("s", pa.binary()), ("again", pa.list_(pa.int32())))

    def __init__(self, k: int):
        self.k = k
        self.seen: dict[bytes, int] = {}
        self.rows: list[tuple] = []
        self.open: list | None = None
        self.hashed: dict[bytes, list[int]] = {}

    def known(self, key: bytes, i: int) -> bool:
        """Whether a smaller document of this task has it; if not, this one is remembered."""
        least = self.seen.get(key)
        if least is not None and least < i:
            return True
        self.seen[key] = i
        return False

    def repeats(self, i: int, v: int, start: int, stop: int) -> None:
        if self.open is not None and self.open[:2] == [i, v] and self.open[3] >= start:
            self.open[3] = stop
            return
        self.close()
        self.open = [i, v, start, stop]

    def close(self) -> None:
        if self.open is not None:
            i, v, start, stop = self.open
            self.rows.append((v, i, v, start, stop, None, None))
            self.open = None

    def string(self, mini: int, i: int, v: int, at: int, n: int, string: bytes) -> None:
        if self.known(xxhash.xxh3_128_digest(string), i):
            self.repeats(i, v, at, at + n + self.k - 1)
        else:
            self.rows.append((mini, i, v, at, at + n + self.k - 1, string, None))

    def window(self, i: int, v: int, at: int, window: bytes) -> None:
        key = xxhash.xxh3_128_digest(window)
        if (starts := self.hashed.get(key)) is not None:
            starts.append(at)  # of this document, found before
        elif self.known(key, i):
            self.repeats(i, v, at, at + self.k)
        else:
            self.hashed[key] = [at]

    def end_document(self, i: int, v: int) -> None:
        """A window of the document is one row, wherever else in it it stands."""
        for key, (at, *again) in self.hashed.items():
            self.rows.append((int.from_bytes(key[:8], "little", signed=True), i, v, at, at + self.k, _HASHED + key, again))
        self.hashed = {}

    def batch(self) -> pa.RecordBatch:
        self.close()
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self._TYPES)
        self.rows = []
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, self._TYPES, strict=True)], names=[n for n, _ in self._TYPES])


def _emit(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    send = _Sender(k)
    for batch in pieces(batches, "t", 1 << 20):
        rows, docs = _documents(batch, k)
        if not docs:
            continue
        ids, versions, shared, hot = ([column[r] for r in rows] for column in (batch.column(c).to_pylist() for c in ("i", "v", "minis", "hot")))
        shared, hot = [set(x) for x in shared], [set(x) for x in hot]
        words, last = WordHashes(docs), 0
        text, begin, end, first = words.text, words.begin, words.end, words.first.tolist()
        for doc, at, n, mini, low, high in zip(*(x.tolist() for x in super_kmers(words, k, m)), strict=True):
            if doc != last:
                send.end_document(ids[last], versions[last])
                last = doc
            if mini in hot[doc]:
                g = first[doc] + at
                for j, (a, b) in enumerate(zip(begin[g : g + n].tolist(), end[g + k - 1 : g + k - 1 + n].tolist(), strict=True)):
                    send.window(ids[doc], versions[doc], at + j, text[a:b])
            elif mini in shared[doc]:
                send.string(mini, ids[doc], versions[doc], at, n, text[low:high])
        send.end_document(ids[last], versions[last])
        yield send.batch()


def _window_bounds(string: bytes, k: int) -> list[tuple[int, int]]:
    if string.startswith(_HASHED):
        return [(0, len(string))]
    space = np.flatnonzero(np.frombuffer(string, np.uint8) == 32)
    begin, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(string)]])
    return list(zip(begin[: len(end) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True))


def repeated(rows: list[tuple[int, int, int, bytes]], k: int) -> Iterator[tuple[int, int, int, int]]:
    """Of one minimiser's rows (document, version, first word, string): the ranges (document, version,
    start, stop) of windows that a smaller document has."""
    first: dict[bytes, int] = {}
    for i, _, _, s in rows:
        if s not in first or i < first[s]:
            first[s] = i
    if len(first) == 1:
        (s, least), bounds = next(iter(first.items())), None
        for i, v, at, s in rows:
            if i > least:
                bounds = bounds or len(_window_bounds(s, k))
                yield i, v, at, at + bounds + k - 1
        return
    if min(first.values()) == max(i for i, *_ in rows):
        return
    bounds = {s: _window_bounds(s, k) for s in first}
    repeats = {s: np.full(len(b), np.iinfo(np.int64).max) for s, b in bounds.items()}  # the smallest document of each window
    parts = sum(len(s) // 7 * k for s in first) * 4 // SORTED_BYTES + 1
    for part in range(parts):
        windows = [(s[a:b], i, s, j) for s, i in first.items() for j, (a, b) in enumerate(bounds[s]) if parts == 1 or zlib.crc32(s[a:b]) % parts == part]
        windows.sort(key=lambda x: x[:2])
        held = least = None
        for window, i, s, j in windows:
            if window != held:
                held, least = window, i
            repeats[s][j] = least
    for i, v, at, s in rows:
        known = np.concatenate([[False], repeats[s] < i, [False]]).astype(np.int8)
        edge = np.diff(known)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            yield i, v, at + a, at + b + k - 1


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket; a bucket's rows may span batches."""
    names = ["i", "v", "start", "stop"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    rows: list[tuple[int, int, int, bytes]] = []
    now = None
    again: dict[tuple[int, int, int], list[int]] = {}

    def found() -> Iterator[tuple[int, int, int, int]]:
        for i, v, start, stop in repeated(rows, k) if len(rows) > 1 else ():
            yield i, v, start, stop
            for at in again.get((i, v, start), ()):  # other places of the same window
                yield i, v, at, at + k

    for batch in batches:
        passed = batch.filter(batch.column("s").is_null())
        ranges: list[tuple[int, int, int, int]] = []
        strings = batch.filter(batch.column("s").is_valid())
        for bucket, i, v, at, s, more in zip(*(strings.column(c).to_pylist() for c in ("bucket", "i", "v", "start", "s", "again")), strict=True):
            if bucket != now:
                ranges += found()
                rows, again, now = [], {}, bucket
            rows.append((i, v, at, s))
            if more:
                again[i, v, at] = more
        yield pa.RecordBatch.from_arrays([passed.column(c) for c in names], names=names)
        if ranges:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ranges, strict=True), types, strict=True)], names=names)
    if ranges := list(found()):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ranges, strict=True), types, strict=True)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "t"):
        total, gone, kept = [], [], []
        for text, ranges in zip(texts_of(batch, "t"), batch.column("ranges").to_pylist(), strict=True):
            words = text.split()
            at, parts = 0, []
            for r in sorted((r["start"], r["stop"]) for r in ranges or []):
                if r[0] > at:
                    parts += words[at : r[0]]
                at = max(at, r[1])
            parts += words[at:]
            total.append(len(words))
            gone.append(len(words) - len(parts))
            kept.append(b" ".join(parts).decode())
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["i", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_removed, kept (the words that stay, joined by a space).

    A word goes if a window that covers it also starts in a document with a smaller id. Null texts have
    no words; texts of fewer than ``k`` words have no window. Rows with a null id lose nothing and cost
    others nothing. Rows that share an id are not smaller than one another; each gets its own result.
    Other columns are ignored. An empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))
    minis = materialise(source.mapInArrow(lambda batches: _minimisers(batches, k, m), "i long, v long, mini long"), "minimisers")
    shared = minis.groupBy("mini").agg(F.min("i").alias("least"), F.max("i").alias("most"), F.count("*").alias("n")).where("least < most").select("mini", (F.col("n") >= HOT).alias("hot"))
    kinds = (F.collect_set(F.when(on, F.col("mini"))).alias(name) for name, on in (("minis", ~F.col("hot")), ("hot", F.col("hot"))))
    by_doc = minis.join(materialise(shared, "shared-minimisers"), "mini").groupBy("i", "v").agg(*kinds)
    sent = source.join(by_doc, ["i", "v"]).mapInArrow(lambda batches: _emit(batches, k, m), _ROW)
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    ranges = dealt.mapInArrow(lambda batches: _count(batches, k), "i long, v long, start int, stop int")
    cuts = ranges.groupBy("i", "v").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    out = source.join(cuts, ["i", "v"], "left").select("i", "t", "ranges").mapInArrow(_cut, "i long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("i", id_col)
