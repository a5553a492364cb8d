"""Hard negatives by inner product: an inverted multi-index with certified stops.

Vectors become integers, floor(scale x). Two codebooks, one for each half of the dimensions, are fitted
on a bounded sample by k-means; a pair of codewords is a cell. Rows are sorted by cell and packed into
blocks, each with its own lists by cell and the radius of every codeword: the largest distance
from it to a half row that the block has there. For an anchor q a half score is at most q c + |q| r and
at least q c - |q| r, and a heap visits the cells of a block in falling order of the two upper bounds' sum (multi-sequence
algorithm). It stops for good where no cell that is left can hold a row that counts: when the next
bound is below the worst of the results so far, for mining the worst over all windows; cells that lie
above all windows are passed over. So the result is exact.

The first pass finds each anchor's positives, the second, with the windows that follow from them, its
negatives. Both send blocks of anchors to all blocks of rows (see ``vectors``).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialise

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
#: Rows that a cell is to hold, and most codewords of a half.
CELL_ROWS, CODEWORDS = 256, 256
#: Rows that are scored at once; the heap goes on after each such batch.
BATCH = 1024
#: Scores beyond this count as this much.
MOST = 1 << 62
_BEST = "array<struct<down long, id long>>"
_BEST_KIND = pa.struct([("down", pa.int64()), ("id", pa.int64())])


def codebook(seen: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` codewords of the rows of ``seen``, by k-means from a fixed start."""
    different = np.unique(seen, axis=0)
    if len(different) <= size:
        return different if len(different) else np.zeros((1, seen.shape[1]))
    words = different[np.random.default_rng(13).choice(len(different), size, replace=False)]
    for _ in range(8):
        near = nearest(seen, words)
        count = np.bincount(near, minlength=size)
        sums = np.zeros_like(words)
        np.add.at(sums, near, seen)
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return words


def nearest(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):  # for vast values any cell will do
        return ((words * words).sum(1) - 2 * (half @ words.T)).argmin(1)


def descending(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """The sums of one value of each list, both falling, in falling order: sum and the two positions."""
    heap = [(-(left[0] + right[0]), 0, 0)]
    while heap:
        down, i, j = heapq.heappop(heap)
        yield -down, i, j
        if j + 1 < len(right):
            heapq.heappush(heap, (-(left[i] + right[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (-(left[i + 1] + right[0]), i + 1, 0))


class _Lists:
    """A block of rows by cell, and the codewords and radii of both halves that it has rows of."""

    def __init__(self, theirs: dict, kind: str, dim: int, words: tuple[np.ndarray, np.ndarray]):
        cell = vectors.values(theirs["cell"], "i8")
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        self.ids, self.labels = (vectors.values(theirs[c], "i8")[order] for c in ("id", "label"))
        self.vecs = vectors.values(theirs["vec"], kind, dim)[order].astype(np.float64)
        halves, self.words, self.radius, places = (self.vecs[:, : dim // 2], self.vecs[:, dim // 2 :]), [], [], []
        for half, book, mine in zip(halves, words, (cell // CODEWORDS, cell % CODEWORDS), strict=True):
            there, place = np.unique(mine, return_inverse=True)
            far = np.zeros(len(there))
            np.maximum.at(far, place, np.sqrt(((half - book[mine]) ** 2).sum(1)))
            self.words.append(book[there])
            self.radius.append(far)
            places.append(place)
        self.start = np.zeros((len(self.radius[0]), len(self.radius[1])), np.int64)
        self.count = np.zeros_like(self.start)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.start[places[0][first], places[1][first]] = first
        self.count[places[0][first], places[1][first]] = np.diff(np.r_[first, len(cell)])


class _Anchors:
    """A block of anchors; what they look for is up to ``floor``, ``ceiling`` and ``take`` of a subclass."""

    def __init__(self, mine: dict, kind: str, dim: int, words: tuple[np.ndarray, np.ndarray], exact: bool):
        self.block, self.kind, self.dim, self.words, self.exact = mine["block"].as_py(), kind, dim, words, exact
        self.ids, self.labels = vectors.values(mine["id"], "i8"), vectors.values(mine["label"], "i8")
        self.vecs = vectors.values(mine["vec"], kind, dim).astype(np.float64)

    def floor(self, at: int) -> float:
        raise NotImplementedError

    def ceiling(self, at: int) -> float:
        return math.inf

    def take(self, at: int, ids: np.ndarray, scores: np.ndarray, same: np.ndarray) -> None:
        raise NotImplementedError

    def meet(self, theirs: dict) -> None:
        lists = _Lists(theirs, self.kind, self.dim, self.words)
        for at in range(len(self.ids)):
            if self.floor(at) < math.inf:
                self._visit(at, lists)

    def _visit(self, at: int, lists: _Lists) -> None:
        anchor, halves = self.vecs[at], (self.vecs[at, : self.dim // 2], self.vecs[at, self.dim // 2 :])
        upper, lower, order = [], [], []
        for half, words, radius in zip(halves, lists.words, lists.radius, strict=True):
            middle, spread = words @ half, math.sqrt(half @ half) * radius
            by = np.argsort(-(middle + spread), kind="stable")
            upper.append((middle + spread)[by])
            lower.append((middle - spread)[by])
            order.append(by)
        # Scores are whole numbers; the bounds are rounded, by far less than this.
        slack = 0.5 + 1e-9 * sum(float(np.abs(x).max(initial=0)) for x in (*upper, *lower))
        waiting, held = [], 0
        for bound, i, j in descending(*upper):
            if bound < self.floor(at) - slack:
                break
            n = int(lists.count[order[0][i], order[1][j]])
            if not n or lower[0][i] + lower[1][j] > self.ceiling(at) + slack:
                continue
            first = int(lists.start[order[0][i], order[1][j]])
            waiting.append(np.arange(first, first + n))
            held += n
            if held >= BATCH:
                self._score(at, anchor, lists, np.concatenate(waiting))
                waiting, held = [], 0
        if waiting:
            self._score(at, anchor, lists, np.concatenate(waiting))

    def _score(self, at: int, anchor: np.ndarray, lists: _Lists, found: np.ndarray) -> None:
        if self.exact:
            scores = (lists.vecs[found] @ anchor).astype(np.int64)
        else:  # the sums don't fit doubles
            mine = list(map(int, anchor))
            scores = np.array([max(-MOST, min(MOST, sum(map(int.__mul__, mine, map(int, x))))) for x in lists.vecs[found]], np.int64)
        self.take(at, lists.ids[found], scores, lists.labels[found] == self.labels[at])

    @staticmethod
    def _merged(best: list, ids: np.ndarray, scores: np.ndarray, most: int) -> list:
        top = np.lexsort((ids, -scores))[:most]
        return sorted(best + list(zip((-scores[top]).tolist(), ids[top].tolist(), strict=True)))[:most]


def _lists_of(found: list[list]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([{"down": d, "id": i} for x in found for d, i in x], _BEST_KIND))


class _Positives(_Anchors):
    def __init__(self, *args, most: int):
        super().__init__(*args)
        self.most, self.best = most, [[] for _ in self.ids]

    def floor(self, at: int) -> float:
        return -self.best[at][-1][0] if len(self.best[at]) == self.most else -math.inf

    def take(self, at: int, ids: np.ndarray, scores: np.ndarray, same: np.ndarray) -> None:
        kept = same & (ids != self.ids[at]) & (scores >= self.floor(at))
        if kept.any():
            self.best[at] = self._merged(self.best[at], ids[kept], scores[kept], self.most)

    def rows(self) -> pa.RecordBatch:
        n = len(self.ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.block)), pa.array(np.arange(n)), _lists_of(self.best)], names=["block", "place", "best"])


class _Negatives(_Anchors):
    """Windows of scores, one for each positive; each fills with the highest scores within it."""

    def __init__(self, *args, mine: dict, most: int, low: int, high: int):
        super().__init__(*args)
        self.most = most
        #: For each anchor its windows: lowest and highest score, positive's id and score, best so far.
        self.windows: list[list] = [[] for _ in self.ids]
        for x in mine["positives"].as_py():
            for p in x["best"]:
                score = -p["down"]
                lowest, highest = -(-low * score // 100), high * score // 100
                if lowest <= highest:
                    self.windows[x["place"]].append([lowest, highest, p["id"], score, []])

    def _least(self, window: list) -> float:
        return -window[4][-1][0] if len(window[4]) == self.most else window[0]

    def floor(self, at: int) -> float:
        return min(map(self._least, self.windows[at]), default=math.inf)

    def ceiling(self, at: int) -> float:
        return max((w[1] for w in self.windows[at]), default=-math.inf)

    def take(self, at: int, ids: np.ndarray, scores: np.ndarray, same: np.ndarray) -> None:
        other = ~same & (ids != self.ids[at])
        for window in self.windows[at]:
            kept = other & (scores >= self._least(window)) & (scores <= window[1])
            if kept.any():
                window[4] = self._merged(window[4], ids[kept], scores[kept], self.most)

    def rows(self) -> pa.RecordBatch:
        flat = [(at, which, w[2], w[3], w[4]) for at, windows in enumerate(self.windows) for which, w in enumerate(windows)]
        at, which, positive, score, best = zip(*flat, strict=True) if flat else [[]] * 5
        columns = [pa.array([self.block] * len(flat), pa.int64()), pa.array(self.ids[list(at)], pa.int64())]
        columns += [pa.array(x, pa.int64()) for x in (at, which, positive, score)] + [_lists_of(list(best))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "anchor_id", "place", "which", "positive_id", "positive_score", "best"])


def _top(best: Column, most: int) -> Column:
    return F.slice(F.array_sort(F.flatten(F.collect_list(best))), 1, most)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of the whole numbers floor(``scale`` x). An anchor's positives are the
    ``positives`` rows of its label with the highest scores; a positive's negatives the first
    ``negatives`` rows of other labels whose scores are ``low`` to ``high`` percent of its own. Ties go to
    smaller ids. A positive of negative score has none.

    Rows without an id or a label, or whose vector is null or has null or non-finite components, take no
    part. Shorter vectors (empty ones too) are filled up with zeros. Rows with an anchor's id are its own
    and are left out; other repeated rows each count, and a repeated anchor is answered each time. Sums that
    doubles can't hold are taken in whole numbers; scores beyond 2^62 count as 2^62. An empty table gives an
    empty table. Other columns are ignored.
    """
    vec = F.col(vec_col).cast("array<double>")
    label = F.col(label_col).cast("long") if rows.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label_col)
    marked = rows.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(label_col).isNotNull(), label).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), vec.alias("vec"))
    taking_part = marked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vectors.usable(F.col("vec")))
    found = taking_part.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs))), F.count("*")).first()
    dim, largest, n = max(2, found[0] or 2), scale * (found[1] or 0.0) + 1, found[2]
    kind = "i2" if largest < 1 << 15 else "i4" if largest < 1 << 31 else "f8"
    exact = dim * largest * largest < 1 << 53

    def whole(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.nan_to_num(np.floor(scale * x))

    size = min(CODEWORDS, max(2, 1 << round(math.log2(max(1, n / CELL_ROWS)) / 2)))
    seen = whole(vectors.sample(taking_part.select("id", "vec"), dim))
    context = taking_part.sparkSession.sparkContext
    words = context.broadcast((codebook(seen[:, : dim // 2], size), codebook(seen[:, dim // 2 :], size)))  # 256 a half at most

    def make(vecs: np.ndarray) -> list[pa.Array]:
        numbers = whole(vecs)
        cell = nearest(numbers[:, : dim // 2], words.value[0]) * CODEWORDS + nearest(numbers[:, dim // 2 :], words.value[1])
        return [pa.array(cell), pa.array([x.tobytes() for x in numbers.astype(kind)], pa.binary())]

    def celled(part: DataFrame) -> DataFrame:
        return vectors.to_rows(part.select("id", "label", "vec"), dim, make, "cell long, packed binary").withColumnRenamed("packed", "vec")

    # Ranges of cell and a hash, so that a cell with many rows is spread.
    by_cell = celled(taking_part).withColumn("spread", F.xxhash64("id")).repartitionByRange("cell", "spread").sortWithinPartitions("cell").drop("spread")
    lists = materialise(vectors.pack(by_cell, vectors.ROW_BLOCK), "cell-blocks")
    anchors = materialise(vectors.pack(celled(taking_part.where("asks")), vectors.QUERY_BLOCK), "anchor-blocks")

    def args(block: dict) -> tuple:
        return block, kind, dim, words.value, exact

    parts = vectors.each_pair(anchors, lists, lambda block: _Positives(*args(block), most=positives), f"block long, place long, best {_BEST}")
    best = parts.groupBy("block", "place").agg(_top(F.col("best"), positives).alias("best"))
    by_block = best.groupBy("block").agg(F.collect_list(F.struct("place", "best")).alias("positives"))  # of one block of anchors
    asking = materialise(anchors.join(by_block, "block"), "anchor-windows")
    schema = f"block long, anchor_id long, place long, which long, positive_id long, positive_score long, best {_BEST}"
    parts = vectors.each_pair(asking, lists, lambda block: _Negatives(*args(block), mine=block, most=negatives, low=low, high=high), schema)
    best = parts.groupBy("block", "place", "which").agg(*(F.first(c).alias(c) for c in ("anchor_id", "positive_id", "positive_score")), _top(F.col("best"), negatives).alias("best"))
    ranked = best.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("rank", "x"))
    return ranked.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score"))
