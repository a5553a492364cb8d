"""Nearest neighbours by cosine: multi-index hashing of learned rotated binary codes.

The vectors' main directions are rotated so that the signs keep as much as possible of them (iterative
quantisation), on a bounded sample; every vector gets a code of 64 signs. Every block of rows carries an
index of its codes' four 16-bit substrings. A query with radius r probes it by the pigeonhole
principle: with r = 4 a + b, a code within r bits agrees up to a bits in one of the first b + 1
substrings, or up to a - 1 bits in one of the others. All codes within r are retrieved and reranked with
the vectors themselves.

The radius follows what has been found. For vectors at each cosine the sample tells how many bits differ
in all but 2 % of the cases; as soon as a query has found as many rows as are wanted, it searches the
radius that belongs to the worst of them, before that all codes. So a query whose neighbours are
close looks at few codes, one whose neighbours are hardly nearer than the rest at many, whatever the size
of the table, and nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialise

BITS, PARTS, PART_BITS = 64, 4, 16
NEAREST = 5
#: Share of the neighbours at a cosine whose codes lie within the radius for it.
SURE = 0.98
#: Steps of the cosine for which radii are learned, and pairs of vectors for each.
STEPS, PAIRS = 100, 512


def fit(seen: np.ndarray) -> np.ndarray:
    """Projection of vectors to ``BITS`` values whose signs are the code, by iterative quantisation.

    Vectors of fewer dimensions than bits get several rotations, each from a start of its own.
    """
    dim = seen.shape[1]
    rng = np.random.default_rng(11)
    unit = _unit(seen)[0]
    _, main = np.linalg.eigh(unit.T @ unit)
    main = main[:, ::-1][:, :BITS]
    small, parts = unit @ main, []
    while sum(p.shape[1] for p in parts) < BITS:
        turn = np.linalg.qr(rng.normal(size=(main.shape[1],) * 2))[0]
        for _ in range(30 if len(seen) else 0):
            left, _, right = np.linalg.svd(np.where(small @ turn > 0, 1.0, -1.0).T @ small)
            turn = right.T @ left.T
        parts.append(main @ turn)
    return np.concatenate(parts, 1)[:, :BITS].reshape(dim, BITS)


def encode(vecs: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits(_unit(vecs)[0] @ projection > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _unit(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length one; vectors times a power of two (so that no square over- or underflows), and their lengths."""
    _, exponent = np.frexp(np.abs(vecs).max(1, initial=0.0))
    scaled = np.ldexp(vecs, -exponent[:, None])
    length = np.sqrt((scaled * scaled).sum(1))
    return scaled / np.where(length > 0, length, 1)[:, None], scaled, length


def radii(seen: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """For ``STEPS`` + 1 cosines from -1 to 1 the radius that holds ``SURE`` of the pairs at that cosine.

    The pairs are vectors of the sample and vectors at just that angle from them, in the direction of
    another one."""
    rng = np.random.default_rng(12)
    if not len(seen):
        return np.full(STEPS + 1, BITS)
    a, b = (_unit(seen[rng.integers(0, len(seen), PAIRS)])[0] for _ in range(2))
    b = b - (a * b).sum(1, keepdims=True) * a
    b = np.where(np.abs(b).max(1, keepdims=True) > 1e-6, b, rng.normal(size=b.shape))
    b = _unit(b - (a * b).sum(1, keepdims=True) * a)[0]
    code = encode(a, projection)
    out = np.zeros(STEPS + 1, np.int64)
    for at, cosine in enumerate(np.linspace(-1, 1, STEPS + 1)):
        differ = np.bitwise_count(code ^ encode(cosine * a + np.sqrt(1 - cosine * cosine) * b, projection))
        out[at] = np.ceil(np.quantile(differ, SURE))
    return np.maximum.accumulate(out[::-1])[::-1]


def probe(index: list[tuple[np.ndarray, np.ndarray, np.ndarray]], codes: np.ndarray, code: int, radius: int) -> np.ndarray:
    """Positions of all ``codes`` within ``radius`` bits of ``code``.

    ``index``: for each substring its different values, the positions of codes by value, and the number
    of codes of each value."""
    if radius >= BITS:
        return np.arange(len(codes))
    near, more = divmod(radius, PARTS)
    hit = np.zeros(len(codes), bool)
    for part, (different, order, count) in enumerate(index):
        within = near if part <= more else near - 1
        mine = np.uint16(code >> (PART_BITS * part) & 0xFFFF)
        hit[order[np.repeat(np.bitwise_count(different ^ mine) <= within, count)]] = True
    found = np.flatnonzero(hit)
    return found[np.bitwise_count(codes[found] ^ np.uint64(code)) <= radius]


def substrings(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The index that ``probe`` reads."""
    out = []
    for part in codes.view(np.uint16).reshape(-1, PARTS).T:
        order = np.argsort(part, kind="stable")
        different, count = np.unique(part, return_counts=True)
        out.append((different, order, count))
    return out


class _Searches:
    """A block of queries and the nearest rows that each has met."""

    def __init__(self, mine: dict, kind: str, dim: int, nearest: int, radius: np.ndarray):
        self.block, self.nearest, self.radius, self.kind, self.dim = mine["block"].as_py(), nearest, radius, kind, dim
        self.ids, self.codes = vectors.values(mine["id"], "i8"), vectors.values(mine["code"], "u8")
        _, self.scaled, self.length = _unit(vectors.values(mine["vec"], kind, dim).astype(np.float64))
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.ids]

    def meet(self, theirs: dict) -> None:
        ids, codes = vectors.values(theirs["id"], "i8"), vectors.values(theirs["code"], "u8")
        _, scaled, length = _unit(vectors.values(theirs["vec"], self.kind, self.dim).astype(np.float64))
        index = substrings(codes)
        for at, best in enumerate(self.best):
            full = len(best) == self.nearest
            radius = int(self.radius[max(0, int((1 - best[-1][0]) / 2 * STEPS))]) if full else BITS
            found = probe(index, codes, int(self.codes[at]), radius)
            found = found[ids[found] != self.ids[at]]
            # The sum of each row is taken alone, so equal vectors have equal scores to the last bit.
            score = (scaled[found] * self.scaled[at]).sum(1) / (length[found] * self.length[at])
            if full:
                near = score >= -best[-1][0]
                found, score = found[near], score[near]
            top = np.lexsort((ids[found], -score))[: self.nearest]
            if len(top):
                self.best[at] = sorted(best + list(zip((-score[top]).tolist(), ids[found[top]].tolist(), strict=True)))[: self.nearest]

    def rows(self) -> pa.RecordBatch:
        flat = [{"down": d, "id": i} for best in self.best for d, i in best]
        ends = np.cumsum([0, *map(len, self.best)])
        kind = pa.struct([("down", pa.float64()), ("id", pa.int64())])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
        n = len(self.ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.block)), pa.array(np.arange(n)), pa.array(self.ids), lists], names=["block", "place", "query_id", "best"])


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``nearest`` rows found for each row that ``is_query`` (a
    condition on the columns of ``rows``) holds for, by cosine in double precision, ties to smaller ids.

    Rows without an id, or whose vector is null, zero or has null or non-finite components, take no part.
    Shorter vectors are filled up with zeros. Rows with a query's id are its own and are left out; other
    repeated rows each count, and a repeated query row is answered each time. Where there are fewer than
    ``nearest`` rows all are returned; an empty table gives an empty table. Other columns are ignored.
    """
    kind = "f4" if "float" in rows.schema[vec_col].dataType.simpleString() else "f8"
    vec = F.col(vec_col).cast("array<double>")
    marked = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).cast("long").alias("asks"), vec.alias("vec"))
    taking_part = marked.where(F.col("id").isNotNull() & vectors.usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    dim = taking_part.agg(F.max(F.size("vec"))).first()[0] or 1
    seen = vectors.sample(taking_part.select("id", "vec"), dim)
    projection = fit(seen)
    model = taking_part.sparkSession.sparkContext.broadcast((projection, radii(seen, projection)))  # 64 doubles a dimension

    def make(found: np.ndarray) -> list[pa.Array]:
        packed = pa.array([x.tobytes() for x in found.astype(kind)], pa.binary())
        return [pa.array(encode(found, model.value[0]).view(np.int64)), packed]

    def blocks(part: DataFrame, size: int) -> DataFrame:
        coded = vectors.to_rows(part.select("id", "vec"), dim, make, "code long, packed binary").withColumnRenamed("packed", "vec")
        return materialise(vectors.pack(coded, size), "vector-blocks")

    schema = "block long, place long, query_id long, best array<struct<down double, id long>>"
    asking, asked = blocks(taking_part.where("asks = 1"), vectors.QUERY_BLOCK), blocks(taking_part, vectors.ROW_BLOCK)
    parts = vectors.each_pair(asking, asked, lambda mine: _Searches(mine, kind, dim, nearest, model.value[1]), schema)
    # One list from each task that a query met, so few.
    best = parts.groupBy("block", "place").agg(F.first("query_id").alias("query_id"), F.flatten(F.collect_list("best")).alias("best"))
    ranked = best.select("query_id", F.posexplode(F.slice(F.array_sort("best"), 1, nearest)).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.down")).alias("score"))
