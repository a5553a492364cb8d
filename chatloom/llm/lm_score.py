"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

Documents are dealt into blocks of bounded size. Each block sends its distinct n-grams with their
counts, as packed arrays, to the buckets of a count table that is partitioned by n-gram hash; a bucket
adds up and answers each block, and the block sums the scores of its documents. A frequent n-gram is
thus one entry per block, not one row per occurrence, and nothing but blocks and buckets is ever held.
This is the join of the count table with the exploded n-grams in packed form: a row holds the n-grams of
one block that fall into one bucket, so there are never more rows than distinct n-grams of the blocks,
and their bytes grow with the corpus. N-grams are told apart by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, texts_of

ALPHA = 0.4
LEAST_COUNT = 2
BLOCK_BYTES = BUCKET_BYTES = 8 << 20
#: The key under which the number of all words is counted.
_TOTAL = 0


class _Block:
    """The n-grams of a block's texts: for each order the key of the n-gram that ends at each word (0
    where the document has too few words before), and the distinct keys with their counts."""

    def __init__(self, texts: list[bytes], order: int, piece: int = 1 << 20):
        docs = [b" ".join(t.split()) for t in texts]
        self.n_docs = len(docs)
        full = [i for i, d in enumerate(docs) if d]
        doc, keys = [np.zeros(0, np.int64)], [np.zeros((order, 0), np.uint64)]
        at = 0
        while at < len(full):
            end, size = at, 0
            while end < len(full) and (end == at or size + len(docs[full[end]]) <= piece):
                size += len(docs[full[end]])
                end += 1
            words = WordHashes([docs[i] for i in full[at:end]])
            n = len(words.doc)
            rows = np.zeros((order, n), np.uint64)
            for k in range(1, min(order, n) + 1):
                rows[k - 1, k - 1 :] = np.where(words.doc[k - 1 :] == words.doc[: n - k + 1], np.maximum(words.sequences(k), np.uint64(1)), 0)
            doc.append(np.array(full[at:end])[words.doc])
            keys.append(rows)
            at = end
        self.doc, self.keys = np.concatenate(doc), np.concatenate(keys, 1)
        self.distinct, self.place, counts = np.unique(self.keys, return_inverse=True, return_counts=True)
        self.place = self.place.reshape(self.keys.shape)
        if len(self.distinct) and self.distinct[0] == _TOTAL:
            counts[0] = len(self.doc)
        else:
            self.distinct, counts = np.concatenate([np.zeros(1, np.uint64), self.distinct]), np.concatenate([[len(self.doc)], counts])
            self.place = self.place + 1
        self.counts = counts.astype(np.uint64)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that hold some of the sorted keys, and where each one's keys begin (and the end)."""
        bucket = ((self.distinct >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        found, first = np.unique(bucket, return_index=True)
        return found, np.concatenate([first, [len(bucket)]])


def _packed(values: np.ndarray) -> tuple[bytes, int]:
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return values.astype(kind).tobytes(), kind.itemsize


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.uint64)


def _send(table: pa.Table, order: int, n_buckets: int) -> pa.Table:
    batch = table.combine_chunks().to_batches()[0]
    block = _Block(texts_of(batch, "t"), order)
    found, edge = block.buckets(n_buckets)
    keys, counts, widths = [], [], []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        data, width = _packed(block.counts[a:b])
        keys.append(block.distinct[a:b].tobytes())
        counts.append(data)
        widths.append(width)
    home = [batch.column("block")[0].as_py()] * len(found)
    return pa.table({"bucket": pa.array(found.astype(np.int64)), "block": pa.array(home, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary()), "width": pa.array(widths, pa.int32())})


def _add_up(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(k, "<u8") for k in table["keys"].to_pylist()]
    counts = [_unpacked(c, w) for c, w in zip(table["counts"].to_pylist(), table["width"].to_pylist(), strict=True)]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(place.max() + 1, np.uint64)
    np.add.at(total, place, np.concatenate(counts))
    answers = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
    packed = [_packed(a) for a in answers]
    return pa.table({"bucket": table["bucket"], "block": table["block"], "totals": pa.array([p for p, _ in packed], pa.binary()), "width": pa.array([w for _, w in packed], pa.int32())})


def _score(docs: pa.Table, answers: pa.Table, order: int, n_buckets: int, alpha: float, least: int) -> pa.Table:
    batch = docs.combine_chunks().to_batches()[0]
    block = _Block(texts_of(batch, "t"), order)
    found, edge = block.buckets(n_buckets)
    total = np.zeros(len(block.distinct), np.float64)
    where = {b: (s, e) for b, s, e in zip(found.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
    for b, data, width in zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), answers["width"].to_pylist(), strict=True):
        s, e = where[b]
        total[s:e] = _unpacked(data, width)
    n = len(block.doc)
    count = total[block.place]
    with np.errstate(divide="ignore"):
        score = np.log(count[0] / total[0]) if n else np.zeros(0)
    backed_off = np.zeros(n, bool)
    for k in range(2, order + 1):
        there = block.keys[k - 1] != 0
        known = there & (count[k - 1] >= least)
        context = np.concatenate([[1.0], count[k - 2][:-1]]) if n else np.zeros(0)
        score = np.where(known, np.log(np.maximum(count[k - 1], 1) / np.maximum(context, 1)), np.where(there, np.log(alpha) + score, score))
        backed_off = there & ~known
    by_doc = np.bincount(block.doc, minlength=block.n_docs)
    sums = np.bincount(block.doc, score, minlength=block.n_docs)
    off = np.bincount(block.doc[backed_off], minlength=block.n_docs)
    mean = pa.array(np.where(by_doc > 0, sums / np.maximum(by_doc, 1), 0.0), mask=by_doc == 0)
    return pa.table({"i": batch.column("i"), "n_words": pa.array(by_doc.astype(np.int64)), "n_backed_off": pa.array(off.astype(np.int64)), "score": mean})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, alpha: float = ALPHA, least: int = LEAST_COUNT) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_backed_off, score (mean natural logarithm per word).

    Words are what ASCII white space separates, unchanged. An n-gram of two words or more counts if
    the corpus has it ``least`` times; then its count is divided by that of its first words, else the
    next shorter n-gram's score is multiplied by ``alpha``. A single word's score is its share of all
    words. Null and empty texts have no words and a null score. Repeated rows and null ids each count
    and get a row. Other columns are ignored. An empty table gives an empty table.

    Texts are shuffled once (both uses share the exchange); two numbers come to the driver.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks, n_buckets = size // BLOCK_BYTES + 1, size // BUCKET_BYTES + 1
    block = F.pmod(F.xxhash64(id_col, text_col, "_row"), F.lit(n_blocks)).alias("block")  # equal rows are spread
    source = docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), block)
    sent = source.groupBy("block").applyInArrow(lambda t: _send(t, order, n_buckets), "bucket long, block long, keys binary, counts binary, width int")
    answers = sent.groupBy("bucket").applyInArrow(_add_up, "bucket long, block long, totals binary, width int")
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, order, n_buckets, alpha, least)

    scored = source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"i {kind}, n_words long, n_backed_off long, score double")
    return scored.withColumnRenamed("i", id_col)
