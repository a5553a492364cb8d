"""Token-id store: fixed-width bit packing with block offsets.

Ids are stored in the fewest bits that the vocabulary needs. A file holds blocks of a fixed number of
ids, each padded to a whole byte, and an index of block offsets, document ids and document starts:

    magic (8 bytes) | blocks | index arrays | footer (json) | footer length (uint32) | magic

The index arrays are little-endian: block offsets (uint64), document ids (int64), document starts in
ids (int64, one more than documents), null flags of the document ids (uint8). Any document can be read
by fetching only its blocks; whole blocks unpack by numpy without a loop over ids.

Files are written by the executors, one for each range of document ids, to a folder that all machines
share. A writer gives its file a name of its own and reports it in a manifest that Spark writes; files
of failed or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, pieces

MAGIC = b"TOKPACK1"
BLOCK = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


#: Widths of whole machine integers, which need no shifting.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bits of ``width`` per id, padded to a whole byte."""
    if width in _WHOLE:
        return ids.astype(_WHOLE[width]).tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """``n`` ids of ``width`` (32 at most) bits as uint32."""
    if width in _WHOLE:
        return np.frombuffer(data, _WHOLE[width], n).astype(np.uint32)
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(n, dtype=np.int64) * width
    byte, bit = at >> 3, (at & 7).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range((width + 7 + 7) // 8):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> bit) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    """Streams documents to one file; memory holds one block and the index."""

    def __init__(self, out, vocabulary: int, block: int = BLOCK):
        self.out, self.width, self.vocabulary, self.block = out, bits_for(vocabulary), vocabulary, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets, self.docs, self.starts = [len(MAGIC)], [], [0]
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.held])
        end = len(ids) if all_of_it else len(ids) // self.block * self.block
        for start in range(0, end, self.block):
            data = pack(ids[start : min(end, start + self.block)], self.width)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> int:
        """The number of ids in the file."""
        self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8)
        arrays = [np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), np.array(self.starts, "<i8"), null]
        for a in arrays:
            self.out.write(a.tobytes())
        footer = {"width": self.width, "vocabulary": self.vocabulary, "block": self.block, "blocks": len(self.offsets) - 1, "docs": len(self.docs), "ids": self.n_ids}
        text = json.dumps(footer).encode()
        self.out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        return self.n_ids


class Reader:
    """Random access to one file by document number."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._read(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file, or not complete")
        length = int.from_bytes(tail[:4], "little")
        meta = json.loads(self._read(size - 12 - length, length))
        self.width, self.block, self.n_docs, self.n_ids = meta["width"], meta["block"], meta["docs"], meta["ids"]
        counts = (("<u8", meta["blocks"] + 1), ("<i8", self.n_docs), ("<i8", self.n_docs + 1), ("u1", self.n_docs))
        at = size - 12 - length - sum(np.dtype(t).itemsize * n for t, n in counts)
        arrays = []
        for t, n in counts:
            arrays.append(np.frombuffer(self._read(at, np.dtype(t).itemsize * n), t))
            at += np.dtype(t).itemsize * n
        self.offsets, docs, self.starts, null = arrays
        self.docs = [None if x else d for d, x in zip(docs.tolist(), null.tolist(), strict=True)]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the file; reads only the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block + 1
        data = self._read(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        base = self.offsets[first]
        parts = [unpack(data[int(self.offsets[b] - base) : int(self.offsets[b + 1] - base)], min(self.block, self.n_ids - b * self.block), self.width) for b in range(first, last)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, start in the file and ids of each document, in order."""
        k = 0
        while k < self.n_docs:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once)) - 1)
            ids = self.ids(int(self.starts[k]), int(self.starts[end]))
            for i in range(k, end):
                yield self.docs[i], int(self.starts[i]), ids[self.starts[i] - self.starts[k] : self.starts[i + 1] - self.starts[k]]
            k = end


def _open(path: str, how: str):
    place, inner = fs.FileSystem.from_uri(path)
    if how == "w":
        place.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return place.open_output_stream(inner, compression=None)
    return place.open_input_file(inner)


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library whose words end at white space.

    White space separates words and yields no ids in this vocabulary, so each distinct word of the
    texts is encoded once. Words of printable ASCII and common Latin letters, the bulk, go to the
    library's merge model in the same parts and the same byte letters that its own pre-tokenizer makes;
    all others, and those with a string of the vocabulary's special tokens, go through the whole library.
    """

    #: Latin letters that stand for themselves in normal form and have one lower-case letter.
    _LATIN = "À-ÖØ-öø-ÿĀ-įĴ-ňŊ-ž"
    _PLAIN = re.compile(f"[!-~{_LATIN}]+")
    _PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
    #: Byte letters: visible Latin-1 characters stand for their byte, the other bytes take the letters from 256 on.
    _VISIBLE = frozenset((*range(33, 127), *range(161, 173), *range(174, 256)))
    _BYTES = dict(zip(sorted(set(range(256)) - _VISIBLE), range(256, 512), strict=False))  # noqa: RUF012
    REMEMBERED = 250_000  # words, and as many parts; then it starts afresh

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.parts: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self._BYTES)
            ids = self.parts[part] = self._bytes([t.id for t in self.library.model.tokenize(letters)])
        return ids

    def _plain_word(self, word: str) -> bytes:
        word = word.lower()
        return self._part(word) if word.isalpha() else b"".join(map(self._part, self._PARTS.findall(word)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.encode().split() for t in texts]
        known, other, plain = self.words, [], self._PLAIN.fullmatch
        for word in set().union(*split).difference(known):
            text = word.decode()
            if plain(text) and not any(s in text for s in self.special):
                known[word] = self._plain_word(text)
            else:
                other.append(text)
        for start in range(0, len(other), 10_000):
            some = other[start : start + 10_000]
            for word, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[word.encode()] = self._bytes(e.ids)
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for memory in (known, self.parts):
            if len(memory) > self.REMEMBERED:
                memory.clear()
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def write(docs: DataFrame, path: str, make_encoder: Callable[[], WordEncoder], vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", per_file: int = 16_384) -> DataFrame:
    """Encode and store ``docs`` under ``path`` in ascending order of ids; returns the manifest.

    The manifest has one row a file: number (order of the files), file, n_docs, n_ids, start (ids of
    all files before). Rows with a null id come first; rows that share an id are ordered by text, null
    texts (encoded as empty) first. Documents of one id stay in one file. Files hold about
    ``per_file`` documents; Spark's range partitioning deals them out, so texts are shuffled once. An
    empty table gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    n_files = max(1, -(-docs.count() // per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = make_encoder(), np.array([end_id], np.uint32)
        number = TaskContext.get().partitionId()
        name = f"{path}/{number:08d}-{uuid.uuid4().hex}.tok"
        out = sink = None
        for batch in pieces(batches, "t"):
            if out is None:
                sink = _open(name, "w")
                out = Writer(sink, vocabulary)
            ids = encoder.encode([t or "" for t in batch.column("t").to_pylist()])
            for doc, data in zip(batch.column("i").to_pylist(), ids, strict=True):
                out.add(doc, np.concatenate([np.frombuffer(data, "<u4"), end]))
        if out is not None:
            n_ids = out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "file": [name], "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    dealt = rows.repartitionByRange(n_files, "i").sortWithinPartitions("i", "t")
    manifest = materialise(dealt.mapInArrow(run, "number int, file string, n_docs long, n_ids long"), "tokens-manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialise(manifest.withColumn("start", before), "tokens-manifest")  # one row a file


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every stored document: doc_id, start (ids of all documents before), ids (binary, little-endian
    unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with _open(name, "r") as file:
                    held: list[tuple] = []
                    for doc, start, ids in Reader(file, file.size()).documents():
                        held.append((doc, base + start, ids.astype("<u4").tobytes()))
                        if len(held) == 1024:
                            yield _rows(held)
                            held = []
                    if held:
                        yield _rows(held)

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files, "file").mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    doc, start, ids = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids, of what ``read`` gave."""
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


