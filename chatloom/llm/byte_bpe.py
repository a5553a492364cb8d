"""Byte-level BPE by corpus-level merge replay.

The distinct pieces (matches of the split pattern) of all texts that a task holds are laid out in one
array of byte tokens. An inverted index goes from each adjacent token pair's rank to the positions
that hold it. The ranks are replayed in order; each applies to all its positions, and only the two
neighbours of a merged position get new index entries. The cost follows the distinct pieces and
their merges, not the length of the texts; no shuffle is needed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Distinct pieces whose encoding a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Distinct pieces that are replayed together; it bounds the index.
REPLAYED = 20_000


class _Pairs(dict):
    """Rank of the token that two adjacent tokens make, -1 if none; the key is ``left << 20 | right``."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        left, right = self.tokens.get(key >> 20), self.tokens.get(key & 0xFFFFF)
        rank = self[key] = -1 if left is None or right is None else self.ranks.get(left + right, -1)
        return rank


class MergeReplay:
    """Encodes distinct pieces by the ranks of a vocabulary file (one base64 token and rank a line)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pairs = _Pairs(self.ranks, self.tokens)
        self.edge = len(self.ranks)  # stands between words; no token
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.byte_pairs = np.array([[self.pairs[int(a) << 20 | int(b)] for b in self.byte] for a in self.byte])
        self.encoded: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: always the lowest rank first, from left to right within a word."""
        if not words:
            return []
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        edges = np.concatenate([[0], np.cumsum(length + 1)])
        start = self.byte[raw]
        start[edges] = self.edge
        rank_at = self.byte_pairs[raw[:-1], raw[1:]]
        rank_at[edges[:-1]] = rank_at[edges[1:] - 1] = -1
        order = np.argsort(rank_at, kind="stable")
        order = order[np.searchsorted(rank_at[order], 0) :]
        found, first = np.unique(rank_at[order], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(order, first[1:]), strict=True)} if len(order) else {}

        token, pairs = start.tolist(), self.pairs
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        queue = list(index)
        heapq.heapify(queue)
        push = heapq.heappush
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            places.sort()
            for at, i in enumerate(places):
                j = after[i]
                if token[i] < 0 or pairs[token[i] << 20 | token[j]] != rank:
                    continue  # a neighbour was merged meanwhile
                token[i] = rank
                token[j] = -1
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                right, left = pairs[rank << 20 | token[k]], pairs[token[h] << 20 | rank]
                if right >= 0:
                    if right in index:
                        index[right].append(i)
                    else:
                        index[right] = [i]
                        push(queue, right)
                if left >= 0:
                    if left in index:
                        index[left].append(h)
                    else:
                        index[left] = [h]
                        push(queue, left)
                if 0 <= right < rank or 0 <= left < rank:  # a lower rank appeared: it goes before the rest of this one
                    if rest := places[at + 1 :]:
                        if rank not in index:
                            index[rank] = []
                            push(queue, rank)
                        index[rank] += rest
                    break
        final = np.array(token)
        alive = final >= 0
        alive[edges] = False
        ends = (4 * np.cumsum(alive)[edges]).tolist()
        data = final[alive].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split, known = [self.split(t) for t in texts], self.encoded
        words, spelled = [], []
        for piece in {p for ps in split for p in ps}.difference(known):
            spelling = piece.encode()
            if (rank := self.ranks.get(spelling)) is not None:
                known[piece] = rank.to_bytes(4, "little")
            else:
                words.append(piece)
                spelled.append(spelling)
        for at in range(0, len(words), REPLAYED):
            known.update(zip(words[at : at + REPLAYED], self.replay(spelled[at : at + REPLAYED]), strict=True))
        out = [b"".join(map(known.__getitem__, ps)) for ps in split]
        for memory in (known, self.pairs):
            if len(memory) > REMEMBERED:
                memory.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def merge_replay(ranks_path: str, pattern: str) -> MergeReplay:
    """One for all tasks of a Python worker."""
    return MergeReplay(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, n_tokens, ids (binary, little-endian unsigned 32-bit), and with
    ``decode`` the bytes that the ids stand for.

    ``ranks_path`` is a vocabulary file that every executor has under this path. Null texts count as
    empty; empty texts have no ids. Repeated rows and null ids each get a row. Other columns are
    ignored. An empty table gives an empty table.
    """
    names = [id_col, "n_tokens", "ids", *(["decoded"] if decode else [])]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary" + (", decoded binary" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = merge_replay(ranks_path, pattern)
        for batch in pieces(batches, "t", 2 << 20):
            ids = replay.encode([t or "" for t in batch.column("t").to_pylist()])
            columns = [batch.column("i"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([replay.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, n_tokens, and SHA-256 of the ids and of the decoded bytes, of what ``encode`` made."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
