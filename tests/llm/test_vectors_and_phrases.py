"""Searches over embeddings and phrase mining against brute-force versions, with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chatloom.llm import ann_search, collocations, hard_negatives, vectors
from chatloom.llm.queries import ORACLES, QUERIES

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"
#: A null id, label, vector and component; other non-finite, zero, empty and short vectors; repeats and ties; vast and tiny values.
AWKWARD = [
    (0, [1.0, 0.0, 0.5], 1), (0, [0.5, 0.5, 0.0], 1), (100, [1.0, 0.0, 0.5], 1), (None, [1.0, 0.0, 0.5], 1), (1, None, 1), (2, [1.0, None, 0.5], 2), (3, [NAN, 1.0, 0.0], 2), (4, [INF, 1.0, 0.0], 1),
    (5, [0.0, 0.0, 0.0], 2), (6, [], 2), (7, [1.0], 9), (8, [1.0, 0.0], None), (9, [1e300, 1e300, 0.0], 3), (10, [1e-300, 0.0, 1e-300], 1), (11, [2.0, 0.0, 1.0], 1), (12, [2.0, 0.0, 1.0], 2), (12, [2.0, 0.0, 1.0], 2),
    (13, [-1.0, 0.0, -0.5], 1), (14, [0.4, 0.1, 0.2], 2), (15, [0.45, 0.0, 0.2], 3), (16, [0.6, 0.0, 0.1], None), (200, [-1.0, 0.0, 0.0], 2), (50, [0.3, 0.2, 0.1], 3),
]


def finite(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("id", "vec", "asks", "block", "place", "score", "rank", "best", "cell", "n", "shard")})


def cosines(rows, every):
    """For each query row: its id and (score, id) of all others, best first."""
    kept = [(i, np.array(v)) for i, v, _ in rows if i is not None and finite(v) and any(v)]
    for q, a in kept:
        if q % every == 0:
            found = []
            for i, b in kept:
                if i != q:
                    n = max(len(a), len(b))
                    x, y = (np.pad(v, (0, n - len(v))) / np.abs(v).max() for v in (a, b))
                    found.append((-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i))
            yield q, sorted(found)


def test_search_awkward(spark):
    df = clashing(spark.createDataFrame(AWKWARD, SCHEMA).repartition(3))
    got = defaultdict(list)
    for r in ann_search.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r["id"], r.score))
    want = defaultdict(list)
    for q, found in cosines(AWKWARD, 50):
        want[q] += [-s for s, _ in found[:5]]
    assert set(got) == set(want) == {0, 50, 100, 200}
    for q, found in got.items():
        assert sorted(s for *_, s in found) == pytest.approx(sorted(want[q]))
        assert Counter(r for r, *_ in found) == {r: 2 if q == 0 else 1 for r in range(1, 6)}  # id 0 has two rows
    # Equal directions: smaller ids first, a repeated row twice.
    assert [i for _, i, _ in sorted(got[100])][:4] == [0, 11, 12, 12]


def test_search_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1)], SCHEMA)
    assert [(r.query_id, r["rank"], r["id"]) for r in ann_search.search(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert ann_search.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_many_copies_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 200)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    vecs = centres[rng.integers(0, 40, 2000)] + 0.15 * rng.normal(size=(2000, 24))
    vecs[::3] = centres[0]  # a third are copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vecs)]
    got = defaultdict(list)
    for r in ann_search.search(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r["id"], r.score))
    hits = total = 0
    for q, found in cosines(rows, 50):
        if q % 3 == 0:
            assert [i for _, i, _ in sorted(got[q])] == [i for i in range(0, 2000, 3) if i != q][:5]
        hits += len({i for _, i in found[:5]} & {i for _, i, _ in got[q]})
        total += 5
    assert hits >= 0.95 * total


def test_search_recall_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in QUERIES["op11_ann_search"](spark, sf_dir).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, found in cosines(rows, 50):
        score = {i: -s for s, i in found}
        assert [r for r, *_ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in got[q])
        hits += len({i for _, i in found[:5]} & {i for _, i, _ in got[q]})
        total += 5
    assert hits >= 0.9 * total


def test_probe_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 64, 3000, np.uint64)
    codes[:1500] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    index = ann_search.substrings(codes)
    for radius in (0, 1, 2, 3, 5, 17, 26, 40, 63, 64):
        for code in (int(codes[0]), int(codes[2000])):
            want = np.flatnonzero(np.bitwise_count(codes ^ np.uint64(code)) <= radius)
            assert ann_search.probe(index, codes, code, radius).tolist() == want.tolist()


def mined(rows, every=100, scale=256, positives=5, negatives=10, low=30, high=90):
    """The contract's rule with whole numbers of any size."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and finite(v)]
    for a, x, own in kept:
        if a % every:
            continue
        scored = sorted((-sum(map(int.__mul__, x, y)), i, label) for i, y, label in kept if i != a)
        clip = 1 << 62
        scored = sorted((max(-clip, min(clip, s)), i, label) for s, i, label in scored)
        for p, positive, _ in [s for s in scored if s[2] == own][:positives]:
            fits = [(n, i) for n, i, label in scored if label != own and -low * p <= -100 * n <= -high * p]
            for rank, (n, i) in enumerate(fits[:negatives], 1):
                yield a, positive, rank, i, -p, -n


def found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("vast", [True, False])
def test_negatives_awkward(spark, vast):
    rows = [r for r in AWKWARD if vast or r[0] != 9]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = Counter(mined(rows))
    assert want and found(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == want
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_negatives_many_cells_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 150)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "BATCH", 16)
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(30, 9))[rng.integers(0, 30, 1200)] + 0.2 * rng.normal(size=(1200, 9))
    vecs[::3] = vecs[0]  # a third in one cell
    rows = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(vecs, rng.integers(0, 4, 1200), strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == Counter(mined(rows))
    # labels that are no numbers
    assert found(hard_negatives.mine(df.withColumn("label", F.concat(F.lit("x"), "label")), F.col("vec_id") % 100 == 0)) == Counter(mined(rows))


def test_heap_falls_and_stops():
    rng = np.random.default_rng(4)
    left, right = (np.sort(rng.normal(size=n))[::-1] for n in (7, 5))
    got = list(hard_negatives.descending(left, right))
    assert [s for s, *_ in got] == sorted((a + b for a in left for b in right), reverse=True)
    assert len({x[1:] for x in got}) == 35


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def phrases_of(docs, least, top, covered=100):
    """The contract's rule, counting every phrase."""
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in words_of(text):
            total[lang] += len(ws)
            count.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    candidates = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, ws), a in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if 100 * a >= covered * candidates[lang, ws[i : i + k]]:
                    gone.add((lang, ws[i : i + k]))
    by_lang = defaultdict(list)
    for (lang, ws), a in candidates.items():
        if (lang, ws) not in gone:
            cuts = [(1000 * a * total[lang] // (count[lang, ws[:k]] * count[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            by_lang[lang].append((-score, -a, " ".join(ws).encode(), count[lang, ws[:k]], count[lang, ws[k:]]))
    for lang, rows in by_lang.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, total[lang], -score


def table(df):
    return Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(5)
    words = ["the", "The", "of", "a", "ü", "日本", "x\x00y", "New", "york", "a\xa0b", "\x1c", "it's", "zz"] + [f"w{i}" for i in range(60)]
    docs = []
    for i in range(400):
        text = "".join(rng.choice(words[: rng.choice((4, 12, 73))]) + rng.choice((" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", ";")) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(("en", "en", "fr", "", None)), text))
    return docs + [("en", None), (None, ""), ("en", " \t\n"), ("en", "the the the the the the the"), ("fr", "New York City is. " * 500), ("en", "b" * 3_000_000 + " the of a")] + docs[:50]


@pytest.mark.parametrize("shard", [1 << 18, 7])
def test_collocations(spark, chatter, shard):
    rows = chatter[:120] if shard == 7 else chatter
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("n", "word", "phrase", "number", "codes", "found", "at", "part", "total", "a", "l", "r", "score", "rank")})
    least, top = (6, 40) if shard == 7 else (8, 300)
    want = Counter(phrases_of(rows, least, top))
    assert len(want) > 20 and any(x[2].count(" ") >= 2 for x in want)
    assert table(collocations.collocations(df, least=least, top=top, shard=shard)) == want


def test_collocations_bounds(spark, chatter):
    rows = chatter[:150]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert table(collocations.collocations(df, least=4, top=50, covered=60)) == Counter(phrases_of(rows, 4, 50, 60))
    assert collocations.collocations(df, least=10**6).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 a n alone passes 64 bits."""
    a, n = 9 * 10**12, 8 * 10**15
    got = spark.sql(f"SELECT (1000 * CAST({a}L AS DECIMAL(19,0)) * CAST({n}L AS DECIMAL(19,0))) div (CAST({a}L AS DECIMAL(19,0)) * CAST({a + 1}L AS DECIMAL(19,0))) AS x").first().x
    assert got == 1000 * a * n // (a * (a + 1))


def test_trie_of_shared_prefixes():
    rng = np.random.default_rng(6)
    rows = np.unique(rng.integers(1, 40, (900, 3)).astype(np.int32), axis=0)
    rng.shuffle(rows)
    trie = collocations.Trie(rows)
    place = {tuple(r): i for i, r in enumerate(rows.tolist())}
    codes = rng.integers(0, 45, 20_000).astype(np.int32)
    want = {i: place[t] for i, t in enumerate(zip(codes.tolist(), codes[1:].tolist(), codes[2:].tolist(), strict=False)) if t in place}
    at, number = trie.ends(codes)
    assert dict(zip(at.tolist(), number.tolist(), strict=True)) == want


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_collocations"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("embeddings", "documents"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = connection.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got[want.columns].astype(str).values.tolist())) == Counter(map(tuple, want.astype(str).values.tolist()))


def test_phrase_arrays_are_bounded_in_memory(spark, monkeypatch):
    """A partition of 30 MB of text becomes small row groups, and travels to Python in small batches."""
    setting, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], collocations.materialise
    before = spark.conf.get(setting)

    def noted(df, *rest):
        seen.append(int(spark.conf.get(setting).removesuffix("b")))
        out = write(df, *rest)
        sizes.extend(meta.row_group(i).total_byte_size for f in out.inputFiles() for meta in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(meta.num_row_groups))
        return out

    sizes: list[int] = []
    monkeypatch.setattr(collocations, "materialise", noted)
    word = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", i), F.lit(200)).cast("string")))
    docs = spark.range(300).coalesce(1).select(F.lit("en").alias("lang"), F.concat(F.lit("alpha beta "), F.array_join(word, " ")).alias("text"))
    got = {r.phrase: r.a for r in collocations.collocations(docs, least=300, longest=2).collect()}
    assert got == {"alpha beta": 300}
    assert len(seen) >= 5 and max(seen) <= 4 << 20 and spark.conf.get(setting) == before
    assert sum(sizes) > 16 << 20 > max(sizes)
