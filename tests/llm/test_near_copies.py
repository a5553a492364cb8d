"""The near-duplicate stage on planted near copies, and against brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from chatloom.llm import near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def check(rows, kept):
    """No two similar documents are kept, and each that is gone is similar to a smaller id's."""
    sets = {d: shingles(t) for d, t in rows}
    survivors = sorted(kept)
    assert not [(a, b) for i, a in enumerate(survivors) for b in survivors[:i] if similar(sets[a], sets[b])]
    assert all(any(similar(sets[d], sets[e]) for e in sets if e < d) for d in sets.keys() - kept)


def test_stage_drops_planted_near_copies(spark, sf_dir):
    r = random.Random(1)
    rows = []
    for g in range(20):
        text = [f"w{r.randint(0, 3000)}" for _ in range(200)]
        rows.append((g, " ".join(text)))
        for k, edits in enumerate((1, 2, 3)):  # 5 shingles of 196 for each edit: similarity 0.95, 0.90, 0.86
            words = list(text)
            for at in range(edits):
                words[20 + 50 * at + r.randint(0, 9)] = f"x{g}-{k}-{at}"
            rows.append((1000 + 10 * g + k, " ".join(words)))
        words = list(text)
        for at in range(9):
            words[10 + 20 * at] = f"y{g}-{at}"  # 45 shingles of 196 differ: similarity 0.63
        rows.append((2000 + g, " ".join(words)))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = {x.doc_id for x in stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sf_dir).collect()}
    assert kept == {d for d, _ in rows if d < 1000 or d >= 2000}


def test_query_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    kept = {x.doc_id for x in simhash.keep_first(docs).collect()}
    check(rows, kept)
    assert not {145, 177} & kept or sf_dir[-5:] != "0.001"


@pytest.mark.parametrize("limit", [3, 2048])
def test_buckets_of_documents_that_are_not_similar(spark, monkeypatch, limit):
    """Compared by one task, and by leaders; rows that are repeated stay as often as they are there."""
    monkeypatch.setattr(near_copies, "SMALL_ROWS", limit)
    r = random.Random(3)
    text, rows = [f"w{r.randint(0, 3000)}" for _ in range(200)], []
    for i in range(40):  # each differs from the common text in 5 to 60 of 196 shingles
        words = list(text)
        for at in r.sample(range(0, 200, 10), r.randint(1, 12)):
            words[at] = f"own{i}-{at}"
        rows.append((r.randint(0, 10**6), " ".join(words)))
    got = [x.doc_id for x in simhash.keep_first(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(5)).collect()]
    check(rows, set(got))
    assert sorted(got) == sorted(3 * list(set(got)))
    assert 1 < len(set(got)) < 40


def test_many_leaders_in_a_bucket(spark):
    """Chains of texts that drift apart: buckets of many documents that are not all similar."""
    r = random.Random(2)
    text, rows = [f"w{r.randint(0, 3000)}" for _ in range(120)], []
    for i in range(150):
        text = list(text)
        text[r.randint(0, 119)] = f"own{i}"
        rows.append((r.randint(0, 10**6), " ".join(text)))
    check(rows, {x.doc_id for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()})


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "word"), (5, "WORD "), (6, "a b c d"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, "A b c d e"), (9, "a b c e d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS i", "2 AS v", "3 AS node", "4 AS bucket")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted((x.doc_id or 0 for x in got.collect())) == [0, 1, 4, 6, 7, 7, 9]
