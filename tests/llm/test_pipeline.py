"""The pipeline against a brute-force version of its stages, over a whole small table."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from test_near_copies import check
from test_operators import LONG, base, encoded, hit, measures, reference_encoding  # noqa: F401

import corpus_pipeline
from chatloom.llm import pii, quality
from chatloom.llm.common import materialise


def test_stages(spark, sf_dir, request):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, states, stage = docs.columns, [docs.collect()], docs
    for name, apply in corpus_pipeline.STAGES[:4]:
        stage = materialise(apply(spark, stage, sf_dir), name)
        assert stage.columns == columns, name
        states.append(stage.collect())
    whole, good, unique, clean, private = ([(r.doc_id, r.text) for r in rows] for rows in states)
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert not [d for d, t in good if measures(t)[-1]] and {d for d, _ in good} == judged
    check(good, {d for d, _ in unique})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {x[0] for x in hit(unique, items) if x[5]}
    assert sorted(clean) == sorted(r for r in unique if r[0] not in dirty)
    got = {r.doc_id: r for r in states[4]}
    assert sorted(got) == sorted(d for d, _ in clean)
    for d, text in clean:
        new = got[d].text
        assert got[d].n_chars == len(new)
        spans = pii.base_spans(text)
        assert [f"{k}:{s}:{e}" for s, k, e in spans] == base(text)
        kept = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|REMOVED|WORD|NUMBER)\]", new)
        assert not base(new) if base(text) else True
        at = 0
        for part in kept:  # what is left stands in the text, in order
            at = text.index(part, at) + len(part)
        assert (len(kept) == 1) == (new == text) or "[" in text
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, final)) == sorted(encoded(private, request.getfixturevalue("reference_encoding")))


def test_awkward_documents_pass_all_stages(spark, sf_dir):
    """Null and repeated ids, null, empty and very long texts, and columns with clashing names."""
    rows = [(1, None), (2, ""), (None, "a null id with words enough to pass the rules of the first stage, I hope."), (3, LONG), (5, "one text of some length here, that is kept by all of the rules."), (5, "another text of some length here, which has the same id as the one."), (6, "one text of some length here, that is kept by all of the rules.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("i", "v", "node", "n", "bucket", "t", "added", "key", "kept", "fp")})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = materialise(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns, name
        left = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        assert (5, rows[4][1]) in left and (5, rows[5][1]) in left and (0, rows[2][1]) in left, name
        assert ((6, rows[6][1]) in left) == (name != "near_duplicates"), name


def test_redaction_of_overlapping_spans():
    assert pii.redact("to x@1.2.3.4 now", []) == "to [EMAIL] now"
    assert pii.redact("to x@1.2.3.4 now", [(13, "term_removed", 16)]) == "to [EMAIL] [REMOVED]"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_table(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert stage(spark, docs, sf_dir).collect() == []
