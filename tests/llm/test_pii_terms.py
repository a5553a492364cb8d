"""Disclosing terms: every occurrence in every text, and those of rare entities."""

from __future__ import annotations

from chatloom.llm import pii

FILLER = [f"the weather of day {i} was fair and mild for everyone who went to the market in town yesterday" for i in range(3000)]


def test_terms_go_wherever_they_occur(spark):
    telling = [f"note {i} says that Zebulon may write to boss@corp.com about item {i} soon" for i in range(6)]
    far = ["yesterday ZEBULON went to the market", "the market day of zebulon, and Zebulonia"]
    docs = spark.createDataFrame(list(enumerate(FILLER + telling + far)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert [clean[3006], clean[3007]] == ["yesterday [WORD] went to the market", "the market day of [WORD], and Zebulonia"]
    assert not [t for t in clean.values() if "zebulon " in t.lower()]
    assert all(clean[i] == t for i, t in enumerate(FILLER))


def test_terms_of_rare_entities(spark):
    """An address that occurs once: the name beside it, seen nowhere else, goes; common words stay."""
    rows = FILLER + ["the day Quenby was in town for rare@corp.com and everyone was mild"]
    clean = pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("doc_id = 3000").first().text
    assert clean == "the day [WORD] was in town for [EMAIL] and everyone was mild"


def test_frequent_words_leave_the_count_early(spark, monkeypatch):
    """Each text is counted in one round, and the last round asks for no word that a part of the texts has shown to be frequent."""
    asked, count = [], pii._term_counts

    def noted(docs, terms, text_col):
        asked.append((docs.count(), {r.term for r in terms.collect()}))
        return count(docs, terms, text_col)

    monkeypatch.setattr(pii, "_term_counts", noted)
    rows = [*FILLER, "the day Quenby was in town for rare@corp.com and everyone was mild", None]
    found = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("doc_id = 3000").first()
    assert [(s.kind, s.start) for s in found.spans if s.kind not in pii.KINDS] == [("term_generalised", 8)]
    assert sum(n for n, _ in asked) == len(rows) and asked[0][1] >= {"town", "mild", "quenby"}
    assert asked[-1][1] == {"quenby"}
