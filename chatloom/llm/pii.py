"""Personal data: base patterns, and information-theoretic sanitisation of what else reveals them.

Base spans (e-mail, IP, card, phone) are protected entities. A word near an entity can give it away
even when the entity itself is hidden. From counts over the whole corpus, with P(e) the entity's share
of all words and P(e | t) the share of the occurrences of word t that lie near e, the pointwise mutual
information log2(P(e | t) / P(e)) is what t tells of e; divided by the entity's information content
-log2 P(e) it is the disclosed share. For P(e | t) stands the lower bound of a Wilson interval over the
different contexts in which t was seen, so few contexts disclose less, but none is too few. Words that
disclose more than a threshold are removed wherever they occur in any text, those a little below it are
generalised. Copies of one passage are one context, so repetition alone makes nothing suspicious.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialise, pieces

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as near.
NEAR = 5
#: Normal quantile of the lower bound of P(e | t) (90 %, one-sided).
BOUND_Z = 1.2816
REMOVE_AT, GENERALISE_AT = 0.95, 0.90
#: Hash ranges of texts, of 64, up to which each round of the count goes; what is known after it leaves terms out of the next.
ROUNDS = (1, 8, 64)
#: Size of the filter that tells which words may be disclosing terms (2 MB); its hits are joined exactly.
FILTER_BITS = 1 << 24

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _NO_DIGIT, _WORD = re.compile("[0-9]"), re.compile("[^0-9]"), re.compile(r"\w+")

Span = tuple[int, str, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match for each @: the whole run of local characters before it, then a domain.

    Each run is looked at once, so long texts without an address cost no more than their length.
    """
    done = 0  # nothing before it can be part of a match
    at = text.find("@")
    while at >= 0:
        start = at - len(run) + len(run.rstrip(_LOCAL)) if (run := text[done:at]) else at
        done = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans in code points by start, then kind as listed in KINDS."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += ((s, 0, e) for s, e in _emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NO_DIGIT.sub('', value)}"


def _free_words(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """Start, end and text of the words that touch no base span."""
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    covered, last = [], -1
    for start, _, end in spans:  # merged, to skip what they touch
        if start < last:
            covered[-1] = (covered[-1][0], max(last, end))
        else:
            covered.append((start, end))
        last = max(last, end)
    free, c = [], 0
    for w in words:
        while c < len(covered) and covered[c][1] <= w[0]:
            c += 1
        if c == len(covered) or w[1] <= covered[c][0]:
            free.append(w)
    return free


def _words_near(text: str, spans: list[Span]) -> Iterator[tuple[str, str, int, int, int, int]]:
    """Entity, word, its start and end, a hash of the context, and how often the text has the word, for each word
    near each span.

    Words that touch a base span are left out."""
    if not spans:
        return
    free, held = _free_words(text, spans), Counter(_WORD.findall(text.lower()))
    at = 0
    for start, kind, end in spans:
        while at < len(free) and free[at][0] < start:
            at += 1
        near = [*free[max(0, at - NEAR) : at], *free[at : at + NEAR]]
        context = xxhash.xxh64_intdigest(" ".join(w for _, _, w in near).lower()) - (1 << 63)
        for s, e, w in near:
            yield _entity(kind, text[start:end]), w.lower(), s, e, context, held[w.lower()]


_FOUND = "array<struct<start:int,kind:string,end:int,entity:string>>"
_NEAR = "array<struct<entity:string,term:string,start:int,end:int,context:long,held:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("entity", pa.string())]))
_NEAR_TYPE = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.int64()), ("held", pa.int32())]))

_TERMS_TYPE = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "t"):
        found, near, words = [], [], []
        for text in batch.column("t").to_pylist():
            text = text or ""
            spans = base_spans(text)
            found.append([{"start": s, "kind": k, "end": e, "entity": _entity(k, text[s:e])} for s, k, e in spans])
            near.append([dict(zip(("entity", "term", "start", "end", "context", "held"), x, strict=True)) for x in _words_near(text, spans)])
            words.append(text.count(" ") + 1)
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("v"), pa.array(words, pa.int64()), pa.array(found, _FOUND_TYPE), pa.array(near, _NEAR_TYPE)], names=["i", "v", "words", "found", "near"])


def _term_counts(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """term and n, its occurrences in ``docs``. Words pass the filter of the terms first and are counted by task, so
    what is shuffled is bounded by the terms and the tasks; a few words that pass by chance are counted as well."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, known = bits.value, Counter(), {}

        def wanted(word: str) -> bool:
            if (found := known.get(word)) is None:
                if len(known) >= 200_000:
                    known.clear()
                h = xxhash.xxh64_intdigest(word.encode(), 42) & (FILTER_BITS - 1)
                found = known[word] = bool(table[h >> 3] >> (h & 7) & 1)
            return found

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in pieces(batches, "t"):
            words: Counter[str] = Counter()
            for text in batch.column("t").to_pylist():
                words.update(_WORD.findall((text or "").lower()))
            for word, n in words.items():
                if wanted(word):
                    counts[word] += n
            if len(counts) >= 200_000:
                yield counted()
        yield counted()

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "term string, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, pairs: DataFrame, text_col: str, possible: Callable[[Column], Column]) -> DataFrame:
    """``pairs`` that are possible, with n_term, the occurrences of their term in all texts.

    The texts are counted in rounds, each text in one. A share only falls as its term's number grows, so pairs that are
    not possible at the number reached after a round are not so in the end, and are left out. Frequent words are found
    out in a small part of the corpus; those that are left are rare in it, so the rows that tasks report follow the
    words near entities, not terms times tasks.
    """
    place = F.pmod(F.xxhash64(text_col), F.lit(ROUNDS[-1]))
    pairs = pairs.withColumn("n_term", F.lit(0).cast("long"))
    for begin, end in zip((0, *ROUNDS), ROUNDS, strict=False):
        found = _term_counts(docs.where((place >= begin) & (place < end)), pairs.select("term").distinct(), text_col)
        rows = pairs.join(found, "term", "left").withColumn("n_term", F.col("n_term") + F.coalesce("n", F.lit(0))).drop("n")
        pairs = materialise(rows.where(possible(F.greatest("n_term", "n_least"))), "pairs")
    return pairs


def _filter(terms: DataFrame) -> np.ndarray:
    """A bit for the hash of every ``term``; its fixed size is all that comes to the driver."""
    return bitmap(terms.select(F.xxhash64("term").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")), FILTER_BITS)


def occurrences(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, v, term, start, end of every occurrence of a ``term`` in any text, outside base spans.

    Words pass the filter first; what passes is joined with the terms by whichever join fits their size.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = bits.value, {}

        def wanted(word: str) -> bool:
            if (found := known.get(word)) is None:
                if len(known) >= 200_000:
                    known.clear()
                h = xxhash.xxh64_intdigest(word.lower().encode(), 42) & (FILTER_BITS - 1)
                found = known[word] = bool(table[h >> 3] >> (h & 7) & 1)
            return found

        for batch in pieces(batches, "t"):
            rows, found = [], []
            for row, text in enumerate(batch.column("t").to_pylist()):
                if text and (hits := {w for w in set(_WORD.findall(text)) if wanted(w)}):
                    at = [{"term": w.lower(), "start": s, "end": e} for s, e, w in _free_words(text, base_spans(text)) if w in hits]
                    if at:
                        rows.append(row)
                        found.append(at)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("i"), kept.column("v"), pa.array(found, _TERMS_TYPE)], names=["i", "v", "terms"])

    source = _keyed(docs, id_col, text_col)
    found = source.mapInArrow(run, f"i {source.schema['i'].dataType.simpleString()}, v long, terms array<struct<term:string,start:int,end:int>>")
    return found.select("i", "v", F.inline("terms")).join(terms, "term")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and the words near them, per row; written to the shared folder."""
    source = _keyed(docs, id_col, text_col)
    return materialise(source.mapInArrow(_scan, f"i {source.schema['i'].dataType.simpleString()}, v long, words long, found {_FOUND}, near {_NEAR}"), "personal-data")


def _lower_bound(p, n):
    """Lower end of the Wilson interval of a share ``p`` among ``n``."""
    z = BOUND_Z
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_spans(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that the method adds: i, v (hash of the text), added (array of start, kind, end).

    ``scanned`` is what ``scan`` made of ``docs``. A word occurs at least as often as in the texts in which it was
    seen near entities, and its share of an entity's information falls with that number; words whose share cannot reach
    the threshold even so, such as those near many entities, are left out before the corpus is counted.
    The count goes in rounds, which leave out more of them by what the rounds before have counted. The tables of
    entities and terms are broadcast only below Spark's size threshold.
    """
    near = scanned.where(F.size("near") > 0).select("i", "v", F.explode("near").alias("x")).select("i", "v", "x.*")
    contexts = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    joint = near.groupBy("entity", "term").agg(F.count("*").alias("joint"))
    seen = near.groupBy("term", "i", "v").agg(F.max("held").alias("held")).groupBy("term").agg(F.greatest(F.sum("held"), F.lit(1)).alias("n_least"))
    entities = scanned.where(F.size("found") > 0).select(F.explode("found.entity").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = scanned.agg(F.sum("words")).first()[0] or 1
    content = -F.log2(F.col("n_entity") / F.lit(float(max(total, 2))))

    def share(occurrences: Column) -> Column:
        rate = F.least(F.col("joint") / occurrences, F.lit(1.0))
        return 1 + F.log2(_lower_bound(rate, F.col("contexts") / rate)) / content

    def possible(occurrences: Column) -> Column:
        return share(occurrences) >= GENERALISE_AT - 1e-9

    pairs = contexts.join(joint, ["entity", "term"]).join(seen, "term").join(entities, "entity").where(possible(F.col("n_least")))
    counted = _counted(docs, materialise(pairs, "pairs"), text_col, possible)
    telling = counted.withColumn("share", share(F.nullif("n_term", F.lit(0)))).where(F.col("share") >= GENERALISE_AT)
    kind = F.when(F.col("share") >= REMOVE_AT, "term_removed").otherwise("term_generalised")
    telling = materialise(telling.groupBy("term").agg(F.max(kind).alias("kind")), "telling")
    marked = occurrences(docs, telling, id_col, text_col).groupBy("i", "v", "start", "end").agg(F.max("kind").alias("kind"))
    return marked.groupBy("i", "v").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, base (array of start, kind, end) and spans (base and added ones).

    Both by start, then kind: the base kinds as listed, then the added ones. Null texts have no spans.
    Repeated rows and null ids each get a row. Other columns are ignored. An empty table gives an
    empty table.
    """
    scanned = scan(docs, id_col, text_col)
    added = materialise(disclosing_spans(docs, scanned, id_col, text_col), "disclosing")
    plain = "struct<start:int,kind:string,end:int>"
    base = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    joined = scanned.withColumnRenamed("i", "scanned_i").join(added, F.col("scanned_i").eqNullSafe(F.col("i")) & (scanned["v"] == added["v"]), "left")
    rows = joined.select(F.col("scanned_i").alias(id_col), base.alias("base"), F.coalesce("added", F.array().cast(f"array<{plain}>")).alias("added"))
    ranked = F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "term_removed", "term_generalised"))), x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    return rows.select(id_col, "base", F.array_sort(ranked).alias("spans"))


def joined_spans(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: What stands for a span in a sanitised text.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term_removed": "[REMOVED]"}


def redact(text: str, added: list[Span]) -> str:
    """The text with a mark in place of each span; overlapping spans become the mark of the first."""
    parts, at = [], 0
    for start, kind, end in sorted(base_spans(text) + added, key=lambda x: (x[0], -x[2])):
        if start >= at:
            mark = MARKS.get(kind) or ("[NUMBER]" if _DIGIT.search(text, start, end) else "[WORD]")
            parts += (text[at:start], mark)
        at = max(at, end)
    return "".join((*parts, text[at:])) if parts else text


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with marks for spans in the text, and its length (if there is such a
    column) in code points. Rows without spans stay as they are."""
    scanned = scan(docs, id_col, text_col)
    added = materialise(disclosing_spans(docs, scanned, id_col, text_col), "disclosing").select(F.col("i").alias("_i"), F.col("v").alias("_v"), F.col("added").alias("_added"))
    whole = docs.select(F.struct(*map(_quoted, docs.columns)).alias("doc"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("v"))
    joined = whole.join(added, F.col("i").eqNullSafe(F.col("_i")) & (F.col("v") == F.col("_v")), "left").select("doc.*", "_added")

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            columns = {n: batch.column(n) for n in names}
            old = columns[text_col].to_pylist()
            new = [t and redact(t, [(a["start"], a["kind"], a["end"]) for a in added or []]) for t, added in zip(old, batch.column("_added").to_pylist(), strict=True)]
            if new != old:
                columns[text_col] = pa.array(new, columns[text_col].type)
                if length_col in columns:
                    lengths = [n if a == b else len(b) for n, a, b in zip(columns[length_col].to_pylist(), old, new, strict=True)]
                    columns[length_col] = pa.array(lengths, columns[length_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, docs.schema)
