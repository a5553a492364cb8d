"""Quality rules by weak supervision.

Each rule votes good or bad on a document or abstains. Expectation-maximisation over the counts of
vote patterns estimates how accurate each rule is, without labels;
the posterior probability that a document is good replaces an all-must-pass filter.

One pass over the texts makes the measures and votes; the pattern counts are one small aggregation
(3 ** rules patterns at most, whatever the input), and only they come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper_words", "n_marks", "n_plain_words", "n_stutters")
WINDOW = 5

#: Rule -> (numerator, denominator, sense, bad bound, good bound): the ratio votes bad beyond the bad
#: bound, good within the good bound (None: never), and abstains between. Sense 1: high is bad. Rules
#: that know one kind of junk only vote bad or abstain: its absence says nothing of other junk.
RULES = {
    "length": ("n_words", None, -1, 10, None),
    "symbols": ("n_symbols", "n_words", 1, 0.10, None),
    "repeats": ("n_repeat_words", "n_words", 1, 0.20, None),
    "dup_lines": ("n_dup_lines", "n_lines", 1, 0.30, None),
    "short_words": ("word_chars", "n_words", -1, 2.0, None),
    "long_words": ("word_chars", "n_words", 1, 16.0, None),
    "shouting": ("n_upper_words", "n_words", 1, 0.30, None),
    "marks": ("n_marks", "n_words", 1, 0.10, None),
    "stutter": ("n_stutters", "n_words", 1, 0.20, None),
    "plain_words": ("n_plain_words", "n_words", -1, 0.70, 0.90),
    "line_ends": ("n_ended_lines", "n_lines", -1, 0.10, 0.50),
}
PLAIN = r"^[\"'(«“¿¡+]?[\p{L}\p{N}][\p{L}\p{N}'’().,-]*[.,;:!?\"')»”…]{0,2}$"
N_PATTERNS = 3 ** len(RULES)


def _repeated(doc: np.ndarray, code: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per document that lie in a window of five found twice or more in the document."""
    k = WINDOW
    start = np.flatnonzero(doc[: 1 - k] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(n_docs, np.int64)
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = (doc[start].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[start + j]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    left, right = start[order[:-1]][same], start[order[1:]][same]
    if np.any(doc[left] != doc[right]) or any(np.any(code[left + j] != code[right + j]) for j in range(k)):
        rows = np.stack([doc[start], *(code[start + j] for j in range(k))], 1)  # two windows share a hash: compare them all
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = start[count[inverse.reshape(-1)] > 1]
    else:
        twice = np.union1d(left, right)
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text, as int64 arrays."""
    text = pc.fill_null(text, "")
    n = len(text)

    def by_doc(doc: np.ndarray, weight: pa.Array | np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, None if weight is None else np.asarray(weight, np.float64), minlength=n).astype(np.int64)

    words = pc.ascii_split_whitespace(text)
    word, doc = words.flatten(), pc.list_parent_indices(words).to_numpy()
    full = pc.greater(pc.binary_length(word), 0)
    word, doc = word.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    coded = word.dictionary_encode()
    code, vocabulary = coded.indices.to_numpy(), coded.dictionary
    chars = pc.utf8_length(vocabulary).to_numpy()
    upper = pc.utf8_is_upper(vocabulary).to_numpy(zero_copy_only=False) & (chars > 1)
    plain = pc.match_substring_regex(vocabulary, PLAIN).to_numpy(zero_copy_only=False) & ~upper
    out = {"n_words": by_doc(doc), "word_chars": by_doc(doc, chars[code]), "n_repeat_words": _repeated(doc, code, n), "n_upper_words": by_doc(doc, upper[code]), "n_plain_words": by_doc(doc, plain[code]), "n_stutters": by_doc(doc[1:][(code[1:] == code[:-1]) & (doc[1:] == doc[:-1])])}

    lines = pc.split_pattern(text, "\n")
    line, doc = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
    trimmed = pc.ascii_trim_whitespace(line)
    full = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    coded = line.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key = (doc * size + coded.indices.to_numpy())[full]
    ended = pc.match_substring_regex(trimmed, r"[.!?:;\"”»)]$").to_numpy(zero_copy_only=False)
    out["n_lines"] = by_doc(doc[full])
    out["n_ended_lines"] = by_doc(doc[full & ended])
    out["n_dup_lines"] = out["n_lines"] - by_doc(np.unique(key) // size)
    out["n_symbols"] = pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy().astype(np.int64)
    out["n_marks"] = pc.count_substring_regex(text, r"[!|]").to_numpy().astype(np.int64)
    return out


def vote(measures: dict[str, np.ndarray]) -> np.ndarray:
    """The pattern of each document: per rule a digit to base 3: 0 abstains, 1 good, 2 bad."""
    pattern = np.zeros(len(measures["n_words"]), np.int64)
    for top, bottom, sense, bad, good in RULES.values():
        ratio = measures[top] / (1 if bottom is None else np.maximum(measures[bottom], 1))
        known = True if bottom is None else measures[bottom] > 0
        is_bad = ratio > bad if sense > 0 else ratio < bad
        is_good = False if good is None else ratio <= good if sense > 0 else ratio >= good
        pattern = pattern * 3 + np.where(known & is_bad, 2, np.where(known & is_good, 1, 0))
    return pattern


def base_failed(measures: dict[str, np.ndarray]) -> np.ndarray:
    return (measures["n_words"] < 10) | (100 * measures["n_repeat_words"] > 20 * measures["n_words"])


def posterior(counts: dict[int, int], rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Probability of good for every vote pattern.

    Two classes; a rule that votes is right with an accuracy of its own, independently of the others;
    abstaining says nothing. Accuracies stay within [0.5, 0.999], so that the classes cannot change
    places. No documents: the starting values.
    """
    every = np.arange(N_PATTERNS)
    votes = np.stack([every // 3**j % 3 for j in reversed(range(len(RULES)))], 1)
    sign = np.where(votes == 1, 1, np.where(votes == 2, -1, 0))
    weight = np.zeros(N_PATTERNS)
    for pattern, n in counts.items():
        weight[pattern] = n
    prior, right = 0.8, np.full(len(RULES), 0.9)

    def probability() -> np.ndarray:
        odds = np.log(prior / (1 - prior)) + sign @ np.log(right / (1 - right))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    for _ in range(rounds if weight.any() else 0):
        p = probability()
        agree = (p * weight) @ (sign > 0) + ((1 - p) * weight) @ (sign < 0)
        new = np.clip((agree + 9) / (weight @ np.abs(sign) + 10), 0.5, 0.999)
        new_prior = float(np.clip(p @ weight / weight.sum(), 0.05, 0.999))
        moved = max(np.abs(new - right).max(), abs(new_prior - prior))
        right, prior = new, new_prior
        if moved < tolerance:
            break
    return probability()


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, all measures, base_failed and the vote pattern. No shuffle."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, pattern long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            m = measure(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("i"), *(pa.array(m[k]) for k in MEASURES), pa.array(base_failed(m)), pa.array(vote(m))], names=[id_col, *MEASURES, "base_failed", "pattern"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def pattern_counts(patterns: DataFrame) -> dict[int, int]:
    """``patterns``: a column ``pattern``. Collects at most 3 ** rules counts."""
    return {r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Measures and verdict per row of ``docs``: the id, all measures, base_failed, posterior, kept.

    Null texts count as empty: no words, so base_failed. Repeated rows and null ids each get a row.
    Columns other than the two named are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = materialise(measured(docs, id_col, text_col), "measures")
    counts = pattern_counts(rows)
    p = posterior(counts)
    learned = spark.createDataFrame([(i, float(p[i])) for i in counts], "pattern long, posterior double")
    joined = rows.join(F.broadcast(learned), "pattern")  # 3 ** rules rows at most
    return joined.drop("pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and have a posterior of ``least`` or more.

    Two passes over the texts and no shuffle of them: the second measures again rather than joining.
    """
    p = posterior(pattern_counts(measured(docs.select(F.lit(0).alias("i"), F.col(text_col).alias("t")), "i", "t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            m = measure(batch.column(text_col))
            yield batch.filter(pa.array(~base_failed(m) & (p[vote(m)] >= least)))

    return docs.mapInArrow(run, docs.schema)
