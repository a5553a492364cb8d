"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reader sees of a think-tagged text is what this pattern leaves: thinking up to its end tag or
#: the end of the text, and a cut-off start tag at the very end.
THINK = r"(?s)<think>.*?(?:</think>|\z)|<(?:t(?:h(?:i(?:nk?)?)?)?)?\z"
#: One run of thinking; what stands between two of them is other text.
THINK_RUN = r"(?s)<think>.*?(?:</think>|\z)"
CUT_OPEN, CUT_CLOSE = r"<(?:t(?:h(?:i(?:nk?)?)?)?)?\z", r"<(?:/(?:t(?:h(?:i(?:nk?)?)?)?)?)?\z"


# Unicode's white space.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at either end (``trim`` alone takes only spaces off)."""
    return F.btrim(text, F.lit(WHITE))


def suffix(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def prefix(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^(?U)\s*$")


def drop_blank_inputs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text holds more than white space."""
    return df.where(~is_blank(F.col(text_col)))


def strip_think(text: Column, keep_partial: bool = False) -> Column:
    """The visible part of a think-tagged text, stripped. ``keep_partial`` keeps a cut-off tag at the end."""
    return strip(F.regexp_replace(text, THINK.split("|<(?:t(")[0] if keep_partial else THINK, ""))


def think_segments(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per segment of a think-tagged text: all columns but the text, pos, segment, is_thinking.

    A cut-off tag at the very end of the text is left out of the last segment; empty ones are dropped.
    The text is split at its runs of thinking, so the pattern never loops over single characters and
    texts of any length pass.
    """
    between, inside = F.split(text_col, THINK_RUN, -1), F.regexp_extract_all(F.col(text_col), F.lit(THINK_RUN), F.lit(0))
    pairs = F.arrays_zip(between.alias("b"), inside.alias("t"))
    runs = F.filter(F.flatten(F.transform(pairs, lambda x: F.array(x["b"], x["t"]))), lambda x: x != "")
    count = F.size("_runs")

    def one(run: Column, i: Column) -> Column:
        thinking = run.startswith("<think>")
        inside = F.regexp_replace(run, r"(?s)\A<think>|</think>\z", "")
        closed = F.endswith(run, F.lit("</think>"))
        last = i == count - 1
        inside = F.when(last & ~closed, F.regexp_replace(inside, CUT_CLOSE, "")).otherwise(inside)
        outside = F.when(last, F.regexp_replace(run, CUT_OPEN, "")).otherwise(run)
        return F.struct(F.when(thinking, inside).otherwise(outside).alias("segment"), thinking.alias("is_thinking"))

    cut = df.withColumn("_runs", runs).withColumn("_runs", F.filter(F.transform("_runs", one), lambda s: s["segment"] != ""))
    keep = [c for c in df.columns if c != text_col]
    return cut.select(*keep, F.posexplode("_runs").alias("pos", "_run")).select(*keep, "pos", "_run.segment", "_run.is_thinking")


def result_preview(text: Column, n: int = 120) -> Column:
    """The first ``n`` characters, with an ellipsis if there are more; empty for null."""
    return F.when(F.length(text) > n, F.concat(prefix(text, n), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def monitor_id(command: Column) -> Column:
    """A stable id of a monitored command."""
    return F.substring(F.sha1(command), 1, 12)


def ordered_text(order: str, text: str, separator: str) -> Column:
    """Aggregate: the texts of a group in ``order`` (a unique column), joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
