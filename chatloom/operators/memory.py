"""Conversation memory: exchanges, excerpts, rolling summaries and the prompts built from them.

``messages`` has conv_id, turn (unique in a conversation), role, text, and optionally tool_calls. All
steps partition by conversation, so one exchange serves the whole chain. With a ``split`` conversations of
very many messages are cut into ranges that run side by side (see ``scan``), for more exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import strip, suffix
from chatloom.operators.scan import RANGE, Running, Split, running, with_ranges

EXCERPT_CHARS, SUMMARY_CHARS, INLINE_CHARS = 1500, 2000, 200


def text_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def _terminal(messages: DataFrame) -> Column:
    answers = F.col("role") == "assistant"
    return answers & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0) if "tool_calls" in messages.columns else answers


def reset_segments(messages: DataFrame) -> DataFrame:
    """Adds segment, the number of earlier resets (rows of role "reset", which go)."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return messages.withColumn("segment", F.count_if(F.col("role") == "reset").over(before)).where("role <> 'reset'")


def number_exchanges(messages: DataFrame, split: Split | None = None) -> DataFrame:
    """Adds xid: an exchange ends with an assistant message that calls no tool; rows of a turn that was
    stopped before count to the next exchange."""
    ended = Running("sum", F.when(_terminal(messages), F.lit(1).cast("bigint")), inclusive=False)
    rows = running(messages, ["conv_id"], "turn", {"xid": ended}, split)
    return rows.withColumn("xid", F.coalesce("xid", F.lit(0).cast("bigint")))


def exchanges(messages: DataFrame, excerpt_chars: int | None = None, split: Split | None = None) -> DataFrame:
    """One row for each finished exchange: conv_id, (segment,) xid, body, and its last user and last
    non-empty assistant message. With ``excerpt_chars`` only the end of each text is carried."""
    text = suffix(F.col("text"), excerpt_chars) if excerpt_chars else F.col("text")
    rows = number_exchanges(messages, split).where(F.col("role").isin("user", "assistant"))
    said = F.col("text") != ""
    rows = rows.withColumn("done", _terminal(messages)).withColumn("short", text).withColumn("line", F.when(said, F.concat("role", F.lit(": "), text)))
    keys = ["conv_id", *(["segment"] if "segment" in messages.columns else []), "xid"]
    message = F.struct("turn", F.col("short").alias("text"))
    return (
        rows.groupBy(*keys)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said, F.struct("turn", "line")))), lambda x: x["line"]), "\n").alias("body"),
            F.max(F.when(F.col("role") == "user", message)).alias("last_user"),
            F.max(F.when((F.col("role") == "assistant") & said, message)).alias("last_assistant"),
            F.bool_or("done").alias("done"),
        )
        .where("done")
        .drop("done")
    )


def _conversation(df: DataFrame) -> list[str]:
    return ["conv_id", *(["segment"] if "segment" in df.columns else [])]


def build_excerpts(messages: DataFrame, split: Split | None = None) -> DataFrame:
    """conv_id, (segment,) xid, excerpt: the end of what is retained of the exchanges before (the last
    user and the last non-empty assistant message) and of this exchange. Excerpts overlap."""
    rows = exchanges(messages, EXCERPT_CHARS, split)
    last = {f"before_{role}": Running("last", F.col(f"last_{role}"), inclusive=False) for role in ("user", "assistant")}
    rows = running(rows, _conversation(rows), "xid", last, split)

    def kept(role: str) -> Column:
        message = F.col(f"before_{role}")
        return F.when(message["text"] != "", F.struct(message["turn"].alias("turn"), F.concat(F.lit(f"{role}: "), message["text"]).alias("line")))

    pair = F.transform(F.array_sort(F.array_compact(F.array(kept("user"), kept("assistant")))), lambda x: x["line"])
    lines = F.filter(F.array(F.array_join("pair", "\n"), F.col("body")), lambda x: x != "")
    return rows.withColumn("pair", pair).select(*_conversation(rows), "xid", suffix(F.array_join(lines, "\n"), EXCERPT_CHARS).alias("excerpt"))


def rolling_summary(excerpts: DataFrame, initial: DataFrame | None = None, inline_chars: int = INLINE_CHARS, split: Split | None = None) -> DataFrame:
    """conv_id, xid, excerpt, summary (after the exchange), branch: inline, seed or merge.

    Without a working merge function all branches add the excerpt and keep the end, so a summary is the
    end of the excerpts so far. ``initial``: conv_id, summary of an earlier run, goes in front. Resets do
    not end a summary. Of a range of a split conversation the ranges before only need the end of their texts.
    """
    rows = excerpts.where(F.col("excerpt") != "")
    keys = ["conv_id"]
    if split is not None:
        rows, keys = with_ranges(rows, keys, "xid", split), [*keys, RANGE]
    order = W.partitionBy(*keys).orderBy("xid")
    first = F.row_number().over(order) == 1
    rows = rows.withColumn("initial", F.lit("")) if initial is None else rows.join(initial.select("conv_id", F.col("summary").alias("initial")), "conv_id", "left").fillna("", "initial")
    # the excerpts that reach into the last SUMMARY_CHARS characters, by how far the text has come
    rows = rows.withColumn("_at", F.sum(F.length("excerpt") + 1).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    so_far = F.collect_list("excerpt").over(W.partitionBy(*keys).orderBy("_at").rangeBetween(-SUMMARY_CHARS, 0))
    rows = rows.withColumns({"_so_far": so_far, "_first": first}).drop("_at")
    if split is None:
        rows = rows.withColumn("_before", F.lit(""))
    else:
        ends = rows.groupBy(*keys).agg(F.max_by(suffix(F.array_join("_so_far", "\n"), SUMMARY_CHARS), "xid").alias("_end"))
        earlier = F.collect_list("_end").over(W.partitionBy("conv_id").orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1))
        ends = ends.select(*keys, suffix(F.array_join(earlier, "\n"), SUMMARY_CHARS).alias("_before")).where("_before <> ''")
        rows = rows.join(ends, keys, "left").fillna("", "_before").withColumn("_first", F.col("_first") & (F.col("_before") == ""))
    parts = F.filter(F.concat(F.array("initial", "_before"), "_so_far"), lambda x: x != "")
    branch = F.when(F.length("excerpt") < inline_chars, "inline").when(F.col("_first") & (F.col("initial") == ""), "seed").otherwise("merge")
    return rows.select("conv_id", "xid", "excerpt", suffix(F.array_join(parts, "\n"), SUMMARY_CHARS).alias("summary"), branch.alias("branch"))


def _exchange_text(user: Column, assistant: Column) -> Column:
    return strip(F.concat(F.lit("user: "), F.coalesce(user, F.lit("")), F.lit("\nassistant: "), F.coalesce(assistant, F.lit(""))))


def last_exchange_asof(messages: DataFrame, split: Split | None = None) -> DataFrame:
    """conv_id, xid, last_exchange after each exchange; the former one stays where both texts are empty."""
    rows = exchanges(messages, split=split)
    last = {f"upto_{r}": Running("last", F.col(f"last_{r}")) for r in ("user", "assistant")}
    rows = running(rows, _conversation(rows), "xid", last, split)
    user, assistant = (F.col(f"upto_{r}")["text"] for r in ("user", "assistant"))
    said = (F.coalesce(user, F.lit("")) != "") | (F.coalesce(assistant, F.lit("")) != "")
    rows = rows.withColumn("now", F.when(said, _exchange_text(user, assistant)))
    return running(rows, ["conv_id"], "xid", {"last_exchange": Running("last", F.col("now"))}, split).select("conv_id", "xid", "last_exchange")


def latest_exchange(messages: DataFrame) -> DataFrame:
    """conv_id, last_exchange: the last user and the last non-empty assistant text of a conversation."""

    def last(role: str) -> Column:
        wanted = (F.col("role") == role) & (F.lit(True) if role == "user" else F.col("text") != "")
        return F.max_by("text", F.when(wanted, F.col("turn")))

    found = messages.groupBy("conv_id").agg(last("user").alias("u"), last("assistant").alias("a"))
    said = (F.coalesce("u", F.lit("")) != "") | (F.coalesce("a", F.lit("")) != "")
    return found.where(said).select("conv_id", _exchange_text(F.col("u"), F.col("a")).alias("last_exchange"))


def stopped_exchange(messages: DataFrame) -> DataFrame:
    """conv_id, turn, last_exchange at each stop (rows of role "stop"); a stop drops the messages before it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    stops = F.count_if(F.col("role") == "stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = messages.withColumn("part", F.coalesce(stops, F.lit(0)))
    upto = W.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    user = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(upto)
    assistant = F.last(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(upto)
    text = F.concat(F.lit("user: "), "u", F.coalesce(F.concat(F.lit("\nassistant (partial, stopped by user): "), "a"), F.lit("")))
    rows = rows.withColumns({"u": user, "a": assistant}).where(F.col("role") == "stop")
    return rows.where(F.col("u") != "").select("conv_id", "turn", text.alias("last_exchange"))


def attach_memory(turns: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Adds the memory a turn starts with to ``turns`` (conv_id, xid, summary, last_exchange as they are
    after each turn): summary_before, exchange_before. The first turn gets the ``initial`` summary."""
    order = W.partitionBy("conv_id").orderBy("xid")
    first = F.row_number().over(order) == 1
    rows = turns.withColumns({"summary_before": F.lag("summary").over(order), "exchange_before": F.lag("last_exchange").over(order), "first": first})
    if initial is not None:
        rows = rows.join(initial.select("conv_id", F.col("summary").alias("persisted")), "conv_id", "left").withColumn("summary_before", F.when(F.col("first"), F.col("persisted")).otherwise(F.col("summary_before"))).drop("persisted")
    return rows.drop("first").fillna("", ["summary_before", "exchange_before"])


# Wording of the prompts.
TRIMMED_NOTE = "\n\n<context>Earlier conversation was summarized in the memory blocks above. Full history has been cleared.</context>"
SKILL_NOTE = "The user's request has triggered this skill. Execute the steps below verbatim by calling the appropriate tools. Do not summarize, skip, or paraphrase any step."


def assemble_prompts(df: DataFrame) -> DataFrame:
    """Adds system_content to rows of system_prompt, summary, trimmed, skills (array of name, instructions)."""
    memory = F.when(F.col("summary") != "", F.concat(F.lit("\n\n<memory>\n"), "summary", F.lit("\n</memory>")))
    trimmed = F.when(F.col("trimmed"), F.lit(TRIMMED_NOTE))

    def block(skill: Column) -> Column:
        name = skill["name"]
        return F.concat(F.lit("\n\n<skill:"), name, F.lit(f">\n{SKILL_NOTE}\n\n"), skill["instructions"], F.lit("\n</skill:"), name, F.lit(">"))

    skills = F.array_join(F.transform("skills", block), "")
    parts = [F.coalesce(x, F.lit("")) for x in (F.col("system_prompt"), memory, trimmed, skills)]
    return df.withColumn("system_content", F.concat(*parts))


def build_merge_prompts(df: DataFrame) -> DataFrame:
    """Adds merge_prompt to rows of existing (summary) and excerpt."""
    return df.withColumn("merge_prompt", F.concat(F.lit("<existing_summary>"), "existing", F.lit("</existing_summary>\n\n<new_conversation>"), "excerpt", F.lit("</new_conversation>")))


