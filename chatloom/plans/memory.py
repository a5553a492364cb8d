"""Queries of the conversation-memory operators over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import prefix
from chatloom.operators import memory as m

from .registry import query, table

#: Exchanges of the table: a user row, and the assistant row that ends it.
X1 = """
msgs AS (SELECT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS xid FROM msgs),
ex AS (SELECT conv_id, CAST(xid AS BIGINT) AS xid, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (text <> '') AS body,
              max_by(text, turn) FILTER (role = 'user') AS u, max_by(text, turn) FILTER (role = 'assistant' AND text <> '') AS a
       FROM numbered WHERE role IN ('user', 'assistant') GROUP BY 1, 2 HAVING count(*) FILTER (role = 'assistant') > 0),
pairs AS (SELECT *, lag(u) OVER w AS pu, lag(a) OVER w AS pa FROM ex WINDOW w AS (PARTITION BY conv_id ORDER BY xid)),
excerpts AS (SELECT conv_id, xid, right(concat_ws(chr(10), 'user: ' || pu, 'assistant: ' || pa, body), 1500) AS excerpt FROM pairs),
rolled AS (SELECT conv_id, xid, excerpt, right(string_agg(excerpt, chr(10)) OVER (PARTITION BY conv_id ORDER BY xid ROWS BETWEEN 250 PRECEDING AND CURRENT ROW), 2000) AS summary,
                  CASE WHEN length(excerpt) < 200 THEN 'inline' WHEN row_number() OVER (PARTITION BY conv_id ORDER BY xid) = 1 THEN 'seed' ELSE 'merge' END AS branch FROM excerpts),
recent AS (SELECT conv_id, xid, 'user: ' || u || chr(10) || 'assistant: ' || a AS last_exchange FROM ex)
"""
#: As ``rolled``, where every other conversation goes on from a stored summary.
STORED_SQL = f"""WITH {X1}, stored AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'stored ' || conv_id END AS before FROM excerpts)
SELECT conv_id, xid, excerpt, right(concat_ws(chr(10), before, string_agg(excerpt, chr(10)) OVER (PARTITION BY conv_id ORDER BY xid)), 2000) AS summary,
  CASE WHEN length(excerpt) < 200 THEN 'inline' WHEN before IS NULL AND row_number() OVER (PARTITION BY conv_id ORDER BY xid) = 1 THEN 'seed' ELSE 'merge' END AS branch FROM stored"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def memory_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return m.rolling_summary(m.build_excerpts(rows)).join(m.last_exchange_asof(rows), ["conv_id", "xid"])


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''")
def p2_text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.text_messages(messages(spark, sf_dir))


@query(f"WITH {X1} SELECT conv_id, turn, CAST(xid AS BIGINT) AS xid FROM numbered")
def w1_number_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.number_exchanges(messages(spark, sf_dir)).select("conv_id", "turn", "xid")


@query(f"WITH {X1} SELECT conv_id, xid, excerpt FROM excerpts")
def w2_build_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.build_excerpts(messages(spark, sf_dir))


@query(f"WITH {X1} SELECT conv_id, xid, excerpt, summary, branch FROM rolled")
def w3_rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rolling_summary(m.build_excerpts(messages(spark, sf_dir)))


@query(f"WITH {X1} SELECT conv_id, xid, last_exchange FROM recent")
def w4_last_exchange_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.last_exchange_asof(messages(spark, sf_dir))


@query("SELECT conv_id, 10 * turn + 1 AS turn, 'user: ' || text AS last_exchange FROM conversations WHERE role = 'user'")
def w5_stopped_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is stopped before its answer."""
    rows = messages(spark, sf_dir).withColumn("turn", F.col("turn") * 10)
    stops = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("stop").alias("role"), F.lit("").alias("text"))
    return m.stopped_exchange(rows.where("role <> 'assistant'").unionByName(stops))


@query("""
WITH msgs AS (SELECT conv_id, turn, role, text, turn // 4 AS segment FROM conversations),
numbered AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS xid FROM msgs),
ex AS (SELECT conv_id, segment, CAST(xid AS BIGINT) AS xid, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, max_by(text, turn) FILTER (role = 'user') AS u,
              max_by(text, turn) FILTER (role = 'assistant') AS a FROM numbered WHERE role IN ('user', 'assistant') GROUP BY 1, 2, 3 HAVING count(*) FILTER (role = 'assistant') > 0),
recent AS (SELECT *, last_value(u IGNORE NULLS) OVER w AS pu, last_value(a IGNORE NULLS) OVER w AS pa FROM ex WINDOW w AS (PARTITION BY conv_id, segment ORDER BY xid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, segment, xid, right(concat_ws(chr(10), 'user: ' || pu, 'assistant: ' || pa, body), 1500) AS excerpt FROM recent
""")
def w13_reset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts where a reset comes before every fourth turn but the first."""
    rows = messages(spark, sf_dir).withColumn("turn", F.col("turn") * 2 + 1)
    resets = rows.where("turn > 1 AND turn % 8 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("reset").alias("role"), F.lit("").alias("text"))
    return m.build_excerpts(m.reset_segments(rows.unionByName(resets)))


@query("""
SELECT conv_id, 'user: ' || coalesce(u, '') || chr(10) || 'assistant: ' || coalesce(a, '') AS last_exchange FROM (
  SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS u, max_by(text, turn) FILTER (role = 'assistant' AND text <> '') AS a FROM conversations GROUP BY 1)
WHERE u <> '' AND a IS NOT NULL
UNION ALL SELECT conv_id, 'user: ' || max_by(text, turn) FILTER (role = 'user') || chr(10) || 'assistant:' FROM conversations GROUP BY 1
HAVING count(*) FILTER (role = 'assistant' AND text <> '') = 0 AND count(*) FILTER (role = 'user') > 0
""")
def a9_latest_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.latest_exchange(messages(spark, sf_dir))


@query(f"""WITH {X1} SELECT rolled.conv_id, rolled.xid, coalesce(lag(summary) OVER w, '') AS summary_before, coalesce(lag(last_exchange) OVER w, '') AS exchange_before
FROM rolled JOIN recent USING (conv_id, xid) WINDOW w AS (PARTITION BY conv_id ORDER BY xid)""")
def j9_attach_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.attach_memory(memory_of(spark, sf_dir)).select("conv_id", "xid", "summary_before", "exchange_before")


@query(f"""WITH {X1}, before AS (SELECT conv_id, xid, coalesce(lag(summary) OVER w, '') AS summary, xid > 0 AS trimmed FROM rolled WINDOW w AS (PARTITION BY conv_id ORDER BY xid)),
sys AS (SELECT conv_id, max_by(text, turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT before.conv_id, xid, coalesce(system_prompt, '') || CASE WHEN summary <> '' THEN chr(10) || chr(10) || '<memory>' || chr(10) || summary || chr(10) || '</memory>' ELSE '' END
 || CASE WHEN trimmed THEN chr(10) || chr(10) || '<context>Earlier conversation was summarized in the memory blocks above. Full history has been cleared.</context>' ELSE '' END
 || CASE WHEN xid % 2 = 1 THEN chr(10) || chr(10) || '<skill:s' || xid || '>' || chr(10) || 'The user''s request has triggered this skill. Execute the steps below verbatim by calling the appropriate tools. Do not summarize, skip, or paraphrase any step.'
   || chr(10) || chr(10) || 'step ' || xid || chr(10) || '</skill:s' || xid || '>' ELSE '' END AS system_content
FROM before LEFT JOIN sys USING (conv_id)""")
def p15_assemble_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system message at the start of each exchange; every second one has a skill active."""
    system = messages(spark, sf_dir).where("role = 'system'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("system_prompt"))
    turns = m.attach_memory(memory_of(spark, sf_dir)).join(system, "conv_id", "left")
    skill = F.array(F.struct(F.concat(F.lit("s"), "xid").alias("name"), F.concat(F.lit("step "), "xid").alias("instructions")))
    rows = turns.select("conv_id", "xid", "system_prompt", F.col("summary_before").alias("summary"), (F.col("xid") > 0).alias("trimmed"), F.when(F.col("xid") % 2 == 1, skill).otherwise(F.array().cast("array<struct<name:string,instructions:string>>")).alias("skills"))
    return m.assemble_prompts(rows).select("conv_id", "xid", "system_content")


@query(f"""WITH {X1} SELECT conv_id, xid, '<existing_summary>' || before || '</existing_summary>' || chr(10) || chr(10) || '<new_conversation>' || excerpt || '</new_conversation>' AS merge_prompt
FROM (SELECT *, coalesce(lag(summary) OVER (PARTITION BY conv_id ORDER BY xid), '') AS before FROM rolled) WHERE branch = 'merge'""")
def p17_build_merge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.attach_memory(memory_of(spark, sf_dir)).where("branch = 'merge'").withColumnRenamed("summary_before", "existing")
    return m.build_merge_prompts(rows).select("conv_id", "xid", "merge_prompt")


@query("SELECT conv_id, turn, left(text, 40) AS head, right(text, 40) AS tail FROM conversations")
def o4_text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", prefix(F.col("text"), 40).alias("head"), F.right("text", F.lit(40)).alias("tail"))
