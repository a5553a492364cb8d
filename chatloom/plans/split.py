"""Queries of the two-level scans: as their plain twins, with keys cut into ranges that run side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import lifecycle as lc
from chatloom.operators import memory as m
from chatloom.operators import state as st
from chatloom.operators.scan import Split

from . import memory as pm
from . import watch as pw
from .registry import ORACLES, query

#: Low enough that most keys of the tables are cut.
SPLIT = Split(rows=4, ranges=4)


@query(ORACLES["w1_number_exchanges"])
def w1_split_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.number_exchanges(pm.messages(spark, sf_dir), SPLIT).select("conv_id", "turn", "xid")


@query(ORACLES["w3_rolling_summary"])
def w3_split_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, excerpts and summaries."""
    return m.rolling_summary(m.build_excerpts(pm.messages(spark, sf_dir), SPLIT), split=Split(rows=1, ranges=3))


@query(ORACLES["w4_last_exchange_asof"])
def w4_split_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.last_exchange_asof(pm.messages(spark, sf_dir), SPLIT)


@query(ORACLES["w8_reconcile_loop"])
def w8_split_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.shown_loops(st.reconcile_loop(pw.loop_states(spark, sf_dir), split=SPLIT))


@query(ORACLES["w9_reconcile_project"])
def w9_split_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.shown_projects(st.reconcile_project(pw.written_projects(spark, sf_dir), SPLIT))


@query(ORACLES["j6_running_intervals"])
def j6_split_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lc.running_intervals(pw.instances(spark, sf_dir), pw.stops(spark, sf_dir), split=Split(rows=2, ranges=4))
    return spans.withColumn("stop_seq", F.col("stop_seq").cast("string"))
