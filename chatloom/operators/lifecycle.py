"""Lifecycle of event instances: ids, running intervals, status, schedules and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import prefix
from chatloom.operators.scan import Running, Split, running


def assign_instance_ids(starts: DataFrame) -> DataFrame:
    """Adds instance_id, name#N: N counts all starts of a bus (bus_id, seq, name), whatever their name."""
    number = F.row_number().over(W.partitionBy("bus_id").orderBy("seq"))
    return starts.withColumn("instance_id", F.concat("name", F.lit("#"), number.cast("string")))


def running_intervals(instances: DataFrame, stops: DataFrame, own_ends: DataFrame | None = None, split: Split | None = None) -> DataFrame:
    """Adds stop_seq to instances (bus_id, seq, name, instance_id): the first later stop (bus_id, seq,
    key) whose key is the instance's id or its name, or its own end; null while it runs.

    ``own_ends``: bus_id, seq, instance_id of instances that ended by themselves. Starts and stops of one
    name (or id) stand in one order, from the last to the first, and each start sees the smallest stop
    so far: a running minimum instead of a join, so a name that starts and stops often costs no more
    than its rows. A name of very many can be split (see ``scan``).
    """
    if own_ends is not None:
        stops = stops.select("bus_id", "seq", "key").unionByName(own_ends.select("bus_id", "seq", F.col("instance_id").alias("key")))

    def next_stop(key: str, out: str) -> DataFrame:
        starts = instances.select("bus_id", F.col(key).alias("key"), "seq", F.lit(False).alias("is_stop"), "instance_id")
        ends = stops.select("bus_id", "key", "seq", F.lit(True).alias("is_stop"), F.lit(None).cast("string").alias("instance_id"))
        nxt = Running("min", F.when(F.col("is_stop"), F.col("seq")), inclusive=False)
        return running(starts.unionByName(ends), ["bus_id", "key"], "seq", {out: nxt}, split, descending=True).where("NOT is_stop").select("bus_id", "instance_id", out)

    by_name, by_id = next_stop("name", "by_name"), next_stop("instance_id", "by_id")
    rows = instances.join(by_name, ["bus_id", "instance_id"]).join(by_id, ["bus_id", "instance_id"])
    return rows.withColumn("stop_seq", F.least("by_name", "by_id")).drop("by_name", "by_id")


def status_summary(iterations: DataFrame, live: DataFrame, running: DataFrame) -> DataFrame:
    """instance_id, status (generating before running before stopped), n_iterations (of those kept)."""
    parts = [df.select("instance_id", *(F.lit(x).alias(n) for n, x in (("logged", a), ("live", b), ("running", c)))) for df, a, b, c in ((iterations, 1, 0, 0), (live, 0, 1, 0), (running, 0, 0, 1))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("instance_id").agg(F.sum("logged").alias("n_iterations"), F.max("live").alias("live"), F.max("running").alias("running"))
    status = F.when(F.col("live") == 1, "generating").when(F.col("running") == 1, "running").otherwise("stopped")
    return rows.select("instance_id", status.alias("status"), "n_iterations")


def running_by_name(running: DataFrame, catalog: DataFrame) -> DataFrame:
    """name of each event in the catalog, and whether an instance of it runs (``running``: instance_id)."""
    names = running.select(F.regexp_replace("instance_id", "#[^#]*$", "").alias("name")).distinct().withColumn("is_running", F.lit(True))
    return catalog.select("name").join(names, "name", "left").withColumn("is_running", F.coalesce("is_running", F.lit(False)))


def parse_schedules(schedules: DataFrame) -> DataFrame:
    """Adds due (null if invalid), label and error to schedules (message, when as day-month-year-hour-minute)."""
    due = F.try_to_timestamp("when", F.lit("d-M-yyyy-H-m"))
    label = F.concat(F.lit("Scheduled "), F.date_format("due", "dd/MM/yyyy HH:mm"), F.lit(": "), prefix(F.col("message"), 50))
    return schedules.withColumn("due", due).withColumns({"label": label, "error": F.when(F.col("due").isNull(), F.concat(F.lit("invalid time: "), "when"))})


def due_schedules(schedules: DataFrame, as_of: Column, fired: DataFrame | None = None) -> DataFrame:
    """Schedules (id, submitted, due) that are due, with fire_ts: their time, or at once if that was past
    when they came in. ``fired``: ids of those that have fired."""
    rows = schedules.where(F.col("due") <= as_of).withColumn("fire_ts", F.greatest("due", "submitted"))
    return rows if fired is None else rows.join(fired.select("id"), "id", "left_anti")


def timer_ticks(timers: DataFrame, interval: str = "20 seconds") -> DataFrame:
    """One row for each tick of timers (start, end): all columns and tick, the first one interval after
    the start. A fixed grid: what the work of a tick delays is not reproduced."""
    step = F.expr(f"INTERVAL '{interval}'") if not interval.isdigit() else F.make_dt_interval(secs=F.lit(int(interval)))
    ticks = F.when(F.col("start") + step <= F.col("end"), F.sequence(F.col("start") + step, "end", step))
    return timers.withColumn("tick", F.explode(ticks))
