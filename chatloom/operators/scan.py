"""Running values over keys of any size: a window, or for hot keys a prefix scan in two levels.

A window sorts a key in one task. With a ``Split`` the keys that have more rows are cut into ranges of their
order, at quantiles of it. Each range is a partition of its own: running values start anew in it, the ranges' totals (a
few rows a key) are summed up in order, and what comes from the ranges before is joined to a range's rows. All other
keys stay one range, so the window and the join share one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = "_range"


@dataclass(frozen=True)
class Split:
    """Keys of more than ``rows`` rows are cut into up to ``ranges`` ranges."""

    rows: int = 1_000_000
    ranges: int = 64


@dataclass(frozen=True)
class Running:
    """``kind`` (sum, max, min, first or last, the last two without nulls) of ``value`` over the rows up to each
    one, or before it."""

    kind: str
    value: Column
    inclusive: bool = True

    def over(self, window) -> Column:
        frame = window.rowsBetween(W.unboundedPreceding, W.currentRow if self.inclusive else -1)
        return self._aggregate(self.value).over(frame)

    def _aggregate(self, value: Column) -> Column:
        if self.kind in ("first", "last"):
            return getattr(F, self.kind)(value, ignorenulls=True)
        return getattr(F, self.kind)(value)

    def total(self, order: Column, descending: bool) -> Column:
        """The value of a whole range."""
        if self.kind not in ("first", "last"):
            return self._aggregate(self.value)
        there = F.when(self.value.isNotNull(), order)
        return (F.min_by if (self.kind == "first") != descending else F.max_by)(self.value, there)

    def carried(self, name: str, before) -> Column:
        """The value of all ranges before one, of the column with their totals."""
        return self._aggregate(F.col(name)).over(before)

    def joined(self, before: Column, within: Column) -> Column:
        if self.kind == "sum":
            return F.when(before.isNull(), within).when(within.isNull(), before).otherwise(before + within)
        if self.kind in ("max", "min"):
            return (F.greatest if self.kind == "max" else F.least)(before, within)  # nulls don't count
        return F.coalesce(before, within) if self.kind == "first" else F.coalesce(within, before)


def with_ranges(df: DataFrame, keys: list[str], order: str, split: Split) -> DataFrame:
    """Adds ``_range``: the number of a row's range within its key, rising with ``order`` (a number)."""
    cuts = [i / split.ranges for i in range(1, split.ranges)]
    found = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(order, cuts, 100 * split.ranges).alias("_cuts"))
    hot = found.where(F.col("_n") > split.rows).select(*keys, "_cuts")
    ranged = df.join(hot, keys, "left")
    number = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return ranged.withColumn(RANGE, F.when(F.col("_cuts").isNull(), 0).otherwise(number)).drop("_cuts")


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, Running], split: Split | None = None, descending: bool = False) -> DataFrame:
    """Adds the running ``values`` of each key's rows in their order (or from the last to the first).

    Without ``split`` they are windows. With it the order must be a number and the keys not null; the result is the
    same, whatever ``df`` has as ``_range`` before.
    """
    column = F.col(order).desc() if descending else F.col(order)
    if split is None:
        window = W.partitionBy(*keys).orderBy(column)
        return df.withColumns({name: value.over(window) for name, value in values.items()})
    rows = df if RANGE in df.columns else with_ranges(df, keys, order, split)
    window = W.partitionBy(*keys, RANGE).orderBy(column)
    within = rows.withColumns({name: value.over(window) for name, value in values.items()})
    totals = rows.groupBy(*keys, RANGE).agg(*(value.total(F.col(order), descending).alias(f"_{name}") for name, value in values.items()))
    carried = carry(totals, keys, {f"_{name}": value for name, value in values.items()}, descending)
    met = within.join(carried, [*keys, RANGE], "left")
    joined = {name: value.joined(F.col(f"_{name}"), F.col(name)) for name, value in values.items()}
    out = met.withColumns(joined).drop(*(f"_{name}" for name in values))
    return out if RANGE in df.columns else out.drop(RANGE)


def carry(totals: DataFrame, keys: list[str], values: dict[str, Running], descending: bool = False) -> DataFrame:
    """For each range of ``totals`` (keys, _range and a column a value) what the ranges before it add up to. The rows of a
    key are its ranges, so few."""
    before = W.partitionBy(*keys).orderBy(F.col(RANGE).desc() if descending else F.col(RANGE)).rowsBetween(W.unboundedPreceding, -1)
    several = F.count("*").over(W.partitionBy(*keys)) > 1
    found = totals.withColumn("_several", several).where("_several")
    return found.select(*keys, RANGE, *(value.carried(name, before).alias(name) for name, value in values.items()))
