"""Captures by a user's function as a stream: a clock as a Python data source, and what it polls.

The clock's offsets are numbers of ticks, so a stream that starts again goes on with the tick after the
last one that it finished and repeats none. Each tick meets the table of what is polled, which may be of any
size, and the user's function runs on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chatloom.operators.hooks import captured


class Tick(InputPartition):
    def __init__(self, tick: int, at_ms: int):
        self.tick, self.at_ms = tick, at_ms


class _Ticks(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.interval_ms = max(1000, int(options.get("interval_ms", "60000")))
        self.first, self.last = (int(options[k]) if k in options else None for k in ("first", "last"))
        self.missed = options.get("missed", "skip")
        if self.missed not in ("skip", "replay"):
            raise ValueError("missed: skip or replay")

    def _now(self) -> int:
        return int(time.time() * 1000) // self.interval_ms

    def initialOffset(self) -> dict:
        return {"tick": self._now() if self.first is None else self.first - 1}

    def latestOffset(self) -> dict:
        return {"tick": self._now() if self.last is None else self.last}

    def partitions(self, start: dict, end: dict) -> list[Tick]:
        ticks = range(start["tick"] + 1, end["tick"] + 1)
        return [Tick(t, t * self.interval_ms) for t in (ticks[-1:] if self.missed == "skip" else ticks)]

    def read(self, partition: Tick) -> Iterator[tuple]:
        yield partition.tick, partition.at_ms

    def commit(self, end: dict) -> None:
        pass


class Polls(DataSource):
    """``spark.readStream.format("chatloom_polls")``: tick, at_ms (its time, in milliseconds since 1970).

    Options: ``interval_ms`` (60,000; 1,000 at least): a tick is a multiple of it. ``missed``: of several ticks that
    are due at once (after a stop, say) only the last (``skip``) or all (``replay``). ``first`` and ``last``: the
    numbers of the first and the last tick, for a run over given ticks instead of the machine's clock.
    """

    @classmethod
    def name(cls) -> str:
        return "chatloom_polls"

    def schema(self) -> str:
        return "tick bigint, at_ms bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Ticks({k.lower(): v for k, v in self.options.items()})


def poll(spark: SparkSession, polled: DataFrame, capture_fn: Callable[..., str | None], key: str, **options: object) -> DataFrame:
    """A stream of captures: the columns of ``polled``, tick, at_ms, frame.

    At each tick ``capture_fn(key, tick)`` runs for every row of ``polled``; where it returns None or fails, the
    cycle is skipped. ``options``: those of ``Polls``.
    """
    spark.dataSource.register(Polls)
    ticks = spark.readStream.format(Polls.name()).options(**options).load()
    # One row a tick meets all that is polled: that is what a tick is. The ticks go to where the polled rows are.
    due = polled.crossJoin(F.broadcast(ticks))
    return captured(due, capture_fn, key, "tick").drop("stdout", "stderr", "exit_code")
