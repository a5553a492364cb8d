"""Keyed streaming state: the order-dependent rules of the batch operators, live.

Each processor is a small fold: rows of a key in order of ``seq`` go through ``step`` with the key's
state. On the same rows the result equals the batch operator's, in whatever order they arrive:

* With a ``time`` column and a ``delay`` rows wait in a reorder buffer in Spark's state store (RocksDB), in pages of
  neighbouring times, of which a release reads those that are due. When the watermark passes a row's time, by a
  batch or by an event-time timer, it is released, in order of seq with all others that are due. ``closing`` ends the input of a stream that is to be run to its end.
* With ``hold_ms`` rows wait for so long after they came in (processing time).
* With neither, rows are sorted within a micro-batch and go through at once.

What comes too late, at or below the last seq of its key that went through, changes nothing and is never
lost: it comes out as a row of its own, with late_seq and late_row (the row as JSON). ``on_time`` and
``too_late`` separate the two.

State follows new rows: small values, the event log among them, are one JSON text a key; tokens are parts in the
state store, so a batch writes what it brought, not what there was. Keys are dealt into buckets: calls of the
state store are one or two a key and batch, and Python gets and gives thousands of rows at once. Idle keys can be given a time to
live (``ttl_ms``, without a watermark).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import batched, chain
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from chatloom.operators.memory import EXCERPT_CHARS, INLINE_CHARS, SUMMARY_CHARS

OPEN = "<think>"
_THOUGHT = re.compile("<think>.*?</think>", re.S)
_CUT_OPEN, _CUT_CLOSE = (re.compile("(?:" + "|".join(re.escape(tag[:n]) for n in range(len(tag) - 1, 0, -1)) + r")?\Z") for tag in (OPEN, "</think>"))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "late_seq bigint, late_row string"
#: The time of the row that ends a stream's input.
END = "9999-01-01 00:00:00"
_NO_SEQ = -(1 << 63)
#: Groups of keys that share a timer and travel together; fixed, as the state in a checkpoint goes by them.
BUCKETS = 1024
Row = Any


class Fold(StatefulProcessor):
    """Runs ``step(state, row)``, which yields output rows without the key, over a key's rows in order.

    Spark's grouping key is a bucket of keys, so timers and batches of rows go by bucket; a key costs a
    batch one read and one write of its state.
    """

    #: Output columns after the key, as DDL.
    columns = ""

    #: All output columns, the input's, and whether it has times; set by run_fold.
    names: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    timed = False
    hold_ms: int | None = None
    #: Rows that wait in one value of the state store, and rows that are put out at once.
    page_rows, at_once = 1_000, 10_000

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further state of a fold."""

    def save(self, key: str | None, state: dict) -> None:
        """Called after a key's rows: writes what ``step`` has gathered for further state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getMapState("state", "key string", "json string", self.ttl_ms)
        self.waits = self.timed or self.hold_ms is not None
        if self.waits:
            self.index = handle.getValueState("index", "json string")
            self.pages = handle.getMapState("pages", "page bigint", "json string", self.ttl_ms)
        self.open(handle)

    def _limit(self, now: Any) -> int:
        """Rows with times up to here are due."""
        return now.getCurrentWatermarkInMs() if self.timed else now.getCurrentProcessingTimeInMs() - self.hold_ms

    def _late(self, key: str | None, seq: int, row: str) -> tuple:
        return (key, *[None] * (len(self.names) - 3), None if seq == _NO_SEQ else seq, row)

    def _through(self, rows: list[tuple]) -> Iterator[tuple]:
        """``rows`` (key, seq, at, JSON) of a bucket through the fold, each key's in order."""
        keys: dict[str | None, list[tuple]] = {}
        for row in rows:
            keys.setdefault(row[0], []).append(row)
        known = bool(keys) and self.value.exists()
        for key, its in keys.items():
            held = self.value.getValue((key,)) if known else None
            self.key, state = key, {"last": None, "x": self.start()} if held is None else json.loads(held[0])
            for _, seq, _, row in sorted(its, key=lambda r: r[1]):
                if state["last"] is not None and seq <= state["last"]:
                    yield self._late(key, seq, row)
                    continue
                state["last"] = seq
                values = SimpleNamespace(**dict.fromkeys(self.fields) | json.loads(row), seq=seq)
                for x in self.step(state["x"], values):
                    yield (key, *x, None, None)
            self.save(key, state["x"])
            self.value.updateValue((key,), (json.dumps(state),))

    def _keep(self, index: dict, rows: list[tuple]) -> None:
        """Rows that wait, in pages of neighbouring times."""
        rows.sort(key=lambda r: r[2])
        for page in batched(rows, self.page_rows):
            self.pages.updateValue((index["next"],), (json.dumps(page),))
            index["pages"].append([index["next"], page[0][2]])
            index["next"] += 1

    def _read(self, index: dict, upto: int | None) -> list[tuple]:
        """Takes the pages that have times up to ``upto`` (None: all) out of the store."""
        taken, rows = [p for p, low in index["pages"] if upto is None or low <= upto], []
        for p in taken:
            page = self.pages.getValue((p,))
            rows += [] if page is None else map(tuple, json.loads(page[0]))  # None: its time to live is over
            self.pages.removeKey((p,))
        index["pages"] = [x for x in index["pages"] if x[0] not in set(taken)]
        return rows

    def _release(self, index: dict, fresh: list[tuple], limit: int) -> list[tuple]:
        """What is due of ``fresh`` and of the pages; the rest waits.

        Whatever comes before a row that is due goes with it. Times rise with seq, so this is due itself, but
        if a row has no time (0) or times are those of arrival: then all that waits is looked at.
        """
        due = any(r[2] <= limit for r in fresh) or any(low <= limit for _, low in index["pages"])
        if not due:
            self._keep(index, fresh)
            return []
        rows = fresh + self._read(index, limit if self.timed and all(r[2] > 0 for r in fresh) else None)
        upto: dict[str | None, int] = {}
        for key, seq, at, _ in rows:
            if at <= limit:
                upto[key] = max(seq, upto.get(key, _NO_SEQ))
        self._keep(index, [r for r in rows if r[1] > upto.get(r[0], _NO_SEQ)])
        return [r for r in rows if r[1] <= upto.get(r[0], _NO_SEQ)]

    def _close(self, index: dict) -> None:
        """Sets the timer for what waits longest, and writes the index of pages."""
        low = min((low for _, low in index["pages"]), default=None)
        wanted = None if low is None else low + (0 if self.timed else self.hold_ms)
        if wanted != index["timer"]:
            if index["timer"] is not None:
                self.handle.deleteTimer(index["timer"])
            if wanted is not None:
                self.handle.registerTimer(wanted)
            index["timer"] = wanted
        self.index.update((json.dumps(index),))

    def _index(self) -> dict:
        held = self.index.get()
        return {"timer": None, "next": 0, "pages": []} if held is None else json.loads(held[0])

    def _out(self, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        for some in batched(rows, self.at_once):
            yield pd.DataFrame(some, columns=self.names, dtype=object)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.hold_ms is not None else 0
        late, fresh = [], []
        for batch in rows:
            times = batch["at_ms"] if self.timed else [now] * len(batch)
            for k, seq, at, row in zip(batch["key_text"], batch["seq"], times, batch["row_json"], strict=True):
                if seq == _NO_SEQ:
                    late.append(self._late(k, _NO_SEQ, row))
                else:
                    fresh.append((k, int(seq), int(at), row))
        if self.hold_ms is not None:
            last = {k: json.loads(held[0])["last"] for k in {r[0] for r in fresh} if (held := self.value.getValue((k,))) is not None}
            late += [self._late(r[0], r[1], r[3]) for r in fresh if r[1] <= last.get(r[0], _NO_SEQ)]
            fresh = [r for r in fresh if r[1] > last.get(r[0], _NO_SEQ)]
        if self.waits:
            index = self._index()
            fresh = self._release(index, fresh, self._limit(timerValues))
            self._close(index)
        yield from self._out(chain(late, self._through(fresh)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        index = self._index()
        index["timer"] = None  # it has gone off
        due = self._release(index, [], self._limit(timerValues))
        self._close(index)
        yield from self._out(self._through(due))

    def close(self) -> None:
        pass


def _marked(df: DataFrame, time: str, delay: str) -> DataFrame:
    """``df`` with a watermark. The end's row moves it and goes; the caller leaves the time itself out, so
    that Spark drops no late rows."""
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return df.where(F.coalesce(F.col(time) < F.lit(END).cast("timestamp"), F.lit(True)))


def run_fold(df: DataFrame, key: str, fold: Fold, names: list[str], time: str | None = None, delay: str | None = None, hold_ms: int | None = None) -> DataFrame:
    """The fold over ``df`` (a stream or a table with key and seq): key, ``names``…, late_seq, late_row.

    ``time``, a timestamp that does not fall as seq rises, with ``delay``, the most that a row may lag
    behind the latest of the stream; or ``hold_ms``; or neither (see the module's text). A row whose seq is null has no
    place in the order and comes out as late.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = df.schema[key].dataType.simpleString()
    fold.fields = tuple(c for c in df.columns if c not in (key, "seq", time))
    fold.timed, fold.hold_ms = time is not None, hold_ms
    if fold.timed and (delay is None or hold_ms is not None or fold.ttl_ms):
        raise ValueError("a time needs a delay, and neither hold_ms nor ttl_ms")
    fold.names = ("key_text", *(c.split()[0] for c in fold.columns.split(", ")), "late_seq", "late_row")
    row = F.to_json(F.struct(*fold.fields)) if fold.fields else F.lit("{}")
    text = F.col(key).cast("string")
    columns = [F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket"), text.alias("key_text"), F.coalesce("seq", F.lit(_NO_SEQ)).cast("long").alias("seq"), row.alias("row_json")]
    mode = "ProcessingTime" if fold.ttl_ms or hold_ms is not None else "None"
    if fold.timed:
        mode = "EventTime"
        df = _marked(df, time, delay)
        columns.append(F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(0)).alias("at_ms"))
    out = df.select(*columns).groupBy("bucket").transformWithStateInPandas(fold, f"key_text string, {fold.columns}, {LATE}", "Append", mode)
    return out.toDF(key, *names, "late_seq", "late_row").withColumn(key, F.col(key).cast(kind))


def on_time(out: DataFrame) -> DataFrame:
    """The results of a fold."""
    return out.where("late_row IS NULL").drop("late_seq", "late_row")


def too_late(out: DataFrame) -> DataFrame:
    """The rows that came too late: key, late_seq, late_row."""
    return out.where("late_row IS NOT NULL").select(out.columns[0], "late_seq", "late_row")


def closing(stream: DataFrame, time: str, folder: str) -> DataFrame:
    """``stream`` with the rows of a folder that is empty until ``runs.close_input`` puts the one row there that
    moves the watermark past all others."""
    end = stream.sparkSession.readStream.schema(f"{time} timestamp").parquet(folder)
    return stream.unionByName(end, allowMissingColumns=True)


class Changes(Fold):
    """A capture whose hash differs from the one before (column frame; null ones are skipped)."""

    columns = "seq bigint, hash string, previous_hash string"

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        if row.frame is not None:
            now, before = hashlib.sha256(row.frame.encode()).hexdigest(), state.get("hash")
            state["hash"] = now
            if before is not None and before != now:
                yield row.seq, now, before


class Sessions(Fold):
    """What each poll returns (columns kind, value): tokens joined by commas, done, error."""

    columns = "seq bigint, tokens string, done string, error string"

    def start(self) -> dict:
        return {"parts": [0, 0], "done": False, "error": None, "gone": False}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "key string, part bigint", "json string", self.ttl_ms)
        self.fresh: list[str] = []

    def save(self, key: str | None, state: dict) -> None:
        """Tokens that no poll has taken join those in the store, as a part of their own."""
        for some in batched(self.fresh, self.page_rows):
            self.tokens.updateValue((key, state["parts"][1]), (json.dumps(some),))
            state["parts"][1] += 1
        self.fresh = []

    def _taken(self, state: dict) -> list[str]:
        stored = []
        for part in range(*state["parts"]):
            held = self.tokens.getValue((self.key, part))
            stored += [] if held is None else json.loads(held[0])
            self.tokens.removeKey((self.key, part))
        stored, self.fresh, state["parts"] = stored + self.fresh, [], [state["parts"][1]] * 2
        return stored

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        if row.kind == "poll":
            yield (row.seq, None, None, None) if state["gone"] else (row.seq, ",".join(t for t in self._taken(state) if t is not None), str(state["done"]).lower(), state["error"])
        elif row.kind == "discard":
            self._taken(state)
            state["gone"] = True
        elif not state["gone"]:
            if row.kind == "token":
                self.fresh.append(row.value)
            elif row.kind == "finish":
                state |= {"done": True, "error": row.value}


class RollingMemory(Fold):
    """Excerpt and summary after each exchange (columns role, text). ``merge_fn`` as in the batch fold.

    A column ``stored`` has the summary to go on from; a conversation's first row counts. Of texts that
    wait for an answer only what can reach an excerpt is kept.
    """

    columns = "xid bigint, excerpt string, summary string, branch string"

    def __init__(self, merge_fn=None, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.merge_fn = merge_fn

    def start(self) -> dict:
        return {"held": [], "summary": None, "xid": 0}

    @staticmethod
    def _hold(held: list, role: str, text: str) -> None:
        """Adds a message; drops what lies beyond the excerpt, but for the last prompt and answer."""
        held.append([role, text[-EXCERPT_CHARS:]])
        last, size, keep = {}, 0, []
        for i in range(len(held) - 1, -1, -1):
            r, t = held[i]
            newest = r not in last and (r == "user" or t)
            if newest:
                last[r] = i
            if size < EXCERPT_CHARS or newest:
                keep.append(held[i])
            size += len(t) + 1 if t else 0
        held[:] = keep[::-1]

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        if state["summary"] is None:
            state["summary"] = getattr(row, "stored", None) or ""
        if row.role not in ("user", "assistant"):
            return
        self._hold(state["held"], row.role, row.text or "")
        if row.role == "user":
            return
        held, xid = state["held"], state["xid"]
        excerpt = "\n".join(f"{r}: {t}" for r, t in held if t)[-EXCERPT_CHARS:]
        last = {r: i for i, (r, t) in enumerate(held) if r == "user" or t}
        state |= {"held": [[r, t[-EXCERPT_CHARS:]] for r, t in (held[i] for i in sorted(last.values()))], "xid": xid + 1}
        if not excerpt:
            return
        before = state["summary"]
        appended = (f"{before}\n{excerpt}" if before else excerpt)[-SUMMARY_CHARS:]
        branch = "inline" if len(excerpt) < INLINE_CHARS else "merge" if before else "seed"
        state["summary"] = appended
        if branch == "merge" and self.merge_fn is not None:
            try:
                state["summary"] = self.merge_fn(before, excerpt)
            except Exception:  # whatever the user's function raises: it stays appended
                pass
        yield xid, excerpt, state["summary"], branch


class FileTimes(Fold):
    """A poll's file time (column mtime; null: missing, counts as 0) that differs from the one before."""

    columns = "seq bigint, mtime double, previous_mtime double"

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        now, before = float(row.mtime or 0), state.get("mtime")
        now = 0.0 if now != now else now
        state["mtime"] = now
        if before is not None and before != now:
            yield row.seq, now, before


class LoopStates(Fold):
    """Reconciled loop states; column ``state`` holds a state as JSON, in and out."""

    columns = "seq bigint, state string"

    def __init__(self, operator_cap: int | None = None, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.operator_cap = operator_cap if operator_cap and operator_cap > 0 else None

    def start(self) -> dict:
        return {"plan": None, "floor": 0, "ended": False, "reason": ""}

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        now = json.loads(row.state)
        if state["plan"] is None and now.get("action"):
            state["plan"] = {k: now.get(k) for k in ("goal", "action", "exit_criteria")} | {"max_iterations": self.operator_cap or now.get("max_iterations")}
        if state["plan"] is not None:
            state["floor"] = max(state["floor"], now["iterations"])
            if now["terminated"]:
                state["ended"], state["reason"] = True, state["reason"] or now["termination_reason"]
            now |= state["plan"] | {"iterations": state["floor"], "terminated": state["ended"], "termination_reason": state["reason"]}
        yield row.seq, json.dumps(now)


class ProjectStates(Fold):
    """Reconciled project states; column ``state`` holds a state as JSON, in and out."""

    columns = "seq bigint, state string"

    def start(self) -> dict:
        return {"plan": None, "tasks": [], "done": [], "log": []}

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        now = json.loads(row.state)
        if state["plan"] is None and now.get("tasks"):
            state["plan"] = {k: now.get(k) for k in ("goal", "constraints")}
            state["tasks"] = [[t["id"], t["title"]] for t in now["tasks"]]
        if state["plan"] is not None:
            fresh = {t["id"] for t in now["tasks"] if t["done"]}
            state["done"] = [i for i, _ in state["tasks"] if i in fresh or i in state["done"]]
            state["log"] = max(state["log"], now.get("log") or [], key=len)
            now |= state["plan"] | {"log": state["log"], "tasks": [{"id": i, "title": title, "done": i in state["done"]} for i, title in state["tasks"]]}
        yield row.seq, json.dumps(now)


def stream_states(states: DataFrame, fold: Fold, **order: Any) -> DataFrame:
    """A stream of normalised states (instance_id, seq and the fields of the batch operator) reconciled
    live by ``LoopStates`` or ``ProjectStates``: the same columns. ``order``: time, delay or hold_ms, as in
    ``run_fold``."""
    fields = [f for f in states.schema.fields if f.name not in ("instance_id", "seq", order.get("time"))]
    times = [order["time"]] if order.get("time") else []
    packed = states.select("instance_id", "seq", *times, F.to_json(F.struct(*(f.name for f in fields))).alias("state"))
    out = on_time(run_fold(packed, "instance_id", fold, ["seq", "state"], **order))
    back = F.from_json("state", StructType(fields)).alias("s")
    return out.select("instance_id", "seq", back).select("instance_id", "seq", "s.*")


class ThinkFilter(Fold):
    """The visible part of each chunk of a think-tagged stream (column content).

    What is not shown yet is judged together with the new chunk, by the rule for whole texts: what lies
    outside runs of thinking is visible. A tail that may become a tag waits for the next chunk.
    """

    columns = "seq bigint, visible string"

    def start(self) -> dict:
        return {"pending": ""}

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        *shown, last = _THOUGHT.split(state["pending"] + (row.content or ""))
        outside, opened, thinking = last.partition(OPEN)
        tail = (_CUT_CLOSE if opened else _CUT_OPEN).search(thinking if opened else outside)[0]
        state["pending"] = opened + tail
        shown.append(outside if opened else outside.removesuffix(tail))
        if visible := "".join(shown):
            yield row.seq, visible


class EventLog(Fold):
    """The last 50 iterations: for each new one its position, and the one that it pushes out.

    The log is a ring in the key's state: iteration n stands in slot n modulo 50."""

    columns = "iteration bigint, position bigint, dropped bigint"
    kept = 50

    def start(self) -> dict:
        return {"n": 0, "ring": []}

    def step(self, state: dict, row: Row) -> Iterator[tuple]:
        ring, slot, dropped = state["ring"], state["n"] % self.kept, None
        if len(ring) < self.kept:
            ring.append(row.seq)
        else:
            dropped, ring[slot] = ring[slot], row.seq
        state["n"] += 1
        yield row.seq, min(state["n"], self.kept), dropped


class Schedules(StatefulProcessor):
    """Fires schedules (key due_us, bucket; id, submitted_us): at their time by a timer, or at once if that was past
    when they came in. Those of one time wait in one list with one timer, so state calls follow times,
    not schedules. Times are microseconds since 1970, so no zone touches them here."""

    columns = "due_us bigint, fire_us bigint"
    #: Parts of the schedules of one time, and how many are put out at once.
    buckets, at_once = 8, 10_000

    def __init__(self, kind: str, timed: bool = False):
        self.kind, self.timed = kind, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"id {self.kind}, submitted bigint")

    def _now(self, timerValues: Any) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.timed else timerValues.getCurrentProcessingTimeInMs()

    def _fired(self, due: int, ids: Any, submitted: Any) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, "due_us": due, "fire_us": [max(due, int(s)) for s in submitted]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due, waits = int(key[0]), False
        past = due <= self._now(timerValues) * 1000
        for batch in rows:
            if past:
                yield self._fired(due, batch["id"], batch["submitted_us"])
            elif len(batch):
                self.pending.appendList(list(zip(batch["id"].tolist(), batch["submitted_us"].tolist(), strict=True)))
                waits = True
        if waits:
            self.handle.registerTimer(-(-due // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for some in batched(self.pending.get(), self.at_once):
            yield self._fired(int(key[0]), [r[0] for r in some], [r[1] for r in some])
        self.pending.clear()

    def close(self) -> None:
        pass


def stream_schedules(schedules: DataFrame, time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of schedules (id, submitted, due) as a stream of those that fire: id, due, fire_ts.

    What is pending is state with a timer, so a schedule fires when its time comes, also after the last
    row of input, as long as the stream runs; nothing is read again. That time is the machine's, or, with a
    column ``time`` (such as submitted) and a ``delay``, the stream's own: schedules fire as the watermark
    passes them, the same in a replay as live. A null submitted counts as long past.
    """
    schedules.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if time is not None:
        schedules = _marked(schedules, time, delay)
    micros = (F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0)).alias(f"{c}_us") for c in ("due", "submitted"))
    # a repeated id changes nothing
    rows = schedules.where("due IS NOT NULL").select("id", *micros).dropDuplicates(["id"])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(Schedules.buckets)).cast("int"))
    kind = schedules.schema["id"].dataType.simpleString()
    fired = rows.groupBy("due_us", "bucket").transformWithStateInPandas(Schedules(kind, time is not None), f"id {kind}, {Schedules.columns}", "Append", "EventTime" if time is not None else "ProcessingTime")
    return fired.select("id", F.timestamp_micros("due_us").alias("due"), F.timestamp_micros("fire_us").alias("fire_ts"))
