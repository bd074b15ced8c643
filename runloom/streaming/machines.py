"""State machines over the run log: one small state for each task or run, kept only while it can still matter.

A row later than the watermark never reaches a machine.  A state whose time the watermark has passed can therefore be given up
without loss: whatever comes for its key afterwards is newer.  Timers do that, so that state grows with what is going on and not with
what has been.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runloom.operators.runlog import SEVERITY, TAG_LINE, stamped_state, stamped_time, state_stamp
from runloom.streaming.runs import LATENESS

STATES = list(SEVERITY)
FINISHED = ("completed", "failed")
#: A task that is not finished and says nothing for so many milliseconds leaves the state as well.
SILENT_MS = 24 * 3600 * 1000
TASK_CHANGES = "run_id long, task string, before string, state string, ts timestamp"
RUN_SPANS = "run_id long, started_us long, ended_us long"


class _Timed(StatefulProcessor):
    """A processor with at most one timer for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "at long")

    def wake(self, at_ms: int | None) -> None:
        if self.alarm.exists():
            (old,) = self.alarm.get()
            if old == at_ms:
                return
            self.handle.deleteTimer(old)
            self.alarm.clear()
        if at_ms is not None:
            self.handle.registerTimer(at_ms)
            self.alarm.update((at_ms,))

    def close(self) -> None:
        pass


class _TaskChanges(_Timed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "stamp long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps = np.unique(np.concatenate([r["stamp"].to_numpy() for r in rows]))
        held = self.newest.get()[0] if self.newest.exists() else None
        fresh = stamps[stamps > held] if held is not None else stamps
        if not len(fresh):
            return
        rank = np.append(-1 if held is None else held % len(STATES), fresh % len(STATES))
        changed = np.flatnonzero(rank[1:] != rank[:-1])
        last = int(fresh[-1])
        self.newest.update((last,))
        done_ms = last // len(STATES) // 1000 + 1
        self.wake(done_ms if STATES[last % len(STATES)] in FINISHED else done_ms + SILENT_MS)
        if len(changed):
            yield pd.DataFrame({
                "run_id": pd.array([key[0]] * len(changed), dtype="Int64"), "task": pd.Series([key[1]] * len(changed), dtype=object),
                "before": pd.Series([STATES[r] if r >= 0 else None for r in rank[changed]], dtype=object),
                "state": pd.Series([STATES[r] for r in rank[changed + 1]], dtype=object),
                "ts": pd.to_datetime(fresh[changed] // len(STATES), unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.alarm.clear()
        return iter([])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for every batch that is read: a task that speaks very often sends little to its machine."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()


def task_changes(events: DataFrame) -> DataFrame:
    """Changes of state of every task, in append mode: ``run_id, task, before, state, ts``.

    ``events`` has (run_id, task, state, ts).  States count in order of time, at one time in order of severity; a line that is older
    than what has been reported for its task changes nothing, within one micro-batch all are put in order first.  A finished
    task leaves the state once the watermark has passed it, and no line from before can revive it; a later line starts it anew
    (``before`` is null then).  Null runs and tasks are keys like others; a null time is dropped.
    """
    stamped = events.where("ts IS NOT NULL").select("run_id", "task", "ts", state_stamp(F.col("ts"), F.col("state")).alias("stamp"))
    once = stamped.mapInArrow(_distinct, stamped.schema).withWatermark("ts", LATENESS)
    return once.groupBy("run_id", "task").transformWithStateInPandas(_TaskChanges(), TASK_CHANGES, "Append", "EventTime")


def last_states(changes: DataFrame) -> DataFrame:
    """Last state of every task among its changes: ``run_id, task, state, ts`` (of its last change)."""
    stamp = F.max(state_stamp(F.col("ts"), F.col("state"))).alias("stamp")
    return changes.groupBy("run_id", "task").agg(stamp).select(
        "run_id", "task", stamped_state(F.col("stamp")).alias("state"), stamped_time(F.col("stamp")).alias("ts"))


class _RunSpans(_Timed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.span = handle.getValueState("span", "started_us long, ended_us long, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        started, ended, closed = self.span.get() if self.span.exists() else (None, None, False)
        if closed:  # the tags of a run that was reported are repeated
            return
        for is_start, at in zip(frame["is_start"], frame["at_us"]):
            if is_start:
                started = int(at) if started is None else max(started, int(at))
            else:
                ended = int(at) if ended is None else max(ended, int(at))
        closed = started is not None and ended is not None
        self.span.update((started, ended, closed))
        if closed:
            self.wake(max(started, ended) // 1000 + 1)
            yield pd.DataFrame({"run_id": pd.array([key[0]], dtype="Int64"), "started_us": [started], "ended_us": [ended]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.span.clear()
        self.alarm.clear()
        return iter([])


def run_spans(log: DataFrame) -> DataFrame:
    """Runs that have ended, in append mode: ``run_id, started_us, ended_us`` (microseconds since 1970).

    ``log`` has (run_id, message).  A run opens with its start tag and closes with its end tag, in either order of arrival; it is
    reported when both are there, and kept until the watermark has passed it, so that repeated tags do not report it again.  Open
    runs stay in the state: :func:`open_runs` reads them.
    """
    kind, at = F.regexp_extract("message", TAG_LINE, 1), F.nullif(F.regexp_extract("message", TAG_LINE, 2), F.lit(""))
    tags = log.select("run_id", (kind == "start").alias("is_start"), at.try_cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    return tags.withColumn("at_us", F.unix_micros("ts")).withWatermark("ts", "7 days").groupBy("run_id").transformWithStateInPandas(
        _RunSpans(), RUN_SPANS, "Append", "EventTime")


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Runs that a stream of :func:`run_spans` has seen begin or end, but not both; with the columns of that stream."""
    state = spark.read.format("statestore").option("stateVarName", "span").load(checkpoint)
    return state.where("NOT value.closed").select("key.run_id", "value.started_us", "value.ended_us")
