"""Streams over several micro-batches give what the batch form gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runloom.operators import runlog
from runloom.streaming import machines, runs

SCHEMA = "run_id long, task string, state string, pool string, ts timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark, tmp_path):
    def make(*batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
        return spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("b")

    return make


def event(minutes, task="a", state="running", run=1):
    return (run, task, state, "p", START + timedelta(minutes=minutes))


def test_states_ignore_order_of_arrival(stream_of, rows):
    stream = stream_of([event(5, state="completed")], [event(1)], [event(5, state="failed"), event(9, "b")])
    batches = runs.drain(runs.task_states(stream), "t", "update")
    assert rows(runs.newest_states(batches), "task", "state") == {("a", "failed"), ("b", "running")}


def test_counts_over_batches(stream_of, rows):
    stream = stream_of([event(1), event(2), event(61)], [event(62), event(125)])
    counted = runs.latest(runs.drain(runs.run_counts(stream), "t", "update"), ["window_start", "pool"])
    got = sorted(r["n"] for r in counted.collect())
    batches = runs.drain(runs.run_counts(stream, "2 hours", "1 hour"), "t", "update")
    sliding = runs.latest(batches, ["window_start", "pool"]).agg(F.sum("n")).first()[0]
    assert got == [1, 2, 2]
    assert sliding == 10


def test_late_rows_are_dropped(stream_of):
    stream = stream_of([event(600)], [event(601)], [event(1), event(599)])
    counted = runs.latest(runs.drain(runs.run_counts(stream), "t", "update"), ["window_start", "pool"])
    assert counted.agg(F.sum("n")).first()[0] == 3


def test_sessions(spark, stream_of, rows):
    """Sessions come out when they are over; those still open are read from the state."""
    stream = stream_of([event(0), event(300)], [event(700), event(10, run=2)], [event(2000)], [event(2010), event(2020)])
    done = runs.run_to_end(runs.run_sessions(stream), "t", "append")
    assert rows(done.rows, "run_id", "n") == {(1, 2), (1, 1), (2, 1)}
    assert rows(runs.open_sessions(spark, done.checkpoint), "run_id", "n") == {(1, 3)}
    assert runs.open_sessions(spark, done.checkpoint).columns == done.rows.drop("batch_id").columns


def many_tasks(n_batches=12, n_tasks=20):
    """Batches an hour apart, each with tasks of its own that end within it, one task that runs on, and old lines about earlier tasks."""
    batches = []
    for b in range(n_batches):
        at = 60 * b
        rows = [event(at + i % 7, f"b{b}t{i}", "running") for i in range(n_tasks)] + [event(at + 8, f"b{b}t{i}", "completed") for i in range(n_tasks)]
        rows.append(event(at + 9, "on", "running" if b % 2 else "pending"))
        if b > 3:
            rows += [event(60 * (b - 4) + 20, f"b{b - 4}t{i}", "running") for i in range(n_tasks)]  # later than their end, but too late to be read
        batches.append(rows)
    return batches


def in_time(batches):
    return [[r for r in batch if r[4].minute != 20] for batch in batches]


@pytest.mark.parametrize("machine", [False, True])
def test_states_leave_the_stream(stream_of, rows, machine):
    """The state holds what is going on, not what has been, and late lines revive nothing: the result is that of the lines in time."""
    batches = many_tasks()
    stream = stream_of(*batches)
    if machine:
        done = runs.run_to_end(machines.task_changes(stream), "t", "append")
        got = rows(machines.last_states(done.rows), "task", "state")
    else:
        done = runs.run_to_end(runs.task_states(stream), "t", "update")
        got = rows(runs.newest_states(done.rows), "task", "state")
    want = {}
    for row in sorted((r for batch in in_time(batches) for r in batch), key=lambda r: r[4]):
        want[row[1]] = row[2]
    assert got == set(want.items()) and len(want) == 241
    assert done.n_late > 0
    # of 241 tasks no more than those of a few batches are held; a machine has a state, an alarm and its index for each
    assert max(done.state_rows) <= 63 * (4 if machine else 1)


def test_changes_are_reported_once(spark, stream_of):
    stream = stream_of(
        [event(0, state="pending"), event(1), event(1), event(2, "b"), event(3, "b", "completed")],
        [event(4), event(5, state="completed"), event(0.5, state="failed")], [event(6, "b"), event(6, "b", "failed"), (None, None, "running", "p", START)])
    got = runs.drain(machines.task_changes(stream), "t", "append").collect()
    seen = [(r["task"], r["before"], r["state"]) for r in sorted(got, key=lambda r: (str(r["task"]), r["ts"], runlog.SEVERITY[r["state"]]))]
    assert seen == [
        (None, None, "running"), ("a", None, "pending"), ("a", "pending", "running"), ("a", "running", "completed"),
        ("b", None, "running"), ("b", "running", "completed"), ("b", "completed", "running"), ("b", "running", "failed")]


def test_run_spans(spark, tmp_path, rows):
    """Tags in any order and over several files; what repeats is reported once, what has not ended is read from the state."""
    day = "2024-01-0"
    parts = [
        [(1, f"@wf_start {day}1 00:00:00.5"), (2, f"@wf_end {day}1 03:00:00"), (3, f"@wf_start {day}1 01:00:00"), (1, "no tag")],
        [(1, f"@wf_end {day}1 00:00:02.25"), (2, f"@wf_start {day}1 02:00:00"), (1, f"@wf_start {day}1 00:00:00.5")],
        [(1, f"@wf_end {day}1 00:00:02.25"), (4, f"@wf_end {day}2 00:00:00"), (5, None), (6, "@wf_start soon")],
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "run_id long, message string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema("run_id long, message string, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("b")
    done = runs.run_to_end(machines.run_spans(stream), "t", "append")
    log = spark.createDataFrame([r for part in parts for r in part], "run_id long, message string")
    batch = {r.run_id: r.elapsed_us for r in runlog.run_tags(log).collect()}
    assert {(r.run_id, r.ended_us - r.started_us) for r in done.rows.collect()} == {(k, v) for k, v in batch.items() if v is not None} == {
        (1, 1_750_000), (2, 3_600_000_000)}
    open_runs = machines.open_runs(spark, done.checkpoint).collect()
    assert {(r.run_id, r.started_us is None, r.ended_us is None) for r in open_runs} == {(3, False, True), (4, True, False)}


def test_transitions_once(stream_of, rows):
    stream = stream_of([event(1), event(2)], [event(3), event(61), event(4, state="failed")])
    got = runs.drain(runs.distinct_transitions(stream), "t", "append").drop("batch_id")
    assert got.count() == 3 and got.distinct().count() == 3


def test_tail(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("[29Aug2018 12:00:00|m] > a staged to run\n@tag\n")
    out = str(tmp_path / "out")
    for n in (1, 2):
        runs.tail_to(runs.log_tail(spark, str(tmp_path / "logs")), out, str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(out).where("opens").count() == n
        assert spark.read.parquet(out).where("NOT opens AND message = '@tag' AND ts IS NULL AND file LIKE '%a.log'").count() == 1
        (tmp_path / "logs" / "b.log").write_text("[29Aug2018 12:00:01|m] > a finished running\n")
    log = spark.read.parquet(out).withColumn("run_id", F.lit(1))
    assert {r["state"] for r in runlog.task_events(log).collect()} == {"running", "completed"}


@pytest.mark.parametrize("as_folder", [False, True])
def test_table_as_file_or_folder(spark, tmp_path, as_folder):
    """A folder of many files in shuffled order of time gives what the single file gives, late rows counted."""
    rows = [event(30 * i, f"t{i % 7}") for i in range(200)]
    random.Random(5).shuffle(rows)
    path = tmp_path / "events.parquet"
    if as_folder:
        for i in range(0, 200, 10):
            spark.createDataFrame(rows[i:i + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    else:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("part-*.parquet")).rename(path)
    stream = runs.parquet_stream(spark, str(tmp_path), "events", 1)
    done = runs.run_to_end(runs.run_counts(stream), "t", "update")
    counted = runs.latest(done.rows, ["window_start", "pool"]).agg(F.sum("n")).first()[0]
    assert done.n_read == 200 and counted < 200 if as_folder else counted == 200
    # two events an hour: a late window of one file is one or two of its rows
    assert done.n_late <= 200 - counted <= 2 * done.n_late
    states = runs.newest_states(runs.drain(runs.task_states(stream), "t", "update"))
    want = {t: max(r[4] for r in rows if r[1] == t) for t in {r[1] for r in rows}}
    assert {r["task"]: r["ts"] for r in states.collect()} == want


def test_no_file_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="no file"):
        runs.drain(runs.task_states(stream), "t", "update")
