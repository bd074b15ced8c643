from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runloom.operators import runlog
from runloom.sources import sinks, text

LOG = """[29Aug2018 12:00:00|wf.main] > Executing: tool run align --x 1
[29Aug2018 12:00:00|wf.main] > Who and where: ann@node7:/data/run:1
[29Aug2018 12:00:01|wf.main] > star_1 assigned to executor small, task id 0
[29Aug2018 12:00:02|wf.main] > Started run
@start 2018-08-29 12:00:02.5
[29Aug2018 12:00:03|wf.main] > star_1 staged to run
[29Aug2018 12:00:03|wf.main] > Staged or running: star_1
[29Aug2018 12:00:09|wf.main] > star_1 did not produce expected outputs
trace > with an arrow

[30Aug2018 12:00:10|wf.main] > Finished run
"""


def test_log_scan(spark, tmp_path):
    (tmp_path / "nightly_run_29Aug2018_120000.wf.log").write_text(LOG)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        scanned = text.log_scan(spark, str(tmp_path)).orderBy("block", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["opens"] for r in scanned] == [True] * 4 + [False] + [True] * 3 + [False, False, True]
    assert scanned[4]["ts"] == datetime(2018, 8, 29, 12, 0, 2) and scanned[4]["message"].startswith("@start")
    assert scanned[9]["ts"] == datetime(2018, 8, 29, 12, 0, 9) and scanned[9]["message"] == ""
    assert {r["logger"] for r in scanned} == {"wf.main"}


def log_of(spark, text_, run=1):
    lines = spark.createDataFrame([(run, i, line) for i, line in enumerate(text_.splitlines())], "run_id long, line_no long, line string")
    return lines.withColumn("p", runlog.parse_line(F.col("line"))).select("run_id", "line_no", F.col("p.ts").alias("ts"), F.col("p.message").alias("message"))


def test_provenance(spark, rows):
    assert rows(runlog.run_provenance(log_of(spark, LOG))) == {(1, "run align --x 1", "ann", "node7", "/data/run:1", "run")}
    named = log_of(spark, "[29Aug2018 12:00:00|m] > Run name: night shift")
    assert rows(runlog.run_provenance(named), "run_name") == {("night shift",)}


def test_tags(spark, rows):
    lines = spark.createDataFrame(
        [(1, 0, None, "@wf_start 2024-01-01 00:00:00.5"), (1, 1, None, "@wf_end 2024-01-02 00:00:01.25"), (2, 0, None, "@wf_start 2024-01-01 00:00:00"),
         (3, 0, None, "no @wf_start 2024-01-01 00:00:00")], "run_id long, line_no long, ts timestamp_ntz, message string")
    assert rows(runlog.run_tags(lines), "run_id", "elapsed_us") == {(1, 86_400_750_000), (2, None), (3, None)}


def test_file_identity(spark):
    row = spark.range(1).select(runlog.log_file_identity(F.lit("my_run_2_29Aug2018_120001.wf.log")).alias("f")).first()["f"]
    assert (row["run_name"], row["started"]) == ("my_run_2", datetime(2018, 8, 29, 12, 0, 1))
    assert runlog.last_part  # text after the last arrow
    assert spark.range(1).select(runlog.last_part(F.lit("[x|y] > a > b "))).first()[0] == "b"


def test_phrases(spark, rows):
    said = [
        ("a assigned to executor small, task id 1", "pending", None), ("b staged to run", "running", None),
        ("c finished running", "completed", None), ("d failed during execution", "failed", "app failure"),
        ("e had a dependency fail", "failed", "dependency failed"), ("f did not produce expected outputs", "failed", "missing outputs"),
        ("g produced a general Flow error", "failed", "general"), ("h produced a general error", "failed", "other"),
        ("i produced a RemoteError", "failed", "remote"), ("User aborted run", "failed", "aborted"),
    ]
    lines = "\n".join(f"[29Aug2018 12:00:00|m] > {s}" for s, *_ in said) + "\n[29Aug2018 12:00:00|m] > Staged or running: a b"
    assert rows(runlog.task_events(log_of(spark, lines)), "message", "state", "failure") == set(said)


def test_final_state(spark, rows):
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, "a", at.replace(hour=2), "completed"), (1, "a", at.replace(hour=1), "failed"), (1, "b", at, "running"),
         (1, "b", at, "failed"), (1, "b", at, "completed")], "run_id long, task string, ts timestamp_ntz, state string")
    tasks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "run_id long, task string")
    assert rows(runlog.task_state_final(events, tasks), "task", "state") == {("a", "completed"), ("b", "failed"), ("c", "pending")}


def test_summary_counts_tasks_once(spark, rows):
    said = "a staged to run\na failed during execution\na failed during execution\nb staged to run\nUser aborted run"
    log = log_of(spark, "\n".join(f"[29Aug2018 12:00:0{i}|m] > {s}" for i, s in enumerate(said.splitlines())))
    got = rows(runlog.run_summary(runlog.task_events(log)), "n_records", "n_tasks", "n_failed", "n_running", "n_completed", "elapsed_s")
    assert got == {(5, 2, 1, 1, 0, 4)}


def attempts(spark, spans):
    rows = [(1, i, datetime(2024, 1, 1 + a // 86400, a % 86400 // 3600, a % 3600 // 60, a % 60),
             datetime(2024, 1, 1 + b // 86400, b % 86400 // 3600, b % 3600 // 60, b % 60)) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "run_id long, task_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")


def test_concurrency(spark, rows):
    """The nine-task workflow runs at most four tasks at once; ends free their place first."""
    spans = [(0, 2), (0, 3), (0, 5), (5, 8), (0, 10), (10, 12), (8, 11), (12, 18), (18, 20)]
    got = rows(runlog.running_concurrency(attempts(spark, spans)))
    assert got == {(1, 4, datetime(2024, 1, 1))}


def test_elapsed_beyond_a_day(spark, rows):
    assert rows(runlog.run_elapsed(attempts(spark, [(0, 60), (100, 86400 + 30)]))) == {(1, 86430, 30)}


def test_set_change(spark, rows):
    """A task is seen at two polls at least, however short it is."""
    day = 1704067200.0
    got = rows(runlog.running_set_change(attempts(spark, [(0, 100), (5, 9), (61, 130)]), 10), "task_id", "poll_s", "change")
    assert got == {(0, day, "entered"), (0, day + 100, "left"), (1, day + 10, "entered"), (1, day + 20, "left"), (2, day + 70, "entered"), (2, day + 130, "left")}
    fine = rows(runlog.running_set_change(attempts(spark, [(1, 1)]), 0.25), "poll_s", "change")
    assert fine == {(day + 1, "entered"), (day + 1.25, "left")}


def test_failure_lists(spark, rows):
    tasks = spark.createDataFrame(
        [(1, i, f"t{i}", "failed" if i % 2 else "completed") for i in range(1, 8)] + [(2, 1, "x", "pending")],
        "run_id long, seq long, name string, state string")
    assert rows(runlog.failure_lists(tasks)) == {
        (1, "failed", 1, "t1"), (1, "failed", 2, "t3"), (1, "failed", 3, "t5"), (1, "failed", 4, "t7"), (1, "pending", 0, "None"),
        (2, "failed", 0, "None"), (2, "pending", 1, "x"),
    }


def test_metric(spark, rows):
    captures = spark.createDataFrame([(1, "9 + 0 in total\n7 + 0 mapped (70%)"), (2, "nothing")], "task_id long, content string")
    assert rows(runlog.text_metric(captures)) == {(1, 3.5), (2, None)}


def test_captures(spark, tmp_path, rows):
    for name, content in (("star_1.stdout", "a\nb"), ("star_1.stderr", ""), ("v1.2_2.stderr", "c")):
        (tmp_path / name).write_text(content)
    assert rows(text.capture_scan(spark, str(tmp_path))) == {("star_1", "stdout", "a\nb", True), ("v1.2_2", "stderr", "c", True)}


def test_sinks(spark, tmp_path, rows):
    log = log_of(spark, LOG).where("ts IS NOT NULL").withColumn("run_name", F.lit("r 1"))
    sinks.log_sink(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).groupBy("run_name", F.col("run_date").cast("string")).count()
    assert {tuple(r) for r in back.collect()} == {("r 1", "2018-08-29", 7), ("r 1", "2018-08-30", 1)}
    sinks.graph_sink(spark.createDataFrame([(1, "node", '{"id":"a"}')], "run_id long, element string, json string"), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).first()["value"] == '{"id":"a"}'


def test_manifest_scan(spark, tmp_path, rows):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.out").write_bytes(b"123")
    (tmp_path / "y.tmp").write_bytes(b"")
    found = text.manifest_scan(spark, str(tmp_path), "*.out")
    assert [r["length"] for r in found.collect()] == [3]
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


@pytest.mark.parametrize("cell_s", [1, 7, 600])
def test_tasks_running_at_an_instant(spark, rows, cell_s):
    """Short, long, empty and equal spans, before 1970 too, at their ends and between; a task of ten years has few rows."""
    rng = random.Random(cell_s)
    start = datetime(1969, 12, 31, 23, 50)
    spans = []
    for i in range(60):
        a = start + timedelta(microseconds=rng.randrange(0, 1_500_000_000))
        spans.append((rng.choice([1, 2]), i, a, a + timedelta(microseconds=rng.choice([0, 1, 999_999, 7_000_000, 600_000_000, 1_234_567_890]))))
    spans += [(1, 100, start, start + timedelta(days=3652)), (2, 101, start, start + timedelta(seconds=1200)), (2, 102, start, start + timedelta(seconds=1200))]
    instants = {(r, x) for r, _, a, b in spans for x in (a, b, a + (b - a) / 2)} | {(1, start - timedelta(days=1)), (3, start)}
    attempts = spark.createDataFrame(spans, "run_id long, task_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    index = runlog.running_index(attempts, cell_s)
    asked = spark.createDataFrame([*instants, (1, start)], "run_id long, at timestamp_ntz")
    assert rows(runlog.running_at(asked, index, cell_s)) == {
        (r, x, t) for r, x in instants | {(1, start)} for run, t, a, b in spans if run == r and a <= x < b}
    assert index.where("task_id = 100").count() <= 2 * runlog.CELL_LEVELS + 2
