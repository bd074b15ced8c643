from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runloom.functions.text import basename, memory_bytes, redirect_stream, redirect_token, stem, strip, words
from runloom.operators import manifest

TASK = "run_id long, task_id long, seq long, kind string, name string, path string, subprogram string, action string"
SOFTWARE = [("software1", "/path/to/soft1"), ("software2", "/path/to/soft2"), ("bwa_mem", "/path/to/bwa mem")]


class Tables:
    def __init__(self, spark, tasks, params=(), redirects=(), pipes=(), ports=()):
        make = spark.createDataFrame
        self.tasks = make(list(tasks), TASK)
        self.software = make(SOFTWARE, "name string, path string")
        self.params = make([(1, *p) for p in params], "run_id long, task_id long, pos long, tokens array<string>, sep string")
        self.redirects = make([(1, *r) for r in redirects], "run_id long, task_id long, pos long, stream int, dest string, is_data boolean")
        self.pipes = make([(1, *p) for p in pipes], "run_id long, task_id long, pos long, right_task_id long")
        self.ports = make(list(ports), "run_id long, task_id long, role string, path string")

    def manifest(self, **options):
        return manifest.command_manifest(
            self.tasks, self.software, self.params, self.redirects, self.pipes, self.ports, "/tmp/run", **options
        )


def program(task_id, name="software1", path=None, subprogram=None, action=None, kind="bash"):
    return (1, task_id, task_id, kind, name, path, subprogram, action)


def test_programs(spark, rows):
    t = Tables(spark, [
        program(1), program(2, "software2", subprogram="sub"), program(3, "software4", "/path/to/soft4", "four"),
        program(4, "bwa_mem"), program(5, "software5"), program(6, "func1", kind="python"), program(7, action="align"),
    ])
    assert rows(manifest.resolve_programs(t.tasks, t.software), "task_id", "program", "app_id", "label", "resolved") == {
        (1, "/path/to/soft1", "soft1_1", "/path/to/soft1", True),
        (2, "/path/to/soft2 sub", "soft2_2", "/path/to/soft2 sub", True),
        (3, "/path/to/soft4 four", "soft4_3", "/path/to/soft4 four", True),
        (4, "/path/to/bwa mem", "bwa_mem_4", "/path/to/bwa mem", True),
        (5, None, "5", None, False),
        (6, None, "func1_6", "func1_6", True),
        (7, "/path/to/soft1", "soft1_7", "align", True),
    }
    assert rows(manifest.unresolved_programs(t.tasks, t.software), "task_id") == {(5,)}


def test_parameters(spark, rows):
    t = Tables(spark, [program(1)], params=[
        (1, 1, ["one"], " "), (1, 2, ["-a", "one", "-b", "two"], " "), (1, 3, ["--one", "a"], "="), (1, 4, ["-a one -b", "two"], " "),
    ])
    cmd = "/path/to/soft1 one -a one -b two --one=a -a one -b two"
    assert rows(t.manifest(), "cmd", "logged") == {
        (cmd, f"{cmd} > /tmp/run/soft1_1.stdout 2> /tmp/run/soft1_1.stderr")
    }
    assert [r["success_on"] for r in t.manifest().collect()] == [["0"]]


@pytest.mark.parametrize("given, want", [
    ([(0, "/o", False)], ("/o", None, None, None)),
    ([(1, "/e", True)], (None, "/e", "/e", None)),
    ([(2, "/b", True)], ("/b", "/b", None, None)),
    ([(0, "/o", True), (2, "/b", True)], ("/b", "/b", "/o", None)),
    ([(2, "/b", True), (0, "/o", True)], ("/b", "/b", None, None)),
    ([(0, "/o1", True), (0, "/o2", False)], ("/o2", None, "/o1", None)),
    ([(0, "/real.out", False), (1, "/real.err", False), (0, "/x", True), (0, "/y", False), (1, "/z", False)],
     ("/real.out", "/real.err", None, None)),
])
def test_redirects(spark, rows, given, want):
    t = Tables(spark, [program(1)], redirects=[(1, i, *r) for i, r in enumerate(given, 1)])
    assert rows(manifest.redirect_resolve(t.redirects), "stdout", "stderr", "output1", "output2") == {want}


def test_pipes(spark, rows):
    t = Tables(
        spark, [program(1), program(6, "software6", "/path/to/soft6"), program(7, "software2")],
        params=[(1, 1, ["-a", "1"], " "), (6, 1, ["-b", "2"], " "), (6, 2, ["-c", "/piped.out"], " ")],
        redirects=[(1, 1, 0, "/ignored.out", False), (1, 2, 1, "/kept.err", False), (6, 1, 0, "/piped.log", False)],
        pipes=[(1, 2, 7), (1, 1, 6)], ports=[(1, 6, "input", "/piped.out")],
    )
    piped = t.manifest().where("task_id = 1")
    assert rows(piped, "cmd", "stdout", "stderr", "n_inputs") == {(
        "/path/to/soft1 -a 1 2> /kept.err | /path/to/soft6 -b 2 -c /piped.out", "/piped.log", "/tmp/run/soft6_6.stderr", 1,
    )}
    # neither the right side nor the one of the ignored second pipe ran as a task of its own
    assert rows(t.manifest(), "task_id") == {(1,)}


def test_ids_repeat_across_runs(spark, rows):
    """Task 1 of two runs: parameters, redirects, pipes and files of one run do not reach the other."""
    t = Tables(spark, [])
    make = spark.createDataFrame
    tasks = make([(r, i, i, "bash", "software1", None, None, None, ["3"], {"executor": f"pool{r}"}) for r in (1, 2) for i in (1, 2)],
                 TASK + ", success_on array<string>, meta map<string,string>")
    found = manifest.command_manifest(
        tasks, t.software, make([(1, 1, 1, ["a"], " "), (2, 1, 1, ["b"], " ")], t.params.schema),
        make([(2, 1, 1, 0, "/out", True), (1, 1, 1, 1, None, True)], t.redirects.schema), make([(1, 1, 1, 2)], t.pipes.schema),
        make([(1, 1, "input", "/i1"), (2, 1, "input", "/i2")], t.ports.schema), "/t")
    assert rows(found, "run_id", "task_id", "cmd", "stdout", "n_inputs", "n_outputs") == {
        (1, 1, "/path/to/soft1 a 2> /dev/null | /path/to/soft1", "/t/soft1_2.stdout", 1, 0),
        (2, 1, "/path/to/soft1 b", "/out", 1, 1), (2, 2, "/path/to/soft1", "/t/soft1_2.stdout", 0, 0),
    }
    assert {(r["run_id"], *r["success_on"], r["meta"]["executor"]) for r in found.collect()} == {(1, "3", "pool1"), (2, "3", "pool2")}


def test_pipe_chain(spark):
    t = Tables(spark, [program(1), program(2, "software2"), program(3, "bwa_mem")], pipes=[(2, 1, 3)])
    inner = manifest.pipe_compose(manifest.blueprints(t.tasks, t.software, t.params, t.redirects, "/tmp"), t.pipes)
    outer = manifest.pipe_compose(inner.drop("is_piped"), spark.createDataFrame([(1, 1, 1, 2)], t.pipes.schema))
    assert outer.where("task_id = 1").first()["cmd"] == "/path/to/soft1 | /path/to/soft2 | /path/to/bwa mem"


def test_redirected_data_is_an_output(spark, rows):
    t = Tables(spark, [program(1)], redirects=[(1, 1, 0, "/stdout.log", False), (1, 2, 1, "/stderr.log", True)],
               ports=[(1, 1, "input", "/i"), (1, 1, "input", "/i"), (1, 1, "output", ""), (1, 1, "wait_on", "9")])
    assert rows(manifest.task_files(t.ports, t.redirects, t.pipes)) == {
        (1, 1, "input", "/i", False), (1, 1, "output", "/stderr.log", False), (1, 1, "wait_on", "9", False)}


MARKED = "run_id long, task_id long, pos long, tokens array<string>, marks array<string>, sep string"


def marked(spark, *params):
    """Parameters of (run, task, pos, tokens, marks)."""
    return spark.createDataFrame([(*p, " ") for p in params], MARKED)


def test_files_of_parameters(spark, rows):
    """The last mark of a file holds for all that use it from there on, within its run; without any it is an output."""
    t = Tables(spark, [program(i) for i in range(1, 7)] + [(2, 1, 1, "bash", "software1", None, None, None)])
    no = "none"
    params = marked(
        spark,
        (1, 1, 1, ["-i", "/a", "/b"], [None, "input", no]), (1, 1, 2, ["/late"], [no]), (1, 1, 3, ["/late"], ["input"]),
        (1, 2, 1, ["/a", "/b", ""], [no, "output", "input"]), (1, 3, 1, ["/a"], ["output"]), (1, 4, 1, ["/a", "/b"], [no, no]),
        (1, 5, 1, ["/a", "/a"], ["output", "input"]), (1, 6, 1, ["/a"], [no]), (1, 6, 2, ["plain"], [None]), (2, 1, 1, ["/a"], [no]))
    want = {
        (1, 1, "/a", "input", False), (1, 1, "/b", "output", True), (1, 1, "/late", "input", False), (1, 2, "/a", "input", False),
        (1, 2, "/b", "output", False), (1, 3, "/a", "output", False), (1, 4, "/a", "output", False), (1, 4, "/b", "output", False),
        (1, 5, "/a", "input", False), (1, 6, "/a", "input", False), (2, 1, "/a", "output", True)}
    assert rows(manifest.file_modes(t.tasks, params)) == want
    # a file marked beside the parameters, and one that is redirected to
    other = spark.createDataFrame([(1, 3, "/b", "input"), (1, 3, "", "input"), (1, 4, "/x", "input")], "run_id long, task_id long, path string, mark string")
    found = rows(manifest.file_modes(t.tasks, params, other))
    assert found - want == {(1, 4, "/b", "input", False)} and not any(f[2] == "/x" for f in found)


def test_manifest_counts_derived_files(spark, rows):
    t = Tables(spark, [program(1), program(2)], redirects=[(1, 1, 0, "/o", True), (1, 2, 1, "/e", False), (1, 3, 0, "/x", True), (2, 1, 2, "/b", True), (2, 2, 0, "/c", True)],
               pipes=[], ports=[(1, 1, "input", "/extra"), (1, 1, "output", "/b")])
    t.params = marked(spark, (1, 1, 1, ["-a", "/a", "/b"], [None, "input", "none"]), (1, 2, 1, ["/a"], ["none"]))
    assert rows(t.manifest(), "task_id", "n_inputs", "n_outputs", "n_defaulted", "n_ignored") == {(1, 2, 2, 0, 1), (2, 1, 0, 0, 1)}
    assert rows(t.manifest(both_is_output=True), "task_id", "n_outputs") == {(1, 2), (2, 1)}
    assert rows(t.manifest().where("task_id = 1"), "cmd") == {("/path/to/soft1 -a /a /b",)}
    files = manifest.command_files(t.tasks, t.params, t.redirects, t.pipes, t.ports)
    assert rows(files.where("task_id = 1")) == {
        (1, 1, "input", "/extra", False), (1, 1, "input", "/a", False), (1, 1, "output", "/b", False), (1, 1, "output", "/o", False)}


def test_file_used_by_every_task(spark):
    """One file in all tasks of a run, marked once in a thousand."""
    n = 25_000
    tasks = spark.range(1, n + 1).selectExpr("1L run_id", "id task_id", "id seq")
    params = tasks.selectExpr(
        "run_id", "task_id", "1L pos", "array('/hot') tokens",
        "array(CASE WHEN seq % 1000 = 0 THEN CASE WHEN seq % 2000 = 0 THEN 'output' ELSE 'input' END ELSE 'none' END) marks", "' ' sep")
    got = manifest.file_modes(tasks, params).groupBy("role", "mode_defaulted").count().collect()
    assert {(r.role, r.mode_defaulted): r["count"] for r in got} == plain_modes(n)


def plain_modes(n):
    from collections import Counter
    mode, found = None, Counter()
    for seq in range(1, n + 1):
        if seq % 1000 == 0:
            mode = "output" if seq % 2000 == 0 else "input"
        found[mode or "output", mode is None] += 1
    return dict(found)


def test_redirects_by_token(spark, rows):
    given = spark.createDataFrame([(1, 1, 1, "2>", "/e", True), (1, 1, 2, ">", "/o", True), (1, 2, 1, "&>", "/b", True), (1, 2, 2, ">", "/x", True)],
                                  "run_id long, task_id long, pos long, stream string, dest string, is_data boolean")
    assert rows(manifest.redirect_resolve(given), "task_id", "stdout", "stderr", "output1", "n_ignored") == {(1, "/o", "/e", "/e", 0), (2, "/b", "/b", None, 1)}
    assert rows(manifest.redirect_resolve(given, True), "task_id", "output1", "output2") == {(1, "/e", "/o"), (2, "/b", None)}


def test_text_functions(spark):
    row = spark.range(1).select(
        strip(F.lit("\t  a b\x1f\n")), words(F.lit(" a \t b\n")), words(F.lit(" ")), basename(F.lit("/x/y.z")),
        stem(F.lit("/p/star.2.py")), stem(F.lit(".bashrc")), stem(F.lit("a..b")), memory_bytes(F.lit("2G")),
        memory_bytes(F.lit("2K")), redirect_stream(F.lit(" &> ")), redirect_token(F.lit(0)),
    ).first()
    assert tuple(row) == ("a b", ["a", "b"], [], "y.z", "star.2", ".bashrc", "a.", 2 << 30, None, 2, "1>")
