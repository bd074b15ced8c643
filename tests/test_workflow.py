"""Lineage on a nine-task workflow with known nodes, edges, dependents and times."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom.operators import graph, lineage

# id, seconds, inputs, outputs, waits
WORKFLOW = [
    ("petrichor_1", 2, [], ["a.out"], []),
    ("petrichor_2", 3, [], ["b.out"], []),
    ("petrichor_3", 5, [], ["c.out"], []),
    ("notos_4", 3, ["a.out", "b.out", "c.out"], ["d1.out", "d2.out"], []),
    ("sleep_5", 10, [], [], []),
    ("notos_6", 2, ["d2.out"], ["g1.out", "g2.out"], ["sleep_5"]),
    ("petrichor_7", 3, ["d1.out"], ["f.out"], []),
    ("sleep_8", 6, ["g2.out"], [], []),
    ("petrichor_9", 2, ["g1.out", "f.out"], ["i.final"], ["sleep_8"]),
]
DEPENDENTS = {
    "notos_4": {"petrichor_1", "petrichor_2", "petrichor_3"},
    "notos_6": {"notos_4", "sleep_5"},
    "petrichor_7": {"notos_4"},
    "sleep_8": {"notos_6"},
    "petrichor_9": {"notos_6", "petrichor_7", "sleep_8"},
}
TASK = "run_id long, task_id string, seq long, duration_s long"
PORT = "run_id long, task_id string, role string, path string"


def make(spark, workflow, run=1):
    tasks = [(run, name, i, secs) for i, (name, secs, *_) in enumerate(workflow, 1)]
    ports = [
        (run, name, role, path)
        for name, _, ins, outs, waits in workflow
        for role, paths in (("input", ins), ("output", outs), ("wait_on", waits)) for path in paths
    ]
    return spark.createDataFrame(tasks, TASK), spark.createDataFrame(ports, PORT)


@pytest.fixture(scope="module")
def flow(spark):
    return make(spark, WORKFLOW)


def test_nodes_and_edges(flow, rows):
    tasks, ports = flow
    nodes = rows(lineage.graph_nodes(tasks, ports), "id", "type")
    assert nodes == {(t[0], "app") for t in WORKFLOW} | {
        (f, "data") for f in ("a.out", "b.out", "c.out", "d1.out", "d2.out", "f.out", "g1.out", "g2.out", "i.final")
    }
    edges = rows(lineage.graph_edges(ports), "src", "dst")
    assert len(edges) == 19
    assert ("sleep_5", "notos_6") in edges and ("petrichor_9", "i.final") in edges
    again = ports.unionByName(ports).orderBy(F.desc("path"))
    assert rows(lineage.graph_edges(again), "src", "dst") == edges


def test_dependencies(flow, rows):
    deps = rows(lineage.task_dependencies(flow[1]), "task_id", "depends_on")
    assert deps == {(t, d) for t, needed in DEPENDENTS.items() for d in needed}


def test_ends(flow, rows):
    assert rows(lineage.initial_inputs(flow[1])) == set()
    assert rows(lineage.terminal_outputs(flow[1]), "path") == {("i.final",)}
    assert rows(lineage.fork_points(flow[1])) == set()


def test_levels_and_schedule(flow, rows):
    deps = lineage.task_dependencies(flow[1])
    assert rows(graph.earliest_schedule(flow[0], deps), "task_id", "start_s", "finish_s") == {
        ("petrichor_1", 0, 2), ("petrichor_2", 0, 3), ("petrichor_3", 0, 5), ("notos_4", 5, 8), ("sleep_5", 0, 10),
        ("notos_6", 10, 12), ("petrichor_7", 8, 11), ("sleep_8", 12, 18), ("petrichor_9", 18, 20),
    }
    levels = dict(rows(graph.task_levels(flow[0], deps), "task_id", "level"))
    assert all(levels[d] < levels[t] for t, needed in DEPENDENTS.items() for d in needed)
    assert rows(graph.cyclic_tasks(flow[0], deps)) == set()


def test_reach(flow, rows):
    tasks, deps = flow[0], lineage.task_dependencies(flow[1])
    final = tasks.where("task_id = 'petrichor_9'")
    assert len(rows(graph.upstream_closure(final, deps))) == 8
    broken = tasks.where("task_id = 'notos_4'")
    assert rows(graph.failure_impact(broken, deps), "task_id", "hops") == {
        ("notos_6", 1), ("petrichor_7", 1), ("sleep_8", 2), ("petrichor_9", 2),
    }


def test_long_chain(spark, rows):
    chain = [(f"t{i:02d}", 1, [f"f{i - 1}"] if i else [], [f"f{i}"], []) for i in range(19)]
    tasks, ports = make(spark, chain)
    deps = lineage.task_dependencies(ports)
    assert max(r[1] for r in rows(graph.reach(tasks.where("task_id = 't18'"), deps.select(
        "run_id", F.col("task_id").alias("src"), F.col("depends_on").alias("dst"))), "task_id", "hops")) == 18


def test_cycle_is_reported(spark, rows):
    looped = [*WORKFLOW[:3], ("notos_4", 3, ["a.out", "i.final"], ["d1.out", "d2.out"], []), *WORKFLOW[4:]]
    tasks, ports = make(spark, looped)
    deps = lineage.task_dependencies(ports)
    assert rows(graph.cyclic_tasks(tasks, deps), "task_id") == {
        (t,) for t in ("notos_4", "notos_6", "petrichor_7", "sleep_8", "petrichor_9")
    }
    assert rows(graph.cyclic_tasks(tasks, deps), "task_id", "cycle") == {
        (t, None if t == "never" else "notos_4") for t in ("notos_4", "notos_6", "petrichor_7", "sleep_8", "petrichor_9")}
    only = make(spark, [("x", 1, ["b"], ["a"], []), ("y", 1, ["a"], ["b"], [])])
    assert len(rows(graph.cyclic_tasks(only[0], lineage.task_dependencies(only[1])))) == 2
    assert rows(graph.task_levels(only[0], lineage.task_dependencies(only[1]))) == set()


def test_sub_workflows(spark, rows):
    first, second = make(spark, WORKFLOW), make(spark, [("p", 1, [], ["x"], []), ("q", 1, ["x"], [], []), ("r", 1, [], [], [])])
    tasks, ports = first[0].unionByName(second[0]), first[1].unionByName(second[1])
    parts = rows(graph.sub_workflows(tasks, lineage.task_dependencies(ports)), "task_id", "component")
    assert {c for t, c in parts if t in {w[0] for w in WORKFLOW}} == {"notos_4"}
    assert {("p", "p"), ("q", "p"), ("r", "r")} <= parts


def test_producers_and_waits(spark, rows):
    tasks, ports = make(spark, [("a", 1, [], ["x"], []), ("b", 1, ["x"], ["x", ""], ["ghost", "a"])])
    assert rows(lineage.producer_lookup(tasks, ports), "path", "producer", "n_producers") == {("x", "a", 2)}
    assert rows(lineage.ambiguous_producers(tasks, ports), "path") == {("x",)}
    assert rows(lineage.unresolved_waits(tasks, ports), "task_id", "waits_on") == {("b", "ghost")}
    assert ("ghost", None) in rows(lineage.graph_nodes(tasks, ports), "id", "type")
    assert "" not in {r[0] for r in rows(lineage.graph_nodes(tasks, ports), "id")}


def test_artifacts(spark, rows):
    uses = spark.createDataFrame(
        [(1, "/d", 1, None, None), (1, "/d", 2, "input", None), (1, "/d", 3, "output", False), (1, "/t", 1, "output", True),
         (1, "/t", 2, "input", None), (1, "/n", 1, None, None), (1, "", 1, "input", None), (2, "/t", 9, "output", False)],
        "run_id long, path string, seq long, mode string, tmp boolean",
    )
    catalog = lineage.artifact_catalog(uses)
    assert rows(catalog, "run_id", "path", "mode", "tmp") == {
        (1, "/d", "output", False), (1, "/t", "input", True), (1, "/n", None, None), (2, "/t", "output", False)}
    ports = spark.createDataFrame([(1, "a", "output", "/t"), (2, "a", "output", "/t")], PORT)
    assert rows(lineage.temp_artifacts(catalog, ports)) == {(1, "/t")}
    assert rows(lineage.temp_artifacts(catalog, ports, "no")) == set()


def test_order(flow, spark, rows):
    deps = lineage.task_dependencies(flow[1])
    levels = graph.task_levels(flow[0], deps)
    staged = levels.select("run_id", "task_id", (F.col("level") * 100).alias("staged_pos"))
    assert rows(lineage.order_violations(deps, staged)) == set()
    swapped = staged.withColumn("staged_pos", -F.col("staged_pos"))
    assert len(rows(lineage.order_violations(deps, swapped))) == 10
    partial = staged.where("task_id <> 'sleep_5'")
    assert rows(lineage.order_violations(deps, partial), "task_id", "depends_on") == {("notos_6", "sleep_5")}


def test_missing_outputs(flow, spark, rows):
    seen = spark.createDataFrame([(f,) for f in ("a.out", "b.out", "c.out", "d1.out", "g1.out", "g2.out", "f.out")], "path string")
    assert rows(lineage.missing_outputs(flow[1], seen), "task_id", "path") == {("notos_4", "d2.out"), ("petrichor_9", "i.final")}


def test_first_producer_counts(spark, rows):
    """Three writers and four readers of one file: four dependencies, not twelve."""
    ports = spark.createDataFrame(
        [(1, w, "output", "log") for w in ("b", "a", "c")] + [(1, r, "input", "log") for r in "wxyz"], PORT)
    assert rows(lineage.task_dependencies(ports), "task_id", "depends_on") == {(r, "a") for r in "wxyz"}
    order = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "task_id string, seq long")
    assert rows(lineage.task_dependencies(ports.join(order, "task_id", "left")), "task_id", "depends_on") == {(r, "b") for r in "wxyz"}


def chain(spark, n, seed):
    names = list(range(n))
    random.Random(seed).shuffle(names)
    tasks = spark.createDataFrame([(1, t, 1) for t in names], "run_id long, task_id long, duration_s long")
    deps = spark.createDataFrame([(1, b, a) for a, b in zip(names, names[1:])], "run_id long, task_id long, depends_on long")
    return names, tasks, deps


@pytest.fixture
def writes(monkeypatch):
    count = []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda *a: (count.append(1), real(*a))[1])
    return count


def test_rounds_of_a_shuffled_chain(spark, writes, rows):
    _, tasks, deps = chain(spark, 1000, 1)
    assert {r[1] for r in rows(graph.sub_workflows(tasks, deps, 0), "task_id", "component")} == {0}
    assert len(writes) <= 20


def test_levels_of_a_deep_run(spark, writes, rows):
    names, tasks, deps = chain(spark, 300, 2)
    assert rows(graph.task_levels(tasks, deps), "task_id", "level") == {(t, i) for i, t in enumerate(names)}
    assert len(writes) <= 3


@pytest.mark.parametrize("run_rows", [0, 6])
def test_long_runs_are_solved_alike(spark, rows, run_rows):
    """Random graphs with cycles, unknown tasks and repeats, in runs of different size."""
    rng = random.Random(3)
    tasks, deps = [], []
    for run in range(8):
        n = rng.randint(1, 12)
        tasks += [(run, t, rng.randint(0, 9)) for t in range(n)]
        deps += [(run, rng.randrange(n), rng.randrange(n + 1)) for _ in range(rng.randint(0, 2 * n))]
    tasks = spark.createDataFrame(tasks, "run_id long, task_id long, duration_s long")
    deps = spark.createDataFrame(deps, "run_id long, task_id long, depends_on long")
    seeds = tasks.where("task_id % 5 = 0")
    for find in (
        lambda k: graph.earliest_schedule(tasks, deps, k), lambda k: graph.task_levels(tasks, deps, k), lambda k: graph.cyclic_tasks(tasks, deps, k),
        lambda k: graph.failure_impact(seeds, deps, k), lambda k: graph.upstream_closure(seeds, deps, k), lambda k: graph.sub_workflows(tasks, deps, k),
    ):
        assert rows(find(run_rows)) == rows(find(10**6))


def test_many_tasks_make_a_run_long(spark, rows, monkeypatch):
    """Tasks count as dependencies do, those without a run too; what is left is solved some whole runs at a time."""
    tasks = [(None, t, 1) for t in range(300)] + [(1, t, 2) for t in range(300)] + [(r, t, 3) for r in range(2, 30) for t in range(10)]
    deps = [(1, 1, 0), (None, 1, 0)] + [(r, t + 1, t) for r in range(2, 30) for t in range(9)]
    tasks = spark.createDataFrame(tasks, "run_id long, task_id long, duration_s long")
    deps = spark.createDataFrame(deps, "run_id long, task_id long, depends_on long")
    real = graph._solve
    sizes = []
    monkeypatch.setattr(graph, "_solve", lambda *a, **k: (sizes.append(max([r["count"] for r in a[0].groupBy("run_id").count().collect()], default=0)), real(*a, **k))[1])
    for find in (
        lambda k: graph.earliest_schedule(tasks, deps, k), lambda k: graph.failure_impact(tasks, deps, k),
        lambda k: graph.upstream_closure(tasks, deps, k), lambda k: graph.sub_workflows(tasks, deps, k),
    ):
        assert rows(find(100)) == rows(find(10**6))
        assert max(sizes[:-1]) <= 100 and sizes[-1] == 300
        sizes.clear()


@pytest.mark.parametrize("seed, run_rows, deepest", [(0, 0, 0), (2, 12, 4)])
def test_long_runs_against_plain_search(spark, rows, monkeypatch, seed, run_rows, deepest):
    """Random graphs of trees, rings, diamonds and what joins them: each way to solve a long run gives the plain result."""
    rng = random.Random(seed)
    n = 40
    deps = {(rng.randrange(n), rng.randrange(n)) for _ in range(12)}
    deps |= {(t, t - 1) for t in range(1, n) if rng.random() < 0.7}
    deps |= {(a, b) for a, b in [(n, n + 1), (n + 1, n + 2), (n + 2, n), (n + 3, n + 2), (n + 4, n + 3), (n + 5, n + 5)]}
    n += 6
    length = [rng.randint(0, 9) for _ in range(n)]
    need = {t: {b for a, b in deps if a == t} for t in range(n)}
    start, level = {}, {}
    while True:
        ready = [t for t in range(n) if t not in start and need[t] <= set(start)]
        if not ready:
            break
        for t in ready:
            start[t] = max([start[d] + length[d] for d in need[t]], default=0)
            level[t] = max([level[d] + 1 for d in need[t]], default=0)
    reach = {t: set(need[t]) for t in range(n)}
    for _ in range(n):
        reach = {t: r | set().union(*[reach[x] for x in r]) if r else r for t, r in reach.items()}
    after = {}
    for t in sorted(start, key=lambda t: -level[t]):
        after[t] = max([after[x] + length[x] for x in start if t in need[x]], default=0)
    end = max([start[t] + length[t] for t in start], default=0)
    hops = {t: 0 for t in range(0, n, 11)}
    now = set(hops)
    while now:
        now = {a for a, b in deps if b in now} - set(hops)
        hops |= {t: max(hops.values()) + 1 for t in now}
    tasks = spark.createDataFrame([(1, t, length[t]) for t in range(n)], "run_id long, task_id long, duration_s long")
    table = spark.createDataFrame([(1, a, b) for a, b in deps], "run_id long, task_id long, depends_on long")
    monkeypatch.setattr(graph, "DEEPEST", deepest)
    assert rows(graph.critical_path(tasks, table, run_rows), "task_id", "start_s", "latest_start_s", "slack_s", "makespan_s") == {
        (t, start[t], end - after[t] - length[t], end - after[t] - length[t] - start[t], end) for t in start}
    assert rows(graph.cyclic_tasks(tasks, table, run_rows), "task_id", "cycle") == {
        (t, min(x for x in reach[t] if t in reach[x]) if t in reach[t] else None) for t in range(n) if t not in start}
    assert rows(graph.failure_impact(tasks.where("task_id % 11 = 0"), table, run_rows), "task_id", "hops") == {(t, h) for t, h in hops.items() if h}


def test_very_long_chain_takes_few_rounds(spark, writes):
    """300,000 tasks one after the other in one run: rounds by the digits of its length, for levels, schedule and reach."""
    n = graph.RUN_ROWS + 100_000
    tasks = spark.range(n).selectExpr("1L run_id", "id * 7919 % 300007 task_id", "1L duration_s")
    deps = spark.range(1, n).selectExpr("1L run_id", "id * 7919 % 300007 task_id", "(id - 1) * 7919 % 300007 depends_on")
    got = graph.schedule(tasks, deps)[0].selectExpr("max(level)", "sum(level)", "max(finish_s)", "count(*)").first()
    assert tuple(got) == (n - 1, n * (n - 1) // 2, n, n) and len(writes) <= 40
    writes.clear()
    got = graph.failure_impact(tasks.where("task_id = 0"), deps).selectExpr("max(hops)", "count(*)").first()
    assert tuple(got) == (n - 1, n - 1) and len(writes) <= 40


def test_critical_path_of_the_workflow(flow, rows):
    """Nine tasks of 36 s in 20 s: e, g, h and i leave no slack."""
    found = graph.critical_path(flow[0], lineage.task_dependencies(flow[1]))
    assert {r["makespan_s"] for r in found.collect()} == {20}
    order = [r["task_id"] for r in found.where("slack_s = 0").orderBy("start_s").collect()]
    assert order == ["sleep_5", "petrichor_7", "sleep_8", "petrichor_9"]


def test_whole_runs(monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 10)
    runs = [None] * 15 + [r for r in range(40) for _ in range(r % 7)] + [50] * 30
    frame = pd.DataFrame({"run_id": pd.Series(runs, dtype=object), "row": range(len(runs))})
    for size in (1, 4, 100, 1000):
        got = list(graph._whole_runs(iter([frame[:0], *(frame[a:a + size] for a in range(0, len(frame), size))])))
        assert pd.concat(got)["row"].tolist() == frame["row"].tolist()
        assert sum(g["run_id"].nunique(dropna=False) for g in got) == len(set(runs))
    assert list(graph._whole_runs(iter([frame[:0]]))) == [] and max(map(len, graph._whole_runs(iter([frame[a:a + 4] for a in range(0, len(frame), 4)])))) < 31
