"""Lineage that needs more than one step, over dependencies (run_id, task_id, depends_on).

A run is a graph of its own, and almost every run is small.  Runs of up to ``run_rows`` tasks and dependencies are therefore
brought together by run in one shuffle, sorted by run, and solved where they lie, some whole runs at a time: a task holds no more than
``AT_ONCE`` rows, or one run, and a batch.

Longer ones, the tasks without a run among them, are first made shorter by joins.  A task with one dependency follows from it alone, so
that the tasks with one dependency form trees below the others.  Each is led to the root of its tree by doubling: a pointer to what
it depends on is replaced by that one's pointer, with the lengths added, so that a tree of any depth takes as many rounds as its depth has
binary digits.  What is left are the other tasks, with edges as long as the paths they replace; of parallel ones the longest counts (or the
shortest, where the least number of hops is asked for), and tasks that thereby have one dependency are led to a root in turn.  Once a run
is short enough it is solved like the others, else by rounds of joins; the trees follow from their roots.  All ways give the same
rows.  What rounds add is written to the shared folder, which cuts the lineage, survives lost executors and tells the planner the
true sizes.  The driver sees only row counts, which are observed while writing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runloom.functions.ordered import long_groups
from runloom.session import stored

KEY = ["run_id", "task_id"]
#: Tasks and dependencies of a run that is solved in one task.
RUN_ROWS = 200_000
#: Rows of whole runs that are solved together.
AT_ONCE = 100_000
#: Rounds after which what was added is written as one table.
FOLD = 8
#: How often what is left of a long run with cycles is made shorter again.
DEEPEST = 4


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _parted(run_rows: int, *tables: DataFrame) -> tuple[DataFrame, int]:
    """The runs, null included, with more than ``run_rows`` rows in all ``tables``, and how many they are."""
    return long_groups(_stack([t.select("run_id") for t in tables]), ["run_id"], run_rows)


def _of(table: DataFrame, long: DataFrame, how: str) -> DataFrame:
    """The rows of the long runs (``left_semi``) or of all others (``left_anti``); null is a run as well."""
    names = long.select(F.col("run_id").alias("_long"))
    return table.join(names, F.col("run_id").eqNullSafe(F.col("_long")), how)


def _whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup batches that are sorted by run, so that no run spans two of them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < AT_ONCE:
            continue
        frame = pd.concat([b for b in held if len(b)], ignore_index=True)
        run, last = frame["run_id"], frame["run_id"].iloc[-1]
        start = int(np.argmax((run.isna() if pd.isna(last) else run == last).to_numpy()))
        if start:
            yield frame.iloc[:start]
        held, n = [frame.iloc[start:]], len(frame) - start
    if n:
        yield pd.concat([b for b in held if len(b)], ignore_index=True)


def _solve(
    tasks: DataFrame, edges: DataFrame, values: list[str], solve: Callable[..., dict[str, np.ndarray]],
    out: list[str], names: str | None = None, lengths: list[str] = [],
) -> DataFrame:
    """Run ``solve(values of the tasks, source rows, target rows, lengths of the edges)`` on the graphs of some runs at a time.

    ``tasks`` has ``run_id, task_id`` and long ``values``; ``edges`` has ``run_id, src, dst``, none of them null, and long ``lengths``; those
    with an end that is not among the tasks are left out.
    ``solve`` returns long columns ``out`` for all tasks; rows whose first one is negative are left out.  Tasks are numbered in
    order of run and id; ``names`` is a further column of such numbers, given back as the tasks' ids.
    """
    kind = tasks.schema["task_id"].dataType
    def nothing(columns: list[str]) -> list:
        return [F.lit(0).cast("long").alias(c) for c in columns]

    # no nulls for what a row lacks: pandas would turn ids into floating point numbers
    both = tasks.select(*KEY, F.col("task_id").alias("other"), F.lit(False).alias("link"), *values, *nothing(lengths)).unionByName(
        edges.select("run_id", F.col("src").cast(kind).alias("task_id"), F.col("dst").cast(kind).alias("other"), F.lit(True).alias("link"), *nothing(values), *lengths))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_runs(batches):
            link = frame["link"].to_numpy()
            ends, ids = pd.factorize(pd.concat([frame["task_id"], frame["other"]]), sort=True, use_na_sentinel=False)
            first = pd.factorize(frame["run_id"], use_na_sentinel=False)[0] * len(ids)
            here, there = first + ends[:len(frame)], first + ends[len(frame):]
            order = np.argsort(here[~link], kind="stable")
            place, nodes = here[~link][order], frame[~link].iloc[order]
            if (place[1:] == place[:-1]).any():
                raise ValueError("a task id repeats within a run")
            src, dst = (np.minimum(np.searchsorted(place, end[link]), max(len(place) - 1, 0)) for end in (here, there))
            known = (place[src] == here[link]) & (place[dst] == there[link]) if len(place) else np.zeros(len(src), dtype=bool)
            src, dst, links = src[known], dst[known], frame[link][known]
            found = solve(
                nodes[values].to_numpy(dtype=np.int64) if values else np.zeros((len(nodes), 0)), src, dst,
                links[lengths].to_numpy(dtype=np.int64) if lengths else np.ones((len(links), 1), dtype=np.int64))
            if names:
                found[names] = nodes["task_id"].to_numpy()[found[names]]
            result = nodes[KEY].assign(**found)
            yield result[result[out[0]] >= 0 if out else slice(None)][[*KEY, *out, *([names] if names else [])]]

    schema = StructType([
        tasks.schema["run_id"], tasks.schema["task_id"], *[StructField(c, LongType()) for c in out],
        *([StructField(names, tasks.schema["task_id"].dataType)] if names else [])])
    return both.repartition("run_id").sortWithinPartitions("run_id").mapInPandas(run, schema)


def _outgoing(src: np.ndarray, dst: np.ndarray, n: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From rows to the rows, the targets and the numbers of all links that leave them."""
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1))

    def of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = first[rows + 1] - first[rows]
        start = np.repeat(first[rows] - np.append(0, np.cumsum(size)[:-1]), size)
        at = order[start + np.arange(size.sum())]
        return np.repeat(rows, size), dst[at], at

    return of


def _peel(values: np.ndarray, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """The longest path to every task by each length of the links, 0 without any; -1 on a cycle or behind one."""
    n = len(values)
    waiting = np.bincount(dst, minlength=n)
    far = np.zeros((n, lengths.shape[1]), dtype=np.int64)
    done = np.zeros(n, dtype=bool)
    after = _outgoing(src, dst, n)
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        done[ready] = True
        source, target, link = after(ready)
        np.maximum.at(far, target, far[source] + lengths[link])
        np.subtract.at(waiting, target, 1)
        target = np.unique(target)
        ready = target[waiting[target] == 0]
    far[~done] = -1
    return {f"far{k}": far[:, k] for k in range(far.shape[1])}


def _with_all(values: np.ndarray, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """:func:`_peel` after a column that leaves no task out."""
    return {"all": np.zeros(len(values), dtype=np.int64), **_peel(values, src, dst, lengths)}


def _spread(values: np.ndarray, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """The shortest path from a task whose value is 1; -1 where none leads."""
    never = np.iinfo(np.int64).max
    hops = np.where(values[:, 0] == 1, 0, never)
    after = _outgoing(src, dst, len(values))
    now = np.flatnonzero(hops == 0)
    while len(now):
        source, target, link = after(now)
        offer = hops[source] + lengths[link, 0]
        better = offer < hops[target]
        np.minimum.at(hops, target[better], offer[better])
        now = np.unique(target[better])
    return {"hops": np.where(hops == never, -1, hops)}


def _cycles(values: np.ndarray, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """For every task the least task of its cycle (its strongly connected component), -1 if it is on none."""
    n = len(values)
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    index, low, place = [-1] * n, [0] * n, first[:n]
    on, stack, cycle, count = [False] * n, [], np.full(n, -1), 0
    for root in range(n):
        path = [root] if index[root] < 0 else []
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            if place[v] < first[v + 1]:
                w = to[place[v]]
                place[v] += 1
                if index[w] < 0:
                    path.append(w)
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                part = []
                while not part or part[-1] != v:
                    part.append(stack.pop())
                    on[part[-1]] = False
                if len(part) > 1 or v in to[first[v]:first[v + 1]]:
                    cycle[part] = min(part)
    return {"cycle": cycle}


def _merge(values: np.ndarray, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Least task of each connected part."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[src], label[dst])
        after = label.copy()
        for side in (src, dst, label[src], label[dst]):
            np.minimum.at(after, side, low)
        after = after[after]
        if np.array_equal(after, label):
            return {"component": label}
        label = after


class Forest(NamedTuple):
    """Tasks with one dependency, led to their roots: ``rooted`` has ``run_id, task_id, root, low`` and lengths; ``ringed`` are those that hang on
    a ring of such tasks, with a task of the ring as root and the least task of the ring as ``low``.  ``jumps`` are the pointers of each round."""

    rooted: DataFrame
    ringed: DataFrame
    n_ringed: int
    jumps: list[DataFrame]


def _forest(edges: DataFrame, lengths: list[str], keep: DataFrame | None = None) -> Forest:
    """The trees of the tasks with one incoming edge in ``edges`` (distinct run_id, src, dst); tasks in ``keep`` stay roots."""
    single = edges.groupBy("run_id", F.col("dst").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("src").alias("root"), *[F.min(c).alias(c) for c in lengths]).where("n = 1").drop("n")
    if keep is not None:
        single = single.join(keep.select(*KEY), KEY, "left_anti")
    now, (n,) = stored(single.withColumn("low", F.col("task_id")), "forest", F.count(F.lit(1)))
    jumps = [now]
    for _ in range(n.bit_length() + 2):
        on = now.select("run_id", F.col("task_id").alias("root"), F.col("root").alias("_root"), F.col("low").alias("_low"), *[F.col(c).alias(f"_{c}") for c in lengths])
        now, (n_open,) = stored(now.join(on, ["run_id", "root"], "left").select(
            *KEY, F.coalesce("_root", "root").alias("root"), F.least("low", "_low").alias("low"),
            *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in lengths], F.col("_root").isNotNull().alias("_open")), "forest",
            F.count_if("_open"))
        jumps.append(now)
        if not n_open:
            return Forest(now.drop("_open"), now.where("false").drop("_open"), 0, jumps)
    # after more steps than there are tasks, pointers that still move are on a ring
    inside = now.select("run_id", F.col("task_id").alias("root"))
    split = now.drop("_open")
    return Forest(split.join(inside, ["run_id", "root"], "left_anti"), split.join(inside, ["run_id", "root"], "left_semi"), n_open, jumps)


def _contract(edges: DataFrame, forest: Forest, lengths: list[str], best: Callable) -> tuple[DataFrame, list[int]]:
    """``edges`` between roots: a path through a tree is one edge of its length, of parallel ones the ``best`` by each length."""
    inner = forest.rooted.unionByName(forest.ringed)
    outer = edges.join(inner.select("run_id", F.col("task_id").alias("dst")), ["run_id", "dst"], "left_anti")
    up = inner.select("run_id", F.col("task_id").alias("src"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in lengths])
    return stored(outer.join(up, ["run_id", "src"], "left").select(
        "run_id", F.coalesce("_root", "src").alias("src"), "dst", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in lengths])
        .groupBy("run_id", "src", "dst").agg(*[best(c).alias(c) for c in lengths]), "contracted", F.count(F.lit(1)))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("run_id", F.explode(F.array("src", "dst")).alias("task_id")).distinct()


FAR = ["far0", "far1"]
LENGTHS = ["hops", "seconds"]


def _longest(nodes: DataFrame, edges: DataFrame, run_rows: int, n_edges: int | None = None) -> DataFrame:
    """The longest path to every task in long runs, by hops and by seconds: ``run_id, task_id, far0, far1``; both -1 on a cycle or behind one."""
    forest = _forest(edges, LENGTHS)
    rest, (n_rest,) = _contract(edges, forest, LENGTHS, F.max)
    # tasks on a ring wait for themselves
    rings = forest.ringed.select("run_id", F.col("root").alias("src")).distinct().select("run_id", "src", F.col("src").alias("dst"), *[F.lit(1).cast("long").alias(c) for c in LENGTHS])
    if forest.n_ringed:
        rest = stored(rest.unionByName(rings), "contracted")[0]
    roots, _ = stored(nodes.join(forest.rooted.unionByName(forest.ringed).select(*KEY), KEY, "left_anti").select(*KEY).unionByName(
        rings.select("run_id", F.col("src").alias("task_id"))), "roots")
    linked = _ends(rest)
    alone = roots.join(linked, KEY, "left_anti").select(*KEY, *[F.lit(0).cast("long").alias(c) for c in FAR])
    long, n_long = _parted(run_rows, linked, rest)
    parts = [alone]
    small = (linked, rest) if not n_long else tuple(_of(x, long, "left_anti") for x in (linked, rest))
    parts.append(_solve(*small, [], _with_all, ["all", *FAR], lengths=LENGTHS).drop("all"))
    if n_long:
        much = tuple(stored(_of(x, long, "left_semi"), "long-run")[0] for x in (linked, rest))
        # go on as long as that removes a tenth of the edges
        parts.append(_longest(*much, run_rows, n_rest) if n_edges is None or n_rest * 10 < n_edges * 9 else _longest_by_rounds(*much))
    found, _ = stored(_stack(parts), "longest")
    of_root = found.select("run_id", F.col("task_id").alias("root"), *[F.col(c).alias(f"_{c}") for c in FAR])
    below = forest.rooted.join(of_root, ["run_id", "root"]).select(
        *KEY, *[F.when(F.col(f"_{f}") < 0, -1).otherwise(F.col(f"_{f}") + F.col(c)).alias(f) for f, c in zip(FAR, LENGTHS)])
    never = forest.ringed.select(*KEY, *[F.lit(-1).cast("long").alias(c) for c in FAR])
    top = found.join(forest.ringed.select(*KEY), KEY, "left_anti") if forest.n_ringed else found
    return _stack([top, below, never])


def _longest_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    is_ready = F.count_if(F.col("waiting") == 0)
    incoming = edges.groupBy("run_id", F.col("dst").alias("task_id")).agg(F.count(F.lit(1)).alias("waiting"))
    zero = F.lit(0).cast("long")
    state, (n_ready,) = stored(
        nodes.join(incoming, KEY, "left").select(*KEY, F.coalesce("waiting", zero).alias("waiting"), *[zero.alias(c) for c in FAR]),
        "tasks", is_ready)
    done: list[DataFrame] = []
    n_rounds = 0
    while n_ready:
        ready = state.where("waiting = 0").select(*KEY, *FAR)
        done.append(ready)
        if len(done) > FOLD:
            done = [stored(_stack(done), "levels")[0]]
        freed = edges.join(ready.withColumnRenamed("task_id", "src"), ["run_id", "src"]).groupBy("run_id", F.col("dst").alias("task_id")).agg(
            F.count(F.lit(1)).alias("freed"), *[F.max(F.col(f) + F.col(c)).alias(f"_{f}") for f, c in zip(FAR, LENGTHS)])
        state, (n_ready,) = stored(
            state.where("waiting > 0").join(freed, KEY, "left").select(
                *KEY, (F.col("waiting") - F.coalesce("freed", zero)).alias("waiting"), *[F.greatest(f, F.coalesce(f"_{f}", zero)).alias(f) for f in FAR]),
            "tasks", is_ready)
        n_rounds += 1
        if n_rounds % FOLD == 0 and n_ready:
            edges, _ = stored(edges.join(state.select("run_id", F.col("task_id").alias("src")), ["run_id", "src"], "left_semi"), "edges")
    rest = state.select(*KEY, *[F.lit(-1).cast("long").alias(c) for c in FAR])
    return _stack([*done, rest])


def _known(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct dependencies of tasks on tasks, as ``run_id, src, dst``; others hold nothing up."""
    known = tasks.select("run_id", F.col("task_id").alias("src"))
    return dependencies.select("run_id", F.col("depends_on").alias("src"), F.col("task_id").alias("dst")).distinct().join(
        known, ["run_id", "src"], "left_semi").join(tasks.select("run_id", F.col("task_id").alias("dst")), ["run_id", "dst"], "left_semi")


def _links(dependencies: DataFrame) -> DataFrame:
    """Dependencies as a table of their own, for those who read them several times: finding them takes joins over all files."""
    return stored(dependencies.select(*KEY, "depends_on"), "dependencies")[0]


def _paths(nodes: DataFrame, edges: DataFrame, run_rows: int) -> DataFrame:
    """``run_id, task_id, far0, far1`` of all tasks: longest paths by ``hops`` and ``seconds`` of the edges, -1 where a cycle comes before."""
    long, n_long = _parted(run_rows, nodes, edges)
    small = (nodes, edges) if not n_long else tuple(_of(x, long, "left_anti") for x in (nodes, edges))
    solved = _solve(*small, [], _with_all, ["all", *FAR], lengths=LENGTHS).drop("all")
    if n_long:
        solved = solved.unionByName(_longest(*(stored(_of(x, long, "left_semi"), "long-run")[0] for x in (nodes, edges)), run_rows))
    return solved


def schedule(tasks: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Longest paths over the dependencies.

    Returns (levels, rest).  ``levels`` has the longest distance of each task from a source, and its earliest start and finish with
    unlimited workers (``tasks`` needs ``duration_s``).  ``rest`` are the tasks on a cycle or behind one.  A dependency on an unknown
    task does not hold anything up.
    """
    seconds = tasks.select("run_id", F.col("task_id").alias("src"), F.col("duration_s").cast("long").alias("seconds"))
    edges, _ = stored(_known(tasks, dependencies).join(seconds, ["run_id", "src"]).withColumn("hops", F.lit(1).cast("long")), "edges")
    nodes = tasks.select(*KEY, F.col("duration_s").cast("long").alias("duration_s"))
    found = _paths(nodes.select(*KEY), edges, run_rows)
    # the tasks without a run have no dependencies and start at once
    timed = nodes.withColumn("_task", F.struct(*KEY)).join(found.select(F.struct(*KEY).alias("_task"), *FAR), "_task")
    both, _ = stored(timed.select(
        *KEY, F.col("far0").alias("level"), F.col("far1").alias("start_s"), (F.col("far1") + F.col("duration_s")).alias("finish_s")), "schedule")
    return both.where("level >= 0"), both.where("level < 0").select(*KEY)


def task_levels(tasks: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    return schedule(tasks, dependencies, run_rows)[0].select(*KEY, "level")


def earliest_schedule(tasks: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    return schedule(tasks, dependencies, run_rows)[0].select(*KEY, "start_s", "finish_s")


def critical_path(tasks: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """``run_id, task_id, start_s, finish_s, latest_start_s, slack_s, makespan_s`` with unlimited workers.

    ``makespan_s`` is when the run's last task finishes; a task may start ``slack_s`` later than it could without moving that, and those with none are
    the critical path.  The backward pass runs the same longest paths from the ends: from a task to what needs it.  Tasks on a cycle or
    behind one are left out.
    """
    dependencies = _links(dependencies)
    levels, _ = schedule(tasks, dependencies, run_rows)
    levels = levels.withColumn("duration_s", F.col("finish_s") - F.col("start_s"))
    seconds = levels.select("run_id", F.col("task_id").alias("src"), F.col("duration_s").alias("seconds"))
    back = _known(levels, dependencies).select("run_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges, _ = stored(back.join(seconds, ["run_id", "src"]).withColumn("hops", F.lit(1).cast("long")), "edges")
    after = _paths(levels.select(*KEY), edges, run_rows).select(F.struct(*KEY).alias("_task"), F.col("far1").alias("after_s"))
    last = levels.groupBy(F.struct("run_id").alias("_run")).agg(F.max("finish_s").alias("makespan_s"))
    timed = levels.withColumns({"_task": F.struct(*KEY), "_run": F.struct("run_id")}).join(after, "_task").join(last, "_run")
    latest = F.col("makespan_s") - F.col("after_s") - F.col("duration_s")
    return timed.select(*KEY, "start_s", "finish_s", latest.alias("latest_start_s"), (latest - F.col("start_s")).alias("slack_s"), "makespan_s")


def _cycles_by_forest(nodes: DataFrame, edges: DataFrame, run_rows: int, depth: int = 0) -> DataFrame:
    """``run_id, task_id, cycle`` for the tasks of long runs that are on a cycle; ``cycle`` names it by one of its tasks.

    A ring of tasks with one dependency each is a cycle by itself.  All others pass through a root, and show between the roots; the
    tasks of a tree that lie on one are those above the ends of its edges, marked by the same pointers that led to the root.
    """
    forest = _forest(edges, [])
    inner = forest.rooted.unionByName(forest.ringed)
    outer = edges.join(inner.select("run_id", F.col("task_id").alias("dst")), ["run_id", "dst"], "left_anti")
    up = inner.select("run_id", F.col("task_id").alias("src"), "root")
    paths, (n_paths,) = stored(outer.join(up, ["run_id", "src"], "left").select(
        "run_id", F.coalesce("root", "src").alias("x"), F.col("src").alias("via"), F.col("dst").alias("y")), "paths", F.count(F.lit(1)))
    ring = forest.ringed.join(forest.ringed.select("run_id", F.col("root").alias("task_id")).distinct(), KEY, "left_semi").select(*KEY, F.col("low").alias("cycle"))
    if not n_paths:
        return ring
    between = paths.select("run_id", F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    ends = _ends(between)
    long, n_long = _parted(run_rows, ends, between)
    small = (ends, between) if not n_long else tuple(_of(x, long, "left_anti") for x in (ends, between))
    found = _named_cycles(*small)
    if n_long:
        much = tuple(stored(_of(x, long, "left_semi"), "long-run")[0] for x in (ends, between))
        found = found.unionByName(_cycles_by_forest(*much, run_rows, depth + 1) if depth < DEEPEST else _cycles_by_rounds(*much))
    found, _ = stored(found, "cycles")
    x = found.select("run_id", F.col("task_id").alias("x"), "cycle")
    y = found.select("run_id", F.col("task_id").alias("y"), F.col("cycle").alias("_cycle"))
    marked, _ = stored(paths.join(x, ["run_id", "x"]).join(y, ["run_id", "y"]).where("cycle = _cycle AND via <> x").select(
        "run_id", F.col("via").alias("task_id"), "cycle").distinct(), "marked")
    for jump in forest.jumps:
        above = marked.join(jump.select(*KEY, "root"), KEY).select("run_id", F.col("root").alias("task_id"), "cycle")
        marked, _ = stored(marked.unionByName(above).distinct(), "marked")
    return _stack([found, marked, ring]).distinct()


def _named_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, task_id, cycle`` of the tasks on a cycle, solved where the runs lie."""
    def solve(values: np.ndarray, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        cycle = _cycles(values, src, dst, lengths)["cycle"]
        return {"on": np.where(cycle < 0, -1, 1), "cycle": np.maximum(cycle, 0)}

    return _solve(nodes, edges, [], solve, ["on"], "cycle").drop("on")


def _cycles_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by rounds of joins: every task takes the largest task before it as its colour; those that also lead to it within their colour are
    its cycle, and the search goes on among the others."""
    loops = edges.where("src = dst").select("run_id", F.col("src").alias("task_id"), F.col("src").alias("cycle")).distinct()
    edges, (n,) = stored(edges.where("src <> dst"), "edges", F.count(F.lit(1)))
    found = [loops]
    while n:
        colour, (changed,) = stored(_ends(edges).withColumn("colour", F.col("task_id")), "colours", F.count(F.lit(1)))
        while changed:
            before = edges.join(colour.select("run_id", F.col("task_id").alias("src"), "colour"), ["run_id", "src"]).groupBy(
                "run_id", F.col("dst").alias("task_id")).agg(F.max("colour").alias("_c"))
            colour, (changed,) = stored(colour.join(before, KEY, "left").select(
                *KEY, F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("_moved")), "colours", F.count_if("_moved"))
            colour = colour.drop("_moved")
        inside, _ = stored(
            edges.join(colour.select("run_id", F.col("task_id").alias("src"), "colour"), ["run_id", "src"])
            .join(colour.select("run_id", F.col("task_id").alias("dst"), F.col("colour").alias("_c")), ["run_id", "dst"]).where("colour = _c"), "edges")
        back = inside.select("run_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("hops"))
        heads = inside.where("dst = colour").select("run_id", F.col("dst").alias("task_id")).distinct()
        part, _ = stored(_reach_by_rounds(heads, back).join(colour, KEY).select(*KEY, F.col("colour").alias("cycle")), "cycles")
        found.append(part)
        gone = part.select("run_id", F.col("task_id").alias("src"))
        # a colour without a cycle is its first task alone, which no other then leads to
        first = colour.where("task_id = colour").select("run_id", F.col("task_id").alias("src"))
        gone = gone.unionByName(first).distinct()
        edges, (n,) = stored(inside.select("run_id", "src", "dst").join(gone, ["run_id", "src"], "left_anti").join(
            gone.withColumnRenamed("src", "dst"), ["run_id", "dst"], "left_anti"), "edges", F.count(F.lit(1)))
    return _stack(found).groupBy(*KEY).agg(F.max("cycle").alias("cycle"))


def cyclic_tasks(tasks: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Tasks that could never start: ``run_id, task_id, cycle``.  ``cycle`` is the least task of the cycle that the task is on (of its
    strongly connected component, so that cycles that touch are one), null if it only lies behind one."""
    dependencies = _links(dependencies)
    stuck, _ = stored(schedule(tasks, dependencies, run_rows)[1], "stuck")
    edges, _ = stored(_known(stuck, dependencies), "edges")
    long, n_long = _parted(run_rows, stuck, edges)
    small = (stuck, edges) if not n_long else tuple(_of(x, long, "left_anti") for x in (stuck, edges))
    found = _named_cycles(*small)
    if n_long:
        found = found.unionByName(_cycles_by_forest(*(stored(_of(x, long, "left_semi"), "long-run")[0] for x in (stuck, edges)), run_rows))
    found, _ = stored(found, "cycles")
    least = found.groupBy("run_id", "cycle").agg(F.min("task_id").alias("least"))
    return stuck.join(found.join(least, ["run_id", "cycle"]).select(*KEY, F.col("least").alias("cycle")), KEY, "left")


def _reach_by_rounds(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest paths by rounds: what became nearer in one round is passed on in the next."""
    moved = F.count_if("moved")
    seen, (n,) = stored(seeds.select(*KEY, F.lit(0).cast("long").alias("hops"), F.lit(True).alias("moved")), "reached", moved)
    while n:
        offer = edges.join(seen.where("moved").select("run_id", F.col("task_id").alias("src"), F.col("hops").alias("_before")), ["run_id", "src"]).groupBy(
            "run_id", F.col("dst").alias("task_id")).agg(F.min(F.col("_before") + F.col("hops")).alias("_hops"))
        nearer = F.col("_hops").isNotNull() & (F.col("hops").isNull() | (F.col("_hops") < F.col("hops")))
        seen, (n,) = stored(seen.drop("moved").join(offer, KEY, "full").select(
            *KEY, F.when(nearer, F.col("_hops")).otherwise(F.col("hops")).alias("hops"), nearer.alias("moved")), "reached", moved)
    return seen.drop("moved")


def _nearest(seeds: DataFrame, edges: DataFrame, run_rows: int, n_edges: int | None = None) -> DataFrame:
    """The least number of hops from a seed in long runs, for all tasks that are reached.  Seeds stay roots of the trees."""
    forest = _forest(edges, ["hops"], seeds)
    rest, (n_rest,) = _contract(edges, forest, ["hops"], F.min)
    nodes, _ = stored(_ends(rest).withColumn("seed", F.lit(0).cast("long")).unionByName(seeds.select(*KEY, F.lit(1).cast("long").alias("seed"))).groupBy(
        *KEY).agg(F.max("seed").alias("seed")), "roots")
    long, n_long = _parted(run_rows, nodes, rest)
    small = (nodes, rest) if not n_long else tuple(_of(x, long, "left_anti") for x in (nodes, rest))
    found = _solve(*small, ["seed"], _spread, ["hops"], lengths=["hops"])
    if n_long:
        much, more = (stored(_of(x, long, "left_semi"), "long-run")[0] for x in (nodes.where("seed = 1").select(*KEY), rest))
        found = found.unionByName(_nearest(much, more, run_rows, n_rest) if n_edges is None or n_rest * 10 < n_edges * 9 else _reach_by_rounds(much, more))
    found, _ = stored(found, "reached")
    below = forest.rooted.join(found.select("run_id", F.col("task_id").alias("root"), F.col("hops").alias("_hops")), ["run_id", "root"])
    return found.unionByName(below.select(*KEY, (F.col("hops") + F.col("_hops")).alias("hops")))


def reach(seeds: DataFrame, edges: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Everything reachable from ``seeds`` (run_id, task_id) along ``edges`` (run_id, src, dst),
    with the least number of hops.  A task appears once, so the result is no larger than the
    table of tasks; the seeds themselves have 0 hops."""
    seeds = seeds.select(*KEY).distinct()
    edges, _ = stored(
        edges.select("run_id", "src", "dst").distinct().join(seeds.select("run_id").distinct(), "run_id", "left_semi")
        .withColumn("hops", F.lit(1).cast("long")), "edges")
    long, n_long = _parted(run_rows, seeds, edges)
    small = (seeds, edges) if not n_long else tuple(_of(x, long, "left_anti") for x in (seeds, edges))
    ends = small[1].select("run_id", F.explode(F.array("src", "dst")).alias("task_id"))
    nodes = ends.withColumn("seed", F.lit(0).cast("long")).unionByName(
        small[0].withColumn("seed", F.lit(1).cast("long"))).groupBy(*KEY).agg(F.max("seed").alias("seed"))
    found = _solve(nodes, small[1], ["seed"], _spread, ["hops"], lengths=["hops"])
    if n_long:
        found = found.unionByName(_nearest(*(stored(_of(x, long, "left_semi"), "long-run")[0] for x in (seeds, edges)), run_rows))
    return found


def upstream_closure(targets: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every task that the targets need, directly or not."""
    edges = dependencies.select("run_id", F.col("task_id").alias("src"), F.col("depends_on").alias("dst"))
    return reach(targets, edges, run_rows).where("hops > 0")


def failure_impact(failed: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every task that cannot run because some task before it failed."""
    edges = dependencies.select("run_id", F.col("depends_on").alias("src"), F.col("task_id").alias("dst"))
    return reach(failed, edges, run_rows).where("hops > 0")


def _parts_by_rounds(edges: DataFrame) -> DataFrame:
    """``run_id, task_id, part`` for all ends of ``edges`` (run_id, src, dst).

    Every node ties its larger neighbours to the least node near it, then its smaller neighbours to the least of them, until
    nothing changes: the number of rounds grows with the logarithm of the number of nodes, whatever the shape.
    """
    check = [F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("run_id", "hi", "lo"), F.lit(1 << 31)))]
    pairs = edges.where("src <> dst").select("run_id", F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    now, seen = stored(pairs, "parts", *check)
    while True:
        sides = now.select("run_id", F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select("run_id", F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sides.groupBy("run_id", "u").agg(F.min("v").alias("m")).select("run_id", "u", F.least("u", "m").alias("m"))
        large = sides.join(least, ["run_id", "u"]).where("v > u").select("run_id", F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("run_id", "hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, ["run_id", "hi"]).where("lo <> m").select("run_id", F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now, after = stored(small.unionByName(lowest.select("run_id", "hi", F.col("m").alias("lo"))).distinct(), "parts", *check)
        if after == seen:
            break
        seen = after
    return now.select("run_id", F.col("hi").alias("task_id"), F.col("lo").alias("part"))


def sub_workflows(tasks: DataFrame, dependencies: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Connected parts of each run, named by their least task id."""
    nodes = tasks.select(*KEY)
    # repeats and links of unknown tasks stay in: short runs are solved beside their tasks, which tells them apart without a join
    edges, _ = stored(dependencies.select("run_id", F.col("task_id").alias("src"), F.col("depends_on").alias("dst")).where(
        "run_id IS NOT NULL AND src <> dst"), "links")
    long, n_long = _parted(run_rows, nodes, edges)
    small = (nodes, edges) if not n_long else tuple(_of(x, long, "left_anti") for x in (nodes, edges))
    solved = _solve(*small, [], _merge, [], "component")
    if not n_long:
        return solved
    ends = [nodes.select("run_id", F.col("task_id").alias(c)) for c in ("src", "dst")]
    parts = _parts_by_rounds(
        _of(edges, long, "left_semi").join(ends[0], ["run_id", "src"], "left_semi").join(ends[1], ["run_id", "dst"], "left_semi"))
    rest = _of(nodes, long, "left_semi").join(parts, KEY, "left").select(*KEY, F.coalesce("part", "task_id").alias("component"))
    return solved.unionByName(rest)
