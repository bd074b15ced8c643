"""Lineage over ``task`` (run_id, task_id, seq, ...) and ``port`` (run_id, task_id, role, path).

``role`` is 'input', 'output' or 'wait_on'; the path of a wait is the id of the other task.
An empty path stands for no file and is dropped.  Joins are equi joins on (run_id, path) or
(run_id, task_id); duplicates are removed before a join wherever the result allows, so that a
file read by very many tasks does not travel.  AQE splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _role(ports: DataFrame, role: str) -> DataFrame:
    return ports.where((F.col("role") == role) & (F.col("path") != ""))


def graph_nodes(tasks: DataFrame, ports: DataFrame) -> DataFrame:
    """Tasks and files of each run; a name is one node however often it is used.

    A wait on a task nobody registered leaves a node without a type.
    """
    # Numbers, because an aggregate over strings would be sorted instead of hashed.
    apps = tasks.select("run_id", F.col("task_id").cast("string").alias("id"), F.lit(1).alias("code"))
    kind = F.when(F.col("role") == "wait_on", 0).otherwise(2)
    files = ports.where("path <> ''").select("run_id", F.col("path").alias("id"), kind.alias("code"))
    merged = apps.unionByName(files).groupBy("run_id", "id").agg(F.max("code").alias("code"))
    return merged.select(
        "run_id", "id", F.when(F.col("code") == 2, "data").when(F.col("code") == 1, "app").alias("type")
    )


def graph_edges(ports: DataFrame) -> DataFrame:
    """input -> task, task -> output, waited-on task -> task; repeated edges collapse."""
    task = F.col("task_id").cast("string")
    outward = F.col("role") == "output"
    return ports.where("path <> ''").select(
        "run_id",
        F.when(outward, task).otherwise(F.col("path")).alias("src"),
        F.when(outward, F.col("path")).otherwise(task).alias("dst"),
    ).distinct()


def graph_export(tasks: DataFrame, ports: DataFrame) -> DataFrame:
    """Nodes and edges as JSON rows.  ``id`` is the base name, as in a drawing; ``path`` keeps
    the full name because base names collide."""
    def base(column: str):
        return F.substring_index(column, "/", -1)

    nodes = graph_nodes(tasks, ports).select(
        "run_id", F.lit("node").alias("element"),
        F.to_json(F.struct(
            base("id").alias("id"), F.col("id").alias("path"), "type",
            (F.coalesce("type", F.lit("")) == "app").alias("haveblueprint"),
        )).alias("json"),
    )
    edges = graph_edges(ports).select(
        "run_id", F.lit("edge").alias("element"),
        F.to_json(F.struct(
            base("src").alias("source"), base("dst").alias("target"),
            F.col("src").alias("source_path"), F.col("dst").alias("target_path"),
        )).alias("json"),
    )
    return nodes.unionByName(edges)


def task_dependencies(ports: DataFrame) -> DataFrame:
    """Task B depends on A if A is the first to write a file that B reads, or B waits on A.

    Only the first producer of a file counts (by ``seq`` if the ports carry it, else by task_id): see
    :func:`producer_lookup` for the others.
    """
    first = "seq" if "seq" in ports.columns else "task_id"
    made = _role(ports, "output").groupBy("run_id", "path").agg(F.min_by("task_id", first).alias("depends_on"))
    read = _role(ports, "input").select("run_id", "path", "task_id")
    by_file = read.join(made.hint("shuffle_hash"), ["run_id", "path"]).select("run_id", "task_id", "depends_on")
    by_wait = _role(ports, "wait_on").select(
        "run_id", "task_id", F.col("path").cast(ports.schema["task_id"].dataType).alias("depends_on")
    )
    return by_file.unionByName(by_wait).distinct()


def producer_lookup(tasks: DataFrame, ports: DataFrame) -> DataFrame:
    """The producer of a file is the task registered first; ``n_producers`` tells of others."""
    seq = tasks.select("run_id", "task_id", "seq")
    made = _role(ports, "output").select("run_id", "task_id", "path").join(seq, ["run_id", "task_id"])
    return made.groupBy("run_id", "path").agg(
        F.min_by("task_id", F.struct("seq", "task_id")).alias("producer"),
        F.count(F.lit(1)).alias("n_producers"),
    )


def ambiguous_producers(tasks: DataFrame, ports: DataFrame) -> DataFrame:
    return producer_lookup(tasks, ports).where("n_producers > 1")


def initial_inputs(ports: DataFrame) -> DataFrame:
    """Files that are read but made by no task of the run: they must exist beforehand."""
    read = _role(ports, "input").select("run_id", "path").distinct()
    made = _role(ports, "output").select("run_id", "path").distinct()
    return read.join(made, ["run_id", "path"], "left_anti")


def terminal_outputs(ports: DataFrame) -> DataFrame:
    """Files that are made and read by no task of the run."""
    made = _role(ports, "output").select("run_id", "path").distinct()
    read = _role(ports, "input").select("run_id", "path").distinct()
    return made.join(read, ["run_id", "path"], "left_anti")


def unresolved_waits(tasks: DataFrame, ports: DataFrame) -> DataFrame:
    """Waits on a task that was never registered."""
    waits = _role(ports, "wait_on").select("run_id", "task_id", F.col("path").alias("waits_on"))
    known = tasks.select("run_id", F.col("task_id").cast("string").alias("waits_on"))
    return waits.join(known, ["run_id", "waits_on"], "left_anti").distinct()


def missing_outputs(ports: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared outputs that are absent after the run."""
    declared = _role(ports, "output").select("run_id", "task_id", "path").distinct()
    return declared.join(manifest.select("path"), "path", "left_anti").select("run_id", "task_id", "path")


def artifact_catalog(uses: DataFrame) -> DataFrame:
    """One row per run and path from its uses (run_id, path, seq, mode, tmp) in order.

    The last use that names a mode decides it; only a use as output decides ``tmp``, so a
    later use as input keeps it.
    """
    named = uses.where("path <> ''")
    return named.groupBy("run_id", "path").agg(
        F.max_by("mode", F.when(F.col("mode").isNotNull(), F.col("seq"))).alias("mode"),
        F.max_by("tmp", F.when(F.col("mode") == "output", F.col("seq"))).alias("tmp"),
        F.count(F.lit(1)).alias("n_uses"),
    )


def temp_artifacts(catalog: DataFrame, ports: DataFrame, delete_setting: str = "yes") -> DataFrame:
    """Temporary files that some task of the run makes: the purge list, empty unless the setting is 'yes'."""
    made = _role(ports, "output").select("run_id", "path").distinct()
    return (
        catalog.where(F.col("tmp") & (F.lit(delete_setting) == "yes"))
        .select("run_id", "path")
        .join(made, ["run_id", "path"], "left_semi")
    )


def node_degrees(ports: DataFrame) -> DataFrame:
    """Edges into and out of every node; each edge is counted at both of its ends."""
    ends = graph_edges(ports).select(
        "run_id",
        F.explode(F.array(
            F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        )).alias("end"),
    )
    return ends.groupBy("run_id", F.col("end.id").alias("id")).agg(
        F.sum("end.i").alias("in_degree"), F.sum("end.o").alias("out_degree")
    )


def fork_points(ports: DataFrame, at_least: int = 2) -> DataFrame:
    """Files read by several tasks of a run: the points where the run fans out."""
    readers = _role(ports, "input").select("run_id", "path", "task_id").distinct()
    return readers.groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n_readers")).where(
        F.col("n_readers") >= at_least
    )


def order_violations(dependencies: DataFrame, staged: DataFrame) -> DataFrame:
    """Dependencies that were not staged before their dependent task."""
    own = staged.select("run_id", "task_id", F.col("staged_pos").alias("pos"))
    other = staged.select("run_id", F.col("task_id").alias("depends_on"), F.col("staged_pos").alias("dep_pos"))
    return (
        dependencies.join(own, ["run_id", "task_id"])
        .join(other, ["run_id", "depends_on"], "left")
        .where("dep_pos IS NULL OR dep_pos >= pos")
        .select("run_id", "task_id", "depends_on", "pos", "dep_pos")
    )
