"""Every registered query with the SQL it is checked against.

A query is a function of :class:`~runloom.plans.views.Views`.  Lists are joined to text and
counts are 64-bit, so that rows compare equal in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import accepted_exit
from runloom.operators import config, graph, lineage, manifest, matrix, pools, runlog, steps
from runloom.plans.oracle import using
from runloom.plans.views import Views
from runloom.session import scratch_path, stored
from runloom.sources import sinks, text
from runloom.streaming import machines, runs

Query = Callable[[Views], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        CATALOG[build.__name__] = (build, sql)
        return build

    return register


# --- lineage ------------------------------------------------------------------------------


@query(using("wf_node", "SELECT run_id, id, type FROM wf_node"))
def graph_nodes(v: Views) -> DataFrame:
    return lineage.graph_nodes(v.task_rows(), v.port())


@query(using("wf_edge", "SELECT run_id, src, dst FROM wf_edge"))
def graph_edges(v: Views) -> DataFrame:
    return lineage.graph_edges(v.port())


@query(using("wf_node wf_edge", """
SELECT run_id, 'node' AS element, CAST(to_json({id: regexp_extract(id, '[^/]*$'), path: id, type: type, haveblueprint: type = 'app'}) AS VARCHAR) AS json FROM wf_node
UNION ALL SELECT run_id, 'edge', CAST(to_json({source: regexp_extract(src, '[^/]*$'), target: regexp_extract(dst, '[^/]*$'), source_path: src, target_path: dst}) AS VARCHAR) FROM wf_edge"""))
def graph_export(v: Views) -> DataFrame:
    return lineage.graph_export(v.task_rows(), v.port())


@query(using("wf_dep", "SELECT run_id, task_id, depends_on FROM wf_dep"))
def task_dependencies(v: Views) -> DataFrame:
    return lineage.task_dependencies(v.port())


@query(using("wf_task wf_port", """
SELECT p.run_id, path, min_by(p.task_id, seq) AS producer, count(*) AS n_producers
FROM wf_port p JOIN wf_task t ON p.task_id = t.task_id WHERE role = 'output' GROUP BY p.run_id, path"""))
def producer_lookup(v: Views) -> DataFrame:
    return lineage.producer_lookup(v.task(), v.port())


SHARED_LOG = """
wf_log_port AS (SELECT o_custkey AS run_id, task_id, dest AS path, seq FROM wf_token
  JOIN (SELECT task_id AS id, seq FROM wf_task) t ON t.id = task_id JOIN orders ON o_orderkey = task_id WHERE is_data)"""


@query(using("wf_token wf_task", f"SELECT * FROM (WITH {SHARED_LOG} " + """
SELECT run_id, path, min_by(task_id, seq) AS producer, count(*) AS n_producers
FROM (SELECT DISTINCT * FROM wf_log_port) GROUP BY run_id, path HAVING count(*) > 1)"""))
def ambiguous_producers(v: Views) -> DataFrame:
    """Log files that several tasks of one run write."""
    written = v.redirect().where("is_data").select("run_id", "task_id", F.col("dest").alias("path")).distinct()
    return lineage.ambiguous_producers(v.task(), written.withColumn("role", F.lit("output")))


@query(using("wf_port", """
SELECT DISTINCT run_id, path FROM wf_port i WHERE role = 'input'
AND NOT EXISTS (SELECT 1 FROM wf_port o WHERE o.role = 'output' AND o.run_id = i.run_id AND o.path = i.path)"""))
def initial_inputs(v: Views) -> DataFrame:
    return lineage.initial_inputs(v.port())


@query(using("wf_port", """
SELECT DISTINCT run_id, path FROM wf_port o WHERE role = 'output'
AND NOT EXISTS (SELECT 1 FROM wf_port i WHERE i.role = 'input' AND o.run_id = i.run_id AND o.path = i.path)"""))
def terminal_outputs(v: Views) -> DataFrame:
    return lineage.terminal_outputs(v.port())


@query(using("wf_task wf_port", """
SELECT DISTINCT p.run_id, p.task_id, p.path AS waits_on FROM wf_port p
WHERE role = 'wait_on' AND NOT EXISTS (SELECT 1 FROM wf_task t WHERE t.run_id = p.run_id AND CAST(t.task_id AS STRING) = p.path
  AND t.state <> 'pending')"""))
def unresolved_waits(v: Views) -> DataFrame:
    """Waits on tasks that never got as far as being registered (the pending ones)."""
    return lineage.unresolved_waits(v.task_rows().where("state <> 'pending'"), v.port())


@query(using("wf_port wf_manifest", """
SELECT run_id, task_id, path FROM wf_port WHERE role = 'output' AND path NOT IN (SELECT path FROM wf_manifest)"""))
def missing_outputs(v: Views) -> DataFrame:
    return lineage.missing_outputs(v.port(), v.manifest())


@query(using("wf_port wf_task", """
SELECT p.run_id, path, max_by(role, {s: seq, t: p.task_id, r: role}) AS mode,
  max_by(tmp_output, {s: seq, t: p.task_id}) FILTER (WHERE role = 'output') AS tmp, count(*) AS n_uses
FROM wf_port p JOIN wf_task t ON p.task_id = t.task_id WHERE role <> 'wait_on' GROUP BY p.run_id, path"""))
def artifact_catalog(v: Views) -> DataFrame:
    return lineage.artifact_catalog(v.artifact_use())


@query(using("wf_port wf_task wf_setting_change", """
SELECT DISTINCT p.run_id, path FROM wf_port p JOIN wf_task t ON p.task_id = t.task_id WHERE role = 'output' AND tmp_output
AND coalesce((SELECT max_by(setting_value, change_id) FROM wf_setting_change
  WHERE setting_key = 'delete_temporary_files' AND setting_value IN ('yes', 'no')), 'yes') = 'yes'"""))
def temp_artifacts(v: Views) -> DataFrame:
    """What is to be deleted under the setting in force."""
    delete = config.setting_value(v.setting_change(), "delete_temporary_files")
    return lineage.temp_artifacts(lineage.artifact_catalog(v.artifact_use()), v.port(), delete)


@query(using("wf_edge", """
SELECT run_id, id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT run_id, dst AS id, 1 AS i, 0 AS o FROM wf_edge UNION ALL SELECT run_id, src, 0, 1 FROM wf_edge) GROUP BY run_id, id"""))
def node_degrees(v: Views) -> DataFrame:
    return lineage.node_degrees(v.port())


@query(using("wf_port", """
SELECT run_id, path, count(DISTINCT task_id) AS n_readers FROM wf_port WHERE role = 'input'
GROUP BY run_id, path HAVING count(DISTINCT task_id) >= 2"""))
def fork_points(v: Views) -> DataFrame:
    return lineage.fork_points(v.port())


@query(using("wf_dep wf_staged", """
SELECT d.run_id, d.task_id, d.depends_on, a.staged_pos AS pos, b.staged_pos AS dep_pos FROM wf_dep d
JOIN wf_staged a ON a.run_id = d.run_id AND a.task_id = d.task_id
LEFT JOIN wf_staged b ON b.run_id = d.run_id AND b.task_id = d.depends_on
WHERE b.staged_pos IS NULL OR b.staged_pos >= a.staged_pos"""))
def order_violations(v: Views) -> DataFrame:
    staged = v.staged()  # first, because the ports then take the places of tasks from it
    return lineage.order_violations(lineage.task_dependencies(v.port()), staged)


@query(using("wf_dep", """
SELECT run_id, task_id, count(*) AS n_dependencies FROM wf_dep GROUP BY run_id, task_id"""))
def dependency_counts(v: Views) -> DataFrame:
    return lineage.task_dependencies(v.port()).groupBy("run_id", "task_id").agg(
        F.count(F.lit(1)).alias("n_dependencies")
    )


# --- iterative lineage --------------------------------------------------------------------

LEVELS = """
wf_level AS (SELECT run_id, task_id, CAST(0 AS BIGINT) AS level FROM wf_task
  WHERE task_id NOT IN (SELECT task_id FROM wf_dep)
  UNION SELECT d.run_id, d.task_id, l.level + 1 FROM wf_dep d JOIN wf_level l ON d.run_id = l.run_id AND d.depends_on = l.task_id)"""


@query(using("wf_task wf_dep", "SELECT run_id, task_id, max(level) AS level FROM wf_level GROUP BY run_id, task_id", LEVELS))
def task_levels(v: Views) -> DataFrame:
    return graph.task_levels(v.task_rows(), lineage.task_dependencies(v.port()))


@query(using("wf_dep", """
SELECT b.run_id, b.a AS task_id, c.cycle FROM (SELECT DISTINCT x.run_id, x.a FROM wf_behind x JOIN wf_behind y ON y.run_id = x.run_id AND y.a = x.b AND y.b = x.b) b
LEFT JOIN (SELECT x.run_id, x.a, min(x.b) AS cycle FROM wf_behind x JOIN wf_behind y ON y.run_id = x.run_id AND y.a = x.b AND y.b = x.a GROUP BY x.run_id, x.a) c
  ON c.run_id = b.run_id AND c.a = b.a""", """
wf_looped AS (SELECT run_id, task_id, depends_on FROM wf_dep
  UNION SELECT run_id, depends_on, task_id FROM wf_dep WHERE run_id % 7 = 0 AND task_id % 5 = 0),
wf_behind AS (SELECT run_id, task_id AS a, depends_on AS b FROM wf_looped
  UNION SELECT x.run_id, x.a, d.depends_on FROM wf_behind x JOIN wf_looped d ON d.run_id = x.run_id AND d.task_id = x.b)"""))
def cyclic_tasks(v: Views) -> DataFrame:
    """In every seventh run some dependencies hold both ways."""
    deps, _ = stored(lineage.task_dependencies(v.port()), "dependencies")
    back = deps.where("run_id % 7 = 0 AND task_id % 5 = 0").select(
        "run_id", F.col("depends_on").alias("task_id"), F.col("task_id").alias("depends_on"))
    return graph.cyclic_tasks(v.task_rows(), deps.unionByName(back))


@query(using("wf_task wf_dep", """
SELECT s.run_id, s.task_id, s.start_s, s.start_s + t.duration_s AS finish_s, m.makespan_s - e.after_s - t.duration_s AS latest_start_s,
  m.makespan_s - e.after_s - t.duration_s - s.start_s AS slack_s, m.makespan_s
FROM (SELECT run_id, task_id, max(start_s) AS start_s FROM wf_start GROUP BY run_id, task_id) s JOIN wf_task t ON t.task_id = s.task_id
JOIN (SELECT task_id, max(after_s) AS after_s FROM wf_after GROUP BY task_id) e ON e.task_id = s.task_id
JOIN (SELECT s.run_id, max(s.start_s + t.duration_s) AS makespan_s FROM wf_start s JOIN wf_task t ON t.task_id = s.task_id GROUP BY s.run_id) m ON m.run_id = s.run_id""", """
wf_start AS (SELECT run_id, task_id, CAST(0 AS BIGINT) AS start_s FROM wf_task
  UNION SELECT d.run_id, d.task_id, s.start_s + t.duration_s FROM wf_dep d
    JOIN wf_start s ON d.run_id = s.run_id AND d.depends_on = s.task_id JOIN wf_task t ON t.task_id = s.task_id),
wf_after AS (SELECT run_id, task_id, CAST(0 AS BIGINT) AS after_s FROM wf_task
  UNION SELECT d.run_id, d.depends_on, a.after_s + t.duration_s FROM wf_dep d
    JOIN wf_after a ON d.run_id = a.run_id AND d.task_id = a.task_id JOIN wf_task t ON t.task_id = a.task_id)"""))
def critical_path(v: Views) -> DataFrame:
    return graph.critical_path(v.task_rows(), lineage.task_dependencies(v.port()))


@query(using("wf_task wf_dep", """
SELECT s.run_id, s.task_id, max(s.start_s) AS start_s, max(s.start_s + t.duration_s) AS finish_s
FROM wf_start s JOIN wf_task t ON t.task_id = s.task_id GROUP BY s.run_id, s.task_id""", """
wf_start AS (SELECT run_id, task_id, CAST(0 AS BIGINT) AS start_s FROM wf_task
  UNION SELECT d.run_id, d.task_id, s.start_s + t.duration_s FROM wf_dep d
    JOIN wf_start s ON d.run_id = s.run_id AND d.depends_on = s.task_id JOIN wf_task t ON t.task_id = s.task_id)"""))
def earliest_schedule(v: Views) -> DataFrame:
    return graph.earliest_schedule(v.task_rows(), lineage.task_dependencies(v.port()))


@query(using("wf_task wf_dep", "SELECT run_id, task_id, min(hops) AS hops FROM wf_up WHERE task_id NOT IN (SELECT task_id FROM wf_task WHERE state = 'failed') GROUP BY run_id, task_id", """
wf_up AS (SELECT run_id, task_id, CAST(0 AS BIGINT) AS hops FROM wf_task WHERE state = 'failed'
  UNION SELECT d.run_id, d.depends_on, u.hops + 1 FROM wf_dep d JOIN wf_up u ON d.run_id = u.run_id AND d.task_id = u.task_id)"""))
def upstream_closure(v: Views) -> DataFrame:
    """What the failed tasks needed."""
    failed = v.task_rows().where("state = 'failed'")
    return graph.upstream_closure(failed, lineage.task_dependencies(v.port()))


@query(using("wf_task wf_dep", "SELECT run_id, task_id, min(hops) AS hops FROM wf_down WHERE task_id NOT IN (SELECT task_id FROM wf_task WHERE state = 'failed') GROUP BY run_id, task_id", """
wf_down AS (SELECT run_id, task_id, CAST(0 AS BIGINT) AS hops FROM wf_task WHERE state = 'failed'
  UNION SELECT d.run_id, d.task_id, u.hops + 1 FROM wf_dep d JOIN wf_down u ON d.run_id = u.run_id AND d.depends_on = u.task_id)"""))
def failure_impact(v: Views) -> DataFrame:
    failed = v.task_rows().where("state = 'failed'")
    return graph.failure_impact(failed, lineage.task_dependencies(v.port()))


@query(using("wf_task wf_dep", "SELECT run_id, task_id, min(other) AS component FROM wf_comp GROUP BY run_id, task_id", """
wf_link AS (SELECT run_id, task_id AS a, depends_on AS b FROM wf_dep UNION SELECT run_id, depends_on, task_id FROM wf_dep),
wf_comp AS (SELECT run_id, task_id, task_id AS other FROM wf_task
  UNION SELECT c.run_id, l.b, c.other FROM wf_comp c JOIN wf_link l ON l.run_id = c.run_id AND l.a = c.task_id)"""))
def sub_workflows(v: Views) -> DataFrame:
    return graph.sub_workflows(v.task_rows(), lineage.task_dependencies(v.port()))


# --- commands -----------------------------------------------------------------------------


def _blueprints(v: Views) -> DataFrame:
    return stored(manifest.blueprints(v.program(), v.software(), v.param(), v.redirect(), "tmp"), "blueprints")[0]


@query(using("wf_composed wf_file wf_pipe wf_task wf_stream wf_first_pipe", """
SELECT c.run_id, c.task_id, c.app_id, c.label, CASE WHEN c.task_id % 2 = 0 THEN '0,1,128' ELSE '0' END AS success_on, t.pool AS executor, c.cmd, c.cmd || ' > ' || c.stdout || ' 2> ' || c.stderr AS logged,
  c.stdout, c.stderr, coalesce(f.i, 0) AS n_inputs, coalesce(f.o, 0) AS n_outputs, coalesce(f.w, 0) AS n_waits,
  coalesce(f.d, 0) AS n_defaulted, coalesce(s.n_ignored, 0) + coalesce(p.n_ignored, 0) AS n_ignored
FROM wf_composed c LEFT JOIN wf_stream s ON s.task_id = c.task_id LEFT JOIN wf_first_pipe p ON p.task_id = c.task_id LEFT JOIN (SELECT task_id, count(*) FILTER (WHERE role = 'input') AS i,
  count(*) FILTER (WHERE role = 'output') AS o, count(*) FILTER (WHERE role = 'wait_on') AS w,
  count(*) FILTER (WHERE mode_defaulted) AS d FROM wf_file GROUP BY task_id) f
ON f.task_id = c.task_id JOIN wf_task t ON t.task_id = c.task_id WHERE c.task_id NOT IN (SELECT right_task_id FROM wf_pipe)"""))
def command_manifest(v: Views) -> DataFrame:
    found = manifest.command_manifest(
        v.program(), v.software(), v.param(ranked=True), v.redirect(ranked=True), v.pipe(), v.declared_port()
    )
    return found.withColumns({"success_on": F.array_join("success_on", ","), "executor": F.col("meta")["executor"]}).drop("meta")


@query(using("wf_file", "SELECT task_id, role, path, mode_defaulted FROM wf_file"))
def command_files(v: Views) -> DataFrame:
    return manifest.command_files(v.task(), v.param(ranked=True), v.redirect(ranked=True), v.pipe(), v.declared_port()).drop("run_id")


@query(using("wf_mode", "SELECT task_id, path, role, defaulted AS mode_defaulted FROM wf_mode"))
def file_modes(v: Views) -> DataFrame:
    return manifest.file_modes(v.task(), v.param(ranked=True)).drop("run_id")


@query(using("wf_resolved", "SELECT run_id, task_id, seq FROM wf_resolved WHERE kind = 'bash' AND final_path IS NULL"))
def unresolved_programs(v: Views) -> DataFrame:
    return manifest.unresolved_programs(v.program(), v.software())


@query(using("wf_stream", "SELECT task_id, stdout, stderr, output1, output2, token1, token2, n_ignored FROM wf_stream"))
def redirect_resolve(v: Views) -> DataFrame:
    return manifest.redirect_resolve(v.redirect()).drop("run_id")


@query(using("wf_composed", "SELECT task_id, cmd, stdout, stderr FROM wf_composed WHERE is_piped"))
def pipe_compose(v: Views) -> DataFrame:
    return manifest.pipe_compose(_blueprints(v), v.pipe()).where("is_piped").select("task_id", "cmd", "stdout", "stderr")


@query(using("wf_resolved", """
SELECT program, count(DISTINCT run_id) AS n_runs, count(*) AS n_tasks FROM wf_resolved WHERE program IS NOT NULL GROUP BY program"""))
def program_inventory(v: Views) -> DataFrame:
    return manifest.program_inventory(v.program(), v.software())


@query(using("wf_resolved", """
SELECT run_id, task_id, CASE WHEN CASE WHEN task_id % 2 = 0 THEN task_id % 5 IN (0, 1, 128) ELSE task_id % 5 = 0 END THEN 0 ELSE 1 END AS status
FROM wf_resolved WHERE kind = 'bash' AND program IS NOT NULL"""))
def exit_status(v: Views) -> DataFrame:
    """Exit codes of the programs judged by the codes that each accepts."""
    programs = manifest.resolve_programs(v.program(), v.software()).where("resolved AND kind = 'bash'")
    status = F.when(accepted_exit(F.col("success_on"), F.col("task_id") % 5), 0).otherwise(1)
    return programs.select("run_id", "task_id", status.alias("status"))


# --- matrices -----------------------------------------------------------------------------


def _matrix_rows(v: Views) -> DataFrame:
    return matrix.with_header(v.matrix_body(), v.matrix_header())


def _ragged_rows(v: Views) -> DataFrame:
    """Every 13th line with a cell too many, every 17th cut after two cells, every 19th blank."""
    body = v.matrix_body().withColumn("line", F.expr(
        "CASE WHEN row_id % 13 = 0 THEN concat(line, '\t', 'more') WHEN row_id % 17 = 0 THEN substring_index(line, '\t', 2)"
        " WHEN row_id % 19 = 0 THEN ' ' ELSE line END"))
    return matrix.with_header(body, v.matrix_header())


CELLS = """
SELECT matrix_id, CAST(rank AS BIGINT) AS row_no, CAST(p AS BIGINT) AS pos, h AS header, c AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY matrix_id ORDER BY row_id) AS rank FROM wf_matrix_line) m,
LATERAL (VALUES (0, '--segment', c0), (1, '--dry', c1), (2, '--inputs', c2), (3, 'positional_1', c3), (4, 'positional_0', c4)) t(p, h, c)"""


@query(using("wf_matrix_line", CELLS))
def matrix_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "matrix")
    sinks.matrix_text_sink(v.matrix_line(), path)
    rows = text.matrix_scan(v.spark, path).withColumnRenamed("row_no", "row_id")
    return matrix.matrix_cells(rows.withColumn("matrix_id", F.col("matrix_id").cast("long"))).withColumnRenamed("row_id", "row_no")


@query(using("wf_argv", "SELECT argv FROM wf_argv"))
def matrix_literal_scan(v: Views) -> DataFrame:
    """The argument vectors written as plain command lines and read back."""
    path = scratch_path(v.spark, "literal")
    vectors = matrix.run_arg_vector(_matrix_rows(v))
    vectors.select(F.concat(F.lit("  "), F.array_join("argv", " \t"), F.lit(" ")).alias("value")).write.text(path)
    return text.matrix_literal_scan(v.spark, path).select(F.array_join("argv", " ").alias("argv"))


@query(using("wf_argv", "SELECT matrix_id, row_id, argv, CAST(NULL AS VARCHAR) AS refused FROM wf_argv"))
def run_arg_vector(v: Views) -> DataFrame:
    return matrix.run_arg_vector(_matrix_rows(v)).withColumn("argv", F.array_join("argv", " "))


@query(using("wf_matrix_line", """
SELECT matrix_id, row_id, name, value, source FROM wf_matrix_line, LATERAL (VALUES
  ('segment', c0, 'run'), ('dry', CASE c1 WHEN 'TRUE' THEN 'true' WHEN '#True' THEN 'True' ELSE 'no' END, CASE WHEN c1 = 'false' THEN 'default' ELSE 'run' END),
  ('inputs', c2, 'run'), ('positional_0', c4, 'run'), ('logs_dir', '/batch/logs', 'batch'), ('retries', '3', 'default')) t(name, value, source)"""))
def run_arg_defaults(v: Views) -> DataFrame:
    return matrix.run_arg_defaults(
        matrix.given_arguments(_matrix_rows(v)), {"logs_dir": "/batch/logs"},
        {"segment": None, "dry": "no", "inputs": None, "positional_0": None, "logs_dir": ".", "retries": "3"},
    )


@query(using("wf_matrix_line", """
SELECT matrix_id, row_id, n_cells, CAST(5 AS BIGINT) AS n_headers, CASE n_cells WHEN 6 THEN 'too long' WHEN 2 THEN 'short' ELSE 'blank' END AS reason
FROM (SELECT *, CAST(CASE WHEN row_id % 13 = 0 THEN 6 WHEN row_id % 17 = 0 THEN 2 WHEN row_id % 19 = 0 THEN 1 ELSE 5 END AS BIGINT) AS n_cells
  FROM wf_matrix_line) WHERE n_cells <> 5"""))
def ragged_rows(v: Views) -> DataFrame:
    return matrix.ragged_rows(_ragged_rows(v))


@query(using("wf_matrix_line", """
SELECT row_id AS run_id, workflow, 'run' || row_id || '/' || name AS task_id, CAST(no AS BIGINT) AS task_no,
  'run' || row_id || '/' || i AS input, 'run' || row_id || '/' || o AS output
FROM (SELECT row_id, CASE WHEN c0 IN ('BUILDING', 'MACHINERY') THEN 'align' ELSE 'report' END AS w FROM wf_matrix_line)
JOIN (VALUES ('align', 1, 'trim', 'raw.fq', 'trim.fq'), ('align', 2, 'map', 'trim.fq', 'map.bam'), ('align', 3, 'call', 'map.bam', 'calls.vcf'),
  ('report', 1, 'count', 'raw.fq', 'counts.tsv'), ('report', 2, 'plot', 'counts.tsv', 'plot.pdf')) t(workflow, no, name, i, o) ON w = workflow"""))
def batch_expand(v: Views) -> DataFrame:
    template = v.spark.createDataFrame(
        [("align", 1, "trim", "raw.fq", "trim.fq"), ("align", 2, "map", "trim.fq", "map.bam"),
         ("align", 3, "call", "map.bam", "calls.vcf"), ("report", 1, "count", "raw.fq", "counts.tsv"),
         ("report", 2, "plot", "counts.tsv", "plot.pdf")],
        "workflow string, task_no long, name string, input string, output string",
    )
    rows = _matrix_rows(v).select(
        F.col("row_id").alias("run_id"),
        F.when(F.get("cells", F.lit(0)).isin("BUILDING", "MACHINERY"), "align").otherwise("report").alias("workflow"),
    )
    return matrix.batch_expand(rows, template)


# --- run logs -----------------------------------------------------------------------------


def _log(v: Views) -> DataFrame:
    lines = v.log_line()
    return lines.withColumn("p", runlog.parse_line(F.col("line"))).select(
        "run_id", "line_no", F.col("p.ts").alias("ts"), F.col("p.logger").alias("logger"), F.col("p.message").alias("message")
    )


def _events(v: Views) -> DataFrame:
    return runlog.task_events(_log(v))


@query(using("wf_log", """
SELECT 'run' || run_id AS run_name, ts, logger, task || said AS message, true AS opens FROM wf_log
UNION ALL SELECT 'run' || run_id, ts, logger, 'missing: out/' || line_no, false FROM wf_log WHERE event_type = 'purchase'"""))
def log_scan(v: Views) -> DataFrame:
    """Log text, with a second line under each report of missing outputs, written and read back."""
    path = scratch_path(v.spark, "logs")
    lines = v.log_line().select(
        F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("run_name"), "line_no",
        F.when(F.col("line").endswith("expected outputs"),
               F.concat("line", F.lit("\nmissing: out/"), F.col("line_no").cast("string"))).otherwise(F.col("line")).alias("line"),
    )
    sinks.log_text_sink(lines, path, ["line_no"])
    return text.log_scan(v.spark, path).select("run_name", "ts", "logger", "message", "opens")


@query(using("wf_log", """
SELECT 'run' || run_id AS run_name, CAST(ts AS DATE) AS run_date, count(*) AS n_records FROM wf_log GROUP BY ALL"""))
def log_sink(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "records")
    sinks.log_sink(_log(v).withColumn("run_name", F.concat(F.lit("run"), F.col("run_id").cast("string"))), path)
    return v.spark.read.parquet(path).groupBy("run_name", "run_date").agg(F.count(F.lit(1)).alias("n_records"))


STATE = """
CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' ELSE 'failed' END"""
RANK = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"


@query(using("wf_log", f"""
SELECT t.run_id, t.task, coalesce(s.state, 'pending') AS state
FROM (SELECT c_custkey % 15 AS run_id, concat('task_', CAST(c_custkey AS STRING)) AS task FROM customer) t
LEFT JOIN (SELECT run_id, task, max_by({STATE}, {{ts: ts, r: {RANK}}}) AS state FROM wf_log GROUP BY run_id, task) s
ON s.run_id = t.run_id AND s.task = t.task"""))
def task_state_final(v: Views) -> DataFrame:
    tasks = v.base("customer").select(
        (F.col("c_custkey") % 15).alias("run_id"), F.concat(F.lit("task_"), F.col("c_custkey").cast("string")).alias("task")
    )
    return runlog.task_state_final(_events(v), tasks)


@query(using("wf_log", """
SELECT run_id, CASE event_type WHEN 'error' THEN 'app failure' ELSE 'missing outputs' END AS failure, count(*) AS n
FROM wf_log WHERE event_type IN ('error', 'purchase') GROUP BY ALL"""))
def failure_kinds(v: Views) -> DataFrame:
    return runlog.failure_kinds(_events(v))


@query(using("wf_task", """
SELECT e.run_id, e.state, coalesce(l.nth, 0) AS nth, coalesce(l.name, 'None') AS name FROM
(SELECT DISTINCT run_id, s AS state FROM wf_task, LATERAL (VALUES ('failed'), ('pending')) x(s)) e LEFT JOIN (
  SELECT run_id, state, row_number() OVER (PARTITION BY run_id, state ORDER BY seq) AS nth, 'task_' || task_id AS name FROM wf_task) l
ON l.run_id = e.run_id AND l.state = e.state"""))
def failure_lists(v: Views) -> DataFrame:
    tasks = v.task().select(
        "run_id", "seq", F.concat(F.lit("task_"), F.col("task_id").cast("string")).alias("name"), "state"
    )
    return runlog.failure_lists(tasks)


@query(using("wf_log", f"""
SELECT run_id, min(first) AS started, max(last) AS ended, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_tasks,
  count(*) FILTER (WHERE state = 'pending') AS n_pending, count(*) FILTER (WHERE state = 'running') AS n_running,
  count(*) FILTER (WHERE state = 'completed') AS n_completed, count(*) FILTER (WHERE state = 'failed') AS n_failed,
  CAST(epoch(max(last)) - epoch(min(first)) AS BIGINT) AS elapsed_s
FROM (SELECT run_id, task, min(ts) AS first, max(ts) AS last, count(*) AS n, max_by({STATE}, {{ts: ts, r: {RANK}}}) AS state FROM wf_log GROUP BY run_id, task)
GROUP BY run_id"""))
def run_summary(v: Views) -> DataFrame:
    return runlog.run_summary(_events(v))


def _head_lines(v: Views) -> DataFrame:
    """How the log of each run begins and ends; every fourth has not ended, every third is named."""
    stamp = F.lit("[02Jan2024 03:04:05|wf.main] > ")
    lines = F.array(
        F.concat(stamp, F.lit("Executing: tool run --n "), F.col("c_nationkey").cast("string")),
        F.concat(stamp, F.lit("Who and where: user"), F.col("c_nationkey").cast("string"), F.lit("@node:/data:"), "c_mktsegment"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(stamp, F.lit("Run name: "), "c_name")),
        F.lit("@wf_start 2024-01-02 03:04:05.250000"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(
            F.lit("@wf_end 2024-01-0"), (2 + F.col("c_custkey") % 3).cast("string"), F.lit(" 03:14:05.750000"))),
    )
    rows = v.base("customer").select(F.col("c_custkey").alias("run_id"), F.posexplode(lines).alias("line_no", "line")).where("line IS NOT NULL")
    return rows.withColumn("p", runlog.parse_line(F.col("line"))).select(
        "run_id", "line_no", F.col("p.ts").alias("ts"), F.coalesce("p.message", "line").alias("message"))


@query("""
SELECT c_custkey AS run_id, 'run --n ' || c_nationkey AS command, 'user' || c_nationkey AS user, 'node' AS host, '/data:' || c_mktsegment AS folder,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'run' END AS run_name FROM customer""")
def run_provenance(v: Views) -> DataFrame:
    return runlog.run_provenance(_head_lines(v))


@query("""
SELECT c_custkey AS run_id, TIMESTAMP '2024-01-02 03:04:05.25' AS started,
  CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-02 03:14:05.75' + to_days(CAST(c_custkey % 3 AS INT)) END AS ended,
  CASE WHEN c_custkey % 4 <> 0 THEN 600500000 + c_custkey % 3 * 86400000000 END AS elapsed_us FROM customer""")
def run_tags(v: Views) -> DataFrame:
    return runlog.run_tags(_head_lines(v))


@query("""
SELECT c_custkey AS run_id, 'run_' || c_name || '_1' AS run_name, TIMESTAMP '2024-01-02 03:04:05' AS started FROM customer""")
def log_file_identity(v: Views) -> DataFrame:
    name = F.concat(F.lit("run_"), "c_name", F.lit("_1_02Jan2024_030405.wf.log"))
    return v.base("customer").select(F.col("c_custkey").alias("run_id"), runlog.log_file_identity(name).alias("f")).select("run_id", "f.run_name", "f.started")


@query(using("wf_attempt", """
SELECT run_id, total AS total_seconds, total % 86400 AS elapsed_seconds FROM (
  SELECT run_id, CAST(floor(epoch_us(max(end_ts)) / 1000000.0 - epoch_us(min(start_ts)) / 1000000.0) AS BIGINT) AS total FROM wf_attempt GROUP BY run_id)"""))
def run_elapsed(v: Views) -> DataFrame:
    return runlog.run_elapsed(v.attempt())


SERIES = """
SELECT run_id, ts, CAST(sum(sum(d)) OVER (PARTITION BY run_id ORDER BY ts) AS BIGINT) AS running FROM (
  SELECT run_id, start_ts AS ts, 1 AS d FROM wf_attempt UNION ALL SELECT run_id, end_ts, -1 FROM wf_attempt) GROUP BY run_id, ts"""


@query(using("wf_attempt", f"""
SELECT run_id, max(running) AS peak, min(ts) FILTER (WHERE running = top) AS peak_at
FROM (SELECT *, max(running) OVER (PARTITION BY run_id) AS top FROM ({SERIES})) GROUP BY run_id"""))
def running_concurrency(v: Views) -> DataFrame:
    return runlog.running_concurrency(v.attempt())


@query(using("wf_attempt", """
SELECT i.run_id, i.at, a.task_id FROM (SELECT DISTINCT run_id, date_trunc('day', start_ts) + INTERVAL 12 HOUR AS at FROM wf_attempt) i
JOIN wf_attempt a ON a.run_id = i.run_id AND a.start_ts <= i.at AND i.at < a.end_ts"""))
def running_at(v: Views) -> DataFrame:
    """The running tasks of every run at noon of each of its days."""
    noon = v.attempt().select("run_id", (F.date_trunc("day", "start_ts") + F.expr("INTERVAL 12 HOUR")).cast("timestamp_ntz").alias("at")).distinct()
    return runlog.running_at(noon, runlog.running_index(v.attempt()))


@query(using("wf_attempt", SERIES))
def concurrency_series(v: Views) -> DataFrame:
    return runlog.concurrency_series(v.attempt())


@query(using("wf_attempt", """
SELECT run_id, task_id, CASE WHEN k = 0 THEN a ELSE greatest(b, a + 600) END AS poll_s, CASE WHEN k = 0 THEN 'entered' ELSE 'left' END AS change
FROM (SELECT run_id, task_id, ceil(epoch_us(start_ts) / 600000000.0) * 600 AS a, ceil(epoch_us(end_ts) / 600000000.0) * 600 AS b
      FROM wf_attempt), LATERAL (VALUES (0), (1)) x(k)"""))
def running_set_change(v: Views) -> DataFrame:
    return runlog.running_set_change(v.attempt())


@query(using("wf_log", """
SELECT run_id, task, ts, line_no, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, line_no) AS BIGINT) AS staged_pos
FROM wf_log WHERE event_type = 'view'"""))
def launch_rank(v: Views) -> DataFrame:
    return runlog.launch_rank(_events(v))


@query(using("wf_log", f"""
SELECT run_id, task, line_no, {STATE} AS state,
  CAST(epoch(lead(ts) OVER (PARTITION BY run_id, task ORDER BY ts, line_no)) - epoch(ts) AS BIGINT) AS seconds FROM wf_log"""))
def state_dwell(v: Views) -> DataFrame:
    return runlog.state_dwell(_events(v))


@query(using("wf_attempt", """
SELECT run_id, task_id, CAST(epoch_us(end_ts) - epoch_us(start_ts) AS BIGINT) // 1000000 AS seconds FROM wf_attempt
ORDER BY seconds DESC, task_id LIMIT 20"""))
def longest_tasks(v: Views) -> DataFrame:
    return runlog.longest_tasks(v.attempt())


@query(using("wf_log", """
SELECT run_id, line_no, message, nth FROM (SELECT run_id, line_no, task || said AS message,
  row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS nth FROM wf_log) WHERE nth <= 5"""))
def first_n_records(v: Views) -> DataFrame:
    """The first five records of each run's log."""
    return runlog.first_n_records(_log(v).select("run_id", "line_no", "message"), "run_id", ["line_no"], 5)


@query(using("wf_capture", """
SELECT CAST(task_id AS STRING) AS task_id, stream, content, true AS readable FROM wf_capture WHERE content <> ''"""))
def capture_scan(v: Views) -> DataFrame:
    files = v.capture().select(
        F.concat(F.lit("tmp/"), F.col("task_id").cast("string"), F.lit("."), "stream").alias("name"), "content"
    )
    return runlog.capture_names(files)


@query("""
SELECT doc_id % 3 AS run_id, doc_id // 3 AS task_id, 'stdout' AS stream, doc_id % 7 <> 0 AS known, CASE WHEN doc_id % 13 = 0
  THEN 'Could not read stdout stream of ' || (doc_id // 3) ELSE 'Output from stdout stream of ' || (doc_id // 3) || ':' || chr(10) || text END AS message
FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 13 = 0""")
def capture_attach(v: Views) -> DataFrame:
    """Three runs whose task ids are the same; some captures are of unknown tasks, empty or unreadable."""
    docs = v.base("documents").select((F.col("doc_id") % 3).alias("run_id"), F.expr("doc_id div 3").alias("task_id"), "doc_id", "text")
    captures = docs.select("run_id", "task_id", F.lit("stdout").alias("stream"), F.expr(
        "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN '' ELSE text END").alias("content"))
    return runlog.capture_attach(captures, docs.where("doc_id % 7 <> 0"))


@query("""
SELECT l_orderkey AS task_id, CASE WHEN l_orderkey % 9 <> 0 THEN count(*) FILTER (WHERE l_returnflag <> 'R') / 2.0 END AS metric
FROM lineitem GROUP BY l_orderkey""")
def text_metric(v: Views) -> DataFrame:
    """Reports of mapped items per order, some of them without the line that is looked for."""
    counts = v.base("lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("m")
    )
    content = F.when(F.col("task_id") % 9 != 0, F.format_string("%d + 0 in total\n%d + 0 mapped (100%% : N/A)", "n", "m")).otherwise(
        F.format_string("%d + 0 in total", "n")
    )
    return runlog.text_metric(counts.select("task_id", content.alias("content")))


@query(using("wf_log", """
SELECT 'small' AS pool, run_id, count(*) AS n_tasks FROM wf_log WHERE event_type = 'signup' GROUP BY run_id
UNION ALL SELECT 'small', NULL, count(*) FROM wf_log WHERE event_type = 'signup' HAVING count(*) > 0
UNION ALL SELECT NULL, run_id, count(*) FROM wf_log WHERE event_type = 'signup' GROUP BY run_id
UNION ALL SELECT NULL, NULL, count(*) FROM wf_log WHERE event_type = 'signup'"""))
def pool_load(v: Views) -> DataFrame:
    return runlog.pool_load(_log(v))


# --- pools --------------------------------------------------------------------------------


def _labels(v: Views) -> DataFrame:
    return v.task_rows().select(F.col("pool").alias("label")).distinct()


@query(using("wf_task wf_pool", """
SELECT t.run_id, t.task_id, t.pool AS wanted, coalesce(p.label, 'all') AS assigned FROM wf_task t LEFT JOIN wf_pool p ON p.label = t.pool"""))
def pool_assignment(v: Views) -> DataFrame:
    """Programs name their pool by 'executor', Python steps by the older 'site'.  The default
    label is not among the defined ones, so it does not apply."""
    tasks = v.task_rows().select(
        "run_id", "task_id", F.when(F.col("kind") == "bash", F.col("pool")).alias("executor"),
        F.when(F.col("kind") == "python", F.col("pool")).alias("site"),
    )
    return pools.pool_assignment(tasks, v.pool(), _labels(v), "extra")


@query(using("wf_task wf_pool", """
SELECT coalesce(t.label, p.label) AS label, t.label IS NOT NULL AS in_pipeline, p.label IS NOT NULL AS in_config
FROM (SELECT DISTINCT pool AS label FROM wf_task) t FULL JOIN wf_pool p ON t.label = p.label"""))
def pool_overlap(v: Views) -> DataFrame:
    return pools.pool_overlap(_labels(v), v.pool())


@query(using("wf_task wf_pool", """
SELECT n_both, n_only_pipeline, n_only_config, CASE WHEN n_both = 0 THEN 'none' WHEN n_only_pipeline + n_only_config = 0 THEN 'perfect' ELSE 'some' END AS match
FROM (SELECT count(*) FILTER (WHERE t.label IS NOT NULL AND p.label IS NOT NULL) AS n_both,
  count(*) FILTER (WHERE p.label IS NULL) AS n_only_pipeline, count(*) FILTER (WHERE t.label IS NULL) AS n_only_config
  FROM (SELECT DISTINCT pool AS label FROM wf_task) t FULL JOIN wf_pool p ON t.label = p.label)"""))
def pool_match_report(v: Views) -> DataFrame:
    return pools.pool_match_report(_labels(v), v.pool())


@query(using("wf_task wf_pool", """
SELECT p.cpu, CASE right(p.mem, 1) WHEN 'G' THEN 1073741824 WHEN 'M' THEN 1048576 END * CAST(left(p.mem, -1) AS BIGINT) AS mem_bytes, count(*) AS n_tasks
FROM wf_task t LEFT JOIN wf_pool p ON p.label = t.pool GROUP BY ALL"""))
def resource_profiles(v: Views) -> DataFrame:
    return pools.resource_profiles(v.task_rows(), v.pool())


@query(using("wf_task", "SELECT pool, kind, count(*) AS n_tasks FROM wf_task GROUP BY ROLLUP (pool, kind)"))
def resource_rollup(v: Views) -> DataFrame:
    return pools.resource_rollup(v.task_rows())


# --- configuration and registry -----------------------------------------------------------

SITE = """
SELECT c_custkey AS config_id, n_name, c_custkey, c_nationkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"""
LEAVES = f"""
SELECT config_id, name, leaf_type, value, default_value, always_default, error FROM (
  SELECT config_id, 'root__' || n_name || '__path' AS name, 'Path' AS leaf_type, '/site/' || c_custkey AS value,
    NULL AS default_value, false AS always_default, NULL AS error FROM ({SITE})
  UNION ALL SELECT config_id, 'root__' || n_name || '__threads', CASE WHEN c_custkey % 7 <> 0 THEN 'List' END, NULL,
    CAST(c_nationkey AS VARCHAR), c_custkey % 4 = 0, CASE WHEN c_custkey % 7 = 0 THEN 'bad q_type' END FROM ({SITE})
  UNION ALL SELECT config_id, 'root__shared__deep__ref_path', 'Path', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '/ref/' || c_mktsegment END,
    NULL, false, NULL FROM ({SITE})
  UNION ALL SELECT config_id, 'root__shared__count', NULL, NULL, NULL, false, 'unknown object' FROM ({SITE}) WHERE c_custkey % 11 = 0)"""


def _leaves(v: Views) -> DataFrame:
    return config.config_flatten(config.parse_config(v.site_config()))


@query(f"""
SELECT config_id, c_custkey % 13 <> 0 AS valid, CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '/ref/' || c_mktsegment END END AS ref_path
FROM ({SITE})""")
def config_scan(v: Views) -> DataFrame:
    """Site configurations; every 13th file lost its last character."""
    files = v.site_config().withColumn(
        "json", F.when(F.col("config_id") % 13 == 0, F.expr("left(json, length(json) - 1)")).otherwise(F.col("json"))
    )
    return config.parse_config(files).select(
        "config_id", "valid", F.expr("try_variant_get(tree, '$.shared.deep.ref_path', 'string')").alias("ref_path")
    )


@query(LEAVES)
def config_flatten(v: Views) -> DataFrame:
    return _leaves(v).drop("path")


@query(f"SELECT config_id, name, error FROM ({LEAVES}) WHERE error IS NOT NULL")
def config_errors(v: Views) -> DataFrame:
    return config.config_errors(_leaves(v))


INFLATED = f"""
SELECT config_id, '{{"' || n_name || '":{{"path":"/site/' || c_custkey || '"' ||
  CASE WHEN c_custkey % 7 <> 0 THEN ',"threads":"' || c_nationkey || '"' ELSE '' END ||
  '}},"shared":{{"deep":{{"ref_path":"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '/ref/' || c_mktsegment END || '"}}}}}}' AS json FROM ({SITE})"""


@query("""
SELECT config_id, name, x.a AS attribute, x.j AS json FROM (
  SELECT c_custkey AS config_id, concat('root__', n_name, '__threads') AS name,
    unnest([{a: 'q_type', j: CASE WHEN c_custkey % 7 = 0 THEN '"radio"' ELSE '"list"' END}, {a: 'message', j: '"n"'},
      {a: 'default', j: concat('"', CAST(c_nationkey AS STRING), '"')}, {a: 'always_default', j: CASE WHEN c_custkey % 4 = 0 THEN '"x"' END}]) AS x
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE x.j IS NOT NULL""")
def question_attributes(v: Views) -> DataFrame:
    """Type, message and every other attribute of the questions of all configurations."""
    return config.question_attributes(config.parse_config(v.site_config()))


def _inflated(v: Views) -> DataFrame:
    answered = _leaves(v).where("error IS NULL").withColumn("value", F.coalesce("value", "default_value"))
    return config.config_inflate(answered)


@query(INFLATED)
def config_inflate(v: Views) -> DataFrame:
    return _inflated(v)


@query(INFLATED)
def config_sink(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "configs")
    sinks.config_sink(_inflated(v), path)
    written = r'^\{"config_id":(\d+),"config":(.*)\}$'
    return v.spark.read.text(path).select(
        F.regexp_extract("value", written, 1).cast("long").alias("config_id"), F.regexp_extract("value", written, 2).alias("json"))


@query(f"""
SELECT l.config_id, l.name, l.leaf_type, CASE WHEN l.always_default THEN l.default_value
  ELSE coalesce(CASE WHEN p.prior <> '' THEN p.prior END, l.default_value) END AS default_value
FROM ({LEAVES}) l LEFT JOIN (SELECT c_custkey AS config_id, 'root__' || n_name || '__' || k AS name,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'prior ' || c_custkey END AS prior
  FROM customer JOIN nation ON c_nationkey = n_nationkey, LATERAL (VALUES ('path'), ('threads')) x(k)) p
ON p.config_id = l.config_id AND p.name = l.name WHERE l.error IS NULL""")
def config_overlay(v: Views) -> DataFrame:
    """Earlier answers of each site for two of its questions, a third of them empty."""
    prior = v.base("customer").join(v.base("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("config_id"),
        F.explode(F.array(F.concat(F.lit("root__"), "n_name", F.lit("__path")), F.concat(F.lit("root__"), "n_name", F.lit("__threads")))).alias("name"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('prior ', CAST(c_custkey AS STRING)) END").alias("value"),
    )
    return config.config_overlay(_leaves(v), prior)


@query("""
SELECT i.pipeline_id, i.config_key, i.path, CASE WHEN s.k IS NOT NULL THEN '/old/' || s.k END AS stored FROM (
  SELECT p_partkey % 50 AS pipeline_id, p_brand AS config_key, max_by('/envs/' || (p_partkey % 50) || '/' ||
    CASE WHEN p_partkey % 3 = 0 THEN concat('share/', p_name, '.jar') ELSE 'bin/' || lower(p_type) END, p_partkey) AS path
  FROM part GROUP BY ALL) i
LEFT JOIN (SELECT DISTINCT p_partkey % 50 AS pipeline_id, p_brand AS k FROM part WHERE p_size > 25) s ON s.pipeline_id = i.pipeline_id AND s.k = i.config_key""")
def software_path_inject(v: Views) -> DataFrame:
    packages = v.package()
    stored = v.base("part").where("p_size > 25").select(
        (F.col("p_partkey") % 50).alias("pipeline_id"), F.col("p_brand").alias("config_key"),
        F.concat(F.lit("/old/"), "p_brand").alias("path"),
    ).distinct()
    return config.software_path_inject(packages, "/envs", stored)


@query(using("wf_package", "SELECT pipeline_id, tag, count(*) AS n_packages FROM wf_package GROUP BY ALL"))
def tag_inventory(v: Views) -> DataFrame:
    return config.tag_inventory(v.package())


@query(using("wf_candidate", """
SELECT pipeline_id, CASE WHEN cmd_line LIKE 'basic-%' THEN cmd_line WHEN pipeline_config LIKE 'basic-%' THEN pipeline_config
  WHEN pipeline_default IS NOT NULL THEN pipeline_default WHEN no_config_behavior = 'use_package_default' THEN 'basic-threads-2' END AS chosen,
  CASE WHEN cmd_line LIKE 'basic-%' THEN 'command line' WHEN pipeline_config LIKE 'basic-%' THEN 'pipeline config'
  WHEN pipeline_default IS NOT NULL THEN 'pipeline default' WHEN no_config_behavior = 'use_package_default' THEN 'package default' ELSE 'fail' END AS level
FROM wf_candidate"""))
def config_cascade(v: Views) -> DataFrame:
    return config.config_cascade(v.candidate(), v.base("nation").select(F.lower("n_name").alias("name")))


SETTINGS = """
SELECT change_id, setting_key, setting_value, CASE WHEN setting_key = 'unknown_key' THEN 'bad key'
  WHEN setting_key = 'delete_temporary_files' AND setting_value IN ('yes', 'no') THEN 'set'
  WHEN setting_key = 'no_parsl_config_behavior' AND setting_value IN ('fail', 'use_package_default') THEN 'set'
  ELSE 'bad value' END AS outcome FROM wf_setting_change"""


@query(using("wf_setting_change", SETTINGS))
def setting_validate(v: Views) -> DataFrame:
    return config.setting_validate(v.setting_change())


@query(using("wf_setting_change", f"""
SELECT setting_key, max_by(setting_value, change_id) AS setting_value FROM ({SETTINGS}) WHERE outcome = 'set' GROUP BY setting_key"""))
def settings_current(v: Views) -> DataFrame:
    return config.settings_current(v.setting_change())


@query(using("wf_answer", """
SELECT answer_id, v AS value, CASE WHEN q_type = 'radio' THEN 'bad q_type' WHEN ignored THEN 'ignored'
  WHEN question = 'q0' AND v NOT IN ('BUILDING', 'MACHINERY') THEN 'not a choice' WHEN question = 'q1' AND v <> 'AUTOMOBILE' THEN 'not a choice'
  WHEN answer = '' THEN 'default' ELSE 'answered' END AS status
FROM (SELECT *, CASE WHEN ignored OR answer = '' THEN default_value ELSE answer END AS v FROM wf_answer)"""))
def answer_validate(v: Views) -> DataFrame:
    """Two of four questions have choices, and not the same ones."""
    rules = v.base("customer").where("c_custkey % 4 < 2").select(
        F.concat(F.lit("q"), (F.col("c_custkey") % 4).cast("string")).alias("question"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array(F.lit("AUTOMOBILE"))).alias("choices"),
    ).distinct()
    return config.answer_validate(v.answer(), rules)


REGISTRY = """
SELECT name, i.ts AS installed_at, coalesce(c > i, false) AS configured FROM (
  SELECT name, max({ts: changed_at, s: seq}) FILTER (WHERE op = 'install') AS i, max({ts: changed_at, s: seq}) FILTER (WHERE op = 'configure') AS c,
    max({ts: changed_at, s: seq}) FILTER (WHERE op = 'uninstall') AS u FROM wf_registry_change WHERE type = 'pipeline_record' GROUP BY name)
WHERE i IS NOT NULL AND (u IS NULL OR i > u)"""


@query(using("wf_registry_change", REGISTRY))
def registry_current(v: Views) -> DataFrame:
    return config.registry_current(v.registry_change())


@query(using("wf_registry_change", f"""
SELECT name, CASE WHEN configured THEN 'Yes' ELSE 'No' END AS configured, strftime(installed_at, '%Y%b%d %H:%M:%S') AS installed_date FROM ({REGISTRY})"""))
def registry_list(v: Views) -> DataFrame:
    return config.registry_list(v.registry_change())


@query(using("wf_registry_change", f"""
SELECT '/tools/v1.' || (p_partkey % 7) || '/p' || (p_partkey % 60) || '.py' AS path, 'p' || (p_partkey % 60) AS name
FROM part WHERE 'p' || (p_partkey % 60) IN (SELECT name FROM ({REGISTRY}))"""))
def installed_lookup(v: Views) -> DataFrame:
    files = v.base("part").select(F.expr(
        "concat('/tools/v1.', CAST(p_partkey % 7 AS STRING), '/p', CAST(p_partkey % 60 AS STRING), '.py')"
    ).alias("path"))
    return config.installed_lookup(files, config.registry_current(v.registry_change()))


# --- programs and Python steps ------------------------------------------------------------


def _document_lines(v: Views) -> DataFrame:
    return v.base("documents").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")
    ).where("line IS NOT NULL")


TEXT_LINES = """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


@query(f"SELECT doc_id, line_no, line FROM ({TEXT_LINES}) WHERE contains(line, 'the')")
def external_program(v: Views) -> DataFrame:
    """``grep -F`` over all lines of all documents; no match in a partition is a success too."""
    tagged = _document_lines(v).select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), "line").alias("line"))
    found = steps.pipe_through(tagged, ["grep", "-a", "-F", "the"], success_on=["0", "1"])
    cells = F.split("line", "\t", 3)
    return found.where("source = 'stdout'").select(
        cells[0].cast("long").alias("doc_id"), cells[1].cast("long").alias("line_no"), cells[2].alias("line")
    )


@query("SELECT lower(o_orderpriority) AS priority, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '%LOW%' GROUP BY ALL")
def program_chain(v: Views) -> DataFrame:
    """Two programs joined by a pipe."""
    found = steps.pipe_through(
        v.base("orders").select(F.col("o_orderpriority").alias("line")),
        [["grep", "-v", "LOW"], ["tr", "A-Z", "a-z"]],
    )
    return found.where("source = 'stdout'").groupBy(F.col("line").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def measure_lines(batch: pd.DataFrame) -> pd.DataFrame:
    """Lines and the longest of them; a null text gives none."""
    batch = batch[batch["text"].notna()]
    texts = batch["text"].tolist()
    return pd.DataFrame({
        "doc_id": batch["doc_id"], "n_lines": [t.count("\n") + 1 for t in texts],
        "longest": [max(map(len, t.split("\n"))) for t in texts],
    })


@query(f"""
SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM ({TEXT_LINES}) GROUP BY doc_id""")
def python_step(v: Views) -> DataFrame:
    return steps.python_step(
        v.base("documents").select("doc_id", "text"), measure_lines, "doc_id long, n_lines long, longest long"
    )


@query(f"SELECT doc_id, line_no, line FROM ({TEXT_LINES}) WHERE trim(line) <> ''")
def python_udtf(v: Views) -> DataFrame:
    """A Python function that yields many rows for one input."""

    def filled_lines(batch: pd.DataFrame) -> pd.DataFrame:
        lines = batch["text"].str.split("\n").explode().dropna()
        numbered = pd.DataFrame({"line_no": lines.groupby(level=0).cumcount(), "line": lines})
        return numbered[numbered["line"].str.strip(" ") != ""]

    return steps.python_table(v.base("documents").select("doc_id", "text"), filled_lines, "line_no long, line string", ["doc_id"])


def total_lengths(batch: pd.DataFrame) -> pd.DataFrame:
    """Texts by language, null among them; a null text counts as one without a length."""
    sizes = pd.array([len(t) if isinstance(t, str) else None for t in batch["text"]], dtype="Int64")
    return add_lengths(pd.DataFrame({"lang": batch["lang"], "n": 1, "total": sizes, "longest": sizes}))


def add_lengths(rows: pd.DataFrame) -> pd.DataFrame:
    grouped = rows.groupby("lang", as_index=False, dropna=False)
    return grouped.agg({"n": "sum", "total": lambda x: x.sum(min_count=1), "longest": "max"})


@query("""
SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total, max(length(text)) AS longest FROM documents GROUP BY lang""")
def python_udaf(v: Views) -> DataFrame:
    return steps.python_combine(
        v.base("documents").select("lang", "text"), ["lang"], total_lengths, add_lengths,
        "lang string, n long, total long, longest long",
    )


@query(using("wf_port wf_manifest", """
SELECT run_id, task_id, count(*) AS n_declared, count(*) FILTER (WHERE m.path IS NULL) AS n_missing, bool_and(m.path IS NOT NULL) AS kept
FROM wf_port p LEFT JOIN wf_manifest m ON m.path = p.path WHERE role = 'output' GROUP BY run_id, task_id"""))
def output_contract(v: Views) -> DataFrame:
    return steps.output_contract(v.port(), v.manifest())


@query()
def manifest_scan(v: Views) -> DataFrame:
    return text.manifest_scan(v.spark, v.sf_dir, "*.parquet").select(
        F.substring_index("path", "/", -1).alias("name"), "length", F.col("modified").cast("timestamp_ntz").alias("modified")
    )


# --- streams ------------------------------------------------------------------------------


def _event_stream(v: Views) -> DataFrame:
    stream = runs.parquet_stream(v.spark, v.sf_dir, "events")
    state = F.expr("CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' ELSE 'failed' END")
    return stream.select(
        (F.col("user_id") % 15).alias("run_id"), F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("task"),
        F.col("event_type").alias("pool"), state.alias("state"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


@query(f"""
SELECT user_id % 15 AS run_id, concat('task_', CAST(user_id AS STRING)) AS task, max_by({STATE}, {{ts: ts, r: {RANK}}}) AS state, max(ts) AS ts
FROM events GROUP BY user_id""")
def stream_task_state(v: Views) -> DataFrame:
    batches = runs.drain(runs.task_states(_event_stream(v)), "states", "update")
    return _plain(runs.newest_states(batches), "ts")


@query(f"""
SELECT run_id, task, before, state, ts FROM (
  SELECT *, lag(state) OVER (PARTITION BY task ORDER BY ts, {RANK}) AS before FROM (
    SELECT DISTINCT user_id % 15 AS run_id, concat('task_', CAST(user_id AS STRING)) AS task, {STATE} AS state, event_type, ts FROM events))
WHERE before IS DISTINCT FROM state""")
def stream_task_changes(v: Views) -> DataFrame:
    """Every change of state of every task, kept by a state machine for each."""
    changes = runs.drain(machines.task_changes(_event_stream(v)), "changes", "append")
    return _plain(changes.drop("batch_id"), "ts")


@query("""
SELECT c_custkey AS run_id, TIMESTAMP '2024-01-02 03:04:05.25' AS started,
  CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-02 03:14:05.75' + to_days(CAST(c_custkey % 3 AS INT)) END AS ended,
  c_custkey % 4 <> 0 AS closed FROM customer""")
def stream_run_spans(v: Views) -> DataFrame:
    """Runs by their start and end tags, ended or still open, from log lines that arrive as files."""
    source = scratch_path(v.spark, "tags")
    _head_lines(v).select("run_id", "message").write.parquet(source)
    stream = v.spark.readStream.schema("run_id long, message string").parquet(source)
    done = runs.run_to_end(machines.run_spans(stream), "spans", "append")
    ended = done.rows.drop("batch_id").withColumn("closed", F.lit(True))
    every = ended.unionByName(machines.open_runs(v.spark, done.checkpoint).withColumn("closed", F.lit(False)))
    return _plain(every.select("run_id", *[F.timestamp_micros(f"{c}_us").alias(c) for c in ("started", "ended")], "closed"), "started", "ended")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS pool, count(*) AS n FROM events GROUP BY ALL")
def stream_run_counts(v: Views) -> DataFrame:
    batches = runs.drain(runs.run_counts(_event_stream(v)), "counts", "update")
    return _plain(runs.latest(batches, ["window_start", "pool"]), "window_start")


@query("""
WITH late AS (
  SELECT event_id % 3 = 0 AND date_trunc('hour', ts) + INTERVAL 1 HOUR
    <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_id % 3 = 1) AS is_late FROM events)
SELECT count(*) AS n_read, count(*) FILTER (WHERE NOT is_late) AS n_counted, count(*) FILTER (WHERE is_late) AS n_late,
  count(*) FILTER (WHERE is_late) > 0 AS reported FROM late""")
def stream_late_rows(v: Views) -> DataFrame:
    """Hourly counts of events that arrive in three parts: rows read, counted and too late, and whether Spark reported any.

    What is too late in a micro-batch is judged by the watermark that held in the one before it, which comes from the first part.
    """
    source = scratch_path(v.spark, "arrivals")
    events = v.base("events").select("event_id", F.col("event_type").alias("pool"), F.col("ts").cast("timestamp").alias("ts"))
    for part in (1, 2, 0):  # files are read in order of their time
        events.where(F.col("event_id") % 3 == part).coalesce(8).write.parquet(f"{source}/part={part}")
    files = len(v.spark.read.parquet(f"{source}/part=1").inputFiles())
    stream = v.spark.readStream.schema("event_id long, pool string, ts timestamp, part int").option("maxFilesPerTrigger", files).parquet(source)
    done = runs.run_to_end(runs.run_counts(stream), "late", "update")
    counted = runs.latest(done.rows, ["window_start", "pool"]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_counted"))
    read = F.lit(done.n_read).cast("long")
    return counted.select(read.alias("n_read"), "n_counted", (read - F.col("n_counted")).alias("n_late"), F.lit(done.n_late > 0).alias("reported"))


@query("""
SELECT run_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT user_id % 15 AS run_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id % 15 ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
GROUP BY run_id, session""")
def stream_run_sessions(v: Views) -> DataFrame:
    done = runs.run_to_end(runs.run_sessions(_event_stream(v)), "sessions", "append")
    every = done.rows.drop("batch_id").unionByName(runs.open_sessions(v.spark, done.checkpoint))
    return _plain(every, "session_start", "session_end")


@query(f"""
SELECT DISTINCT user_id % 15 AS run_id, concat('task_', CAST(user_id AS STRING)) AS task, {STATE} AS state, date_trunc('hour', ts) AS hour FROM events""")
def stream_dedup(v: Views) -> DataFrame:
    batches = runs.drain(runs.distinct_transitions(_event_stream(v)), "transitions", "append")
    return _plain(batches.drop("batch_id"), "hour")


@query(using("wf_log", "SELECT ts, logger, task || said AS message FROM wf_log"))
def stream_log_tail(v: Views) -> DataFrame:
    source, target = scratch_path(v.spark, "tail"), scratch_path(v.spark, "tailed")
    v.log_line().select(F.col("line").alias("value")).write.text(source)
    runs.tail_to(runs.log_tail(v.spark, source), f"{target}/rows", f"{target}/state").awaitTermination()
    return v.spark.read.parquet(f"{target}/rows").where("opens").select("ts", "logger", "message")
