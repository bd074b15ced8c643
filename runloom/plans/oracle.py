"""The checking SQL: each view as a common table expression, and a helper to prefix them."""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "wf_task": ([], """
SELECT o_custkey AS run_id, o_orderkey AS task_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq,
  CASE WHEN o_orderkey % 4 = 0 THEN 'python' ELSE 'bash' END AS kind, o_orderpriority AS pool,
  CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'pending' END AS state,
  1 + o_orderkey % 9 AS duration_s, o_orderkey % 5 = 0 AS tmp_output FROM orders"""),
    "wf_port": (["wf_task"], """
SELECT run_id, task_id, 'output' AS role, concat('out/', CAST(task_id AS STRING)) AS path FROM wf_task
UNION ALL SELECT t.run_id, t.task_id, 'input', concat('out/', CAST(p.task_id AS STRING)) FROM wf_task t JOIN wf_task p
  ON p.run_id = t.run_id AND t.seq > 1 AND p.seq = CAST(floor(t.seq / 2.0) AS BIGINT)
UNION ALL SELECT DISTINCT t.run_id, t.task_id, 'input', concat('part/', CAST(l.l_partkey AS STRING))
  FROM wf_task t JOIN lineitem l ON l.l_orderkey = t.task_id
UNION ALL SELECT t.run_id, t.task_id, 'wait_on', CAST(p.task_id AS STRING) FROM wf_task t JOIN wf_task p
  ON p.run_id = t.run_id AND t.seq % 3 = 0 AND p.seq = t.seq - 2"""),
    "wf_manifest": (["wf_task"], """
SELECT concat('out/', CAST(task_id AS STRING)) AS path FROM wf_task WHERE state = 'completed' AND task_id % 7 <> 0"""),
    "wf_dep": (["wf_port"], """
SELECT i.run_id, i.task_id, o.task_id AS depends_on FROM wf_port i JOIN wf_port o
  ON i.run_id = o.run_id AND i.path = o.path AND i.role = 'input' AND o.role = 'output'
UNION SELECT run_id, task_id, CAST(path AS BIGINT) FROM wf_port WHERE role = 'wait_on'"""),
    "wf_node": (["wf_task", "wf_port"], """
SELECT run_id, CAST(task_id AS STRING) AS id, 'app' AS type FROM wf_task
UNION SELECT run_id, path, 'data' FROM wf_port WHERE role <> 'wait_on'"""),
    "wf_edge": (["wf_port"], """
SELECT run_id, path AS src, CAST(task_id AS STRING) AS dst FROM wf_port WHERE role IN ('input', 'wait_on')
UNION SELECT run_id, CAST(task_id AS STRING), path FROM wf_port WHERE role = 'output'"""),
    "wf_program": (["wf_task"], """
SELECT run_id, task_id, seq, kind, CASE WHEN kind = 'python' THEN concat('step', substr(pool, 1, 1)) ELSE pool END AS name,
  CASE WHEN task_id % 3 <> 0 THEN concat('/opt/tools/', lower(pool), ' v2') END AS path,
  CASE WHEN task_id % 6 = 1 THEN 'sort' END AS subprogram,
  CASE WHEN task_id % 10 = 1 THEN concat('step ', CAST(task_id AS STRING)) END AS action FROM wf_task"""),
    "wf_software": ([], """
SELECT DISTINCT o_orderpriority AS name, concat('/opt/site/', o_orderpriority) AS path FROM orders WHERE o_orderpriority <> '5-LOW'"""),
    "wf_resolved": (["wf_program", "wf_software"], """
SELECT p.*, coalesce(p.path, s.path) AS final_path,
  CASE WHEN kind = 'bash' THEN coalesce(p.path, s.path) || CASE WHEN subprogram IS NULL THEN '' ELSE ' ' || subprogram END END AS program,
  CASE WHEN kind = 'python' THEN p.name ELSE replace(regexp_extract(coalesce(p.path, s.path), '[^/]*$'), ' ', '_') END
    || '_' || CAST(seq AS STRING) AS app_id
FROM wf_program p LEFT JOIN wf_software s ON p.name = s.name"""),
    "wf_token": ([], """
SELECT l_orderkey AS task_id, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag,
             l_linestatus, l_shipdate) AS BIGINT) AS pos,
  concat('--', l_returnflag) AS flag, concat('ref/', CAST(l_partkey % 40 AS STRING)) AS val,
  CASE l_returnflag WHEN 'A' THEN 'input' WHEN 'R' THEN 'output' END AS mark,
  CASE WHEN l_linestatus = 'F' THEN '=' ELSE ' ' END AS sep, l_suppkey % 3 AS stream,
  concat('log/', CAST(l_partkey AS STRING)) AS dest, l_linenumber % 2 = 0 AS is_data FROM lineitem"""),
    "wf_pipe": (["wf_task"], """
SELECT t.task_id, CAST(r.seq - t.seq AS BIGINT) AS pos, r.task_id AS right_task_id FROM wf_task t JOIN wf_task r
  ON r.run_id = t.run_id AND t.seq % 4 = 0 AND r.seq IN (t.seq + 1, t.seq + 2)"""),
    "wf_cut": (["wf_token"], """
SELECT *, min(CASE WHEN stream = 2 THEN pos END) OVER (PARTITION BY task_id) AS both_pos FROM wf_token WHERE pos <= 2"""),
    "wf_stream": (["wf_cut"], """
SELECT task_id,
  coalesce(max(CASE WHEN pos = both_pos THEN dest END), max_by(dest, pos) FILTER (WHERE stream = 0)) AS stdout,
  coalesce(max(CASE WHEN pos = both_pos THEN dest END), max_by(dest, pos) FILTER (WHERE stream = 1)) AS stderr,
  max(dest) FILTER (WHERE pos = 1 AND is_data AND (both_pos IS NULL OR both_pos > 1)) AS output1,
  max(dest) FILTER (WHERE pos = 2 AND is_data AND both_pos IS NULL) AS output2,
  max(CASE stream WHEN 0 THEN '1>' WHEN 1 THEN '2>' ELSE '&>' END) FILTER (WHERE pos = 1) AS token1,
  max(CASE stream WHEN 0 THEN '1>' WHEN 1 THEN '2>' ELSE '&>' END) FILTER (WHERE pos = 2) AS token2,
  CAST(max(n) - CASE WHEN min(both_pos) = 1 THEN 1 ELSE least(max(n), 2) END AS BIGINT) AS n_ignored
FROM wf_cut JOIN (SELECT task_id, count(*) AS n FROM wf_token GROUP BY task_id) USING (task_id) GROUP BY task_id"""),
    "wf_args": (["wf_token"], """
SELECT task_id, string_agg(flag || sep || val, ' ' ORDER BY pos) AS arguments FROM wf_token GROUP BY task_id"""),
    "wf_blueprint": (["wf_resolved", "wf_stream", "wf_args"], """
SELECT r.run_id, r.task_id, r.app_id, coalesce(r.action, r.program) AS label,
  CASE WHEN a.arguments IS NULL THEN r.program ELSE r.program || ' ' || a.arguments END AS cmd,
  s.stderr AS left_stderr,
  coalesce(s.stdout, 'tmp/' || r.app_id || '.stdout') AS stdout,
  coalesce(s.stderr, 'tmp/' || r.app_id || '.stderr') AS stderr
FROM wf_resolved r LEFT JOIN wf_stream s USING (task_id) LEFT JOIN wf_args a USING (task_id)
WHERE r.kind = 'bash' AND r.program IS NOT NULL"""),
    "wf_first_pipe": (["wf_pipe"], """
SELECT task_id, min_by(right_task_id, pos) AS right_task_id, count(*) - 1 AS n_ignored FROM wf_pipe GROUP BY task_id"""),
    "wf_composed": (["wf_blueprint", "wf_first_pipe"], """
SELECT l.run_id, l.task_id, l.app_id, l.label, CAST(0 AS BIGINT) AS part, r.cmd IS NOT NULL AS is_piped,
  CASE WHEN r.cmd IS NULL THEN l.cmd
       ELSE l.cmd || CASE WHEN l.left_stderr IS NULL THEN '' ELSE ' 2> ' || l.left_stderr END || ' | ' || r.cmd END AS cmd,
  coalesce(r.stdout, l.stdout) AS stdout, coalesce(r.stderr, l.stderr) AS stderr
FROM wf_blueprint l LEFT JOIN wf_first_pipe p ON l.task_id = p.task_id
  LEFT JOIN wf_blueprint r ON r.task_id = p.right_task_id"""),
    "wf_mode": (["wf_token", "wf_task"], """
SELECT task_id, path, CASE WHEN mode = 'input' THEN 'input' ELSE 'output' END AS role, mode IS NULL AS defaulted
FROM (SELECT task_id, path, last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id, path ORDER BY seq) AS mode
  FROM (SELECT t.run_id, t.task_id, t.seq, k.val AS path, max_by(mark, pos) FILTER (WHERE mark IS NOT NULL) AS mark
    FROM wf_token k JOIN wf_task t ON t.task_id = k.task_id GROUP BY t.run_id, t.task_id, t.seq, k.val))"""),
    "wf_own_file": (["wf_port", "wf_stream", "wf_mode"], """
SELECT task_id, role, path, false AS defaulted FROM wf_port WHERE path NOT LIKE 'part/%'
UNION ALL SELECT task_id, role, path, defaulted FROM wf_mode
UNION ALL SELECT task_id, 'output', output1, false FROM wf_stream WHERE output1 IS NOT NULL
UNION ALL SELECT task_id, 'output', output2, false FROM wf_stream WHERE output2 IS NOT NULL"""),
    "wf_file": (["wf_own_file", "wf_first_pipe"], """
SELECT task_id, role, path, bool_and(defaulted) AS mode_defaulted
FROM (SELECT * FROM wf_own_file
  UNION ALL SELECT p.task_id, f.role, f.path, f.defaulted FROM wf_own_file f JOIN wf_first_pipe p ON f.task_id = p.right_task_id)
GROUP BY task_id, role, path"""),
    "wf_pool": ([], """
SELECT DISTINCT o_orderpriority AS label, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS cpu,
  concat(substr(o_orderpriority, 1, 1), 'G') AS mem FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT 'extra', CAST(8 AS BIGINT), '512M'"""),
    "wf_staged": (["wf_task"], """
SELECT run_id, task_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq + task_id % 5, task_id) AS BIGINT) AS staged_pos
FROM wf_task WHERE state <> 'pending'"""),
    "wf_matrix_line": ([], """
SELECT CAST(c_custkey // 500 AS BIGINT) AS matrix_id, c_custkey AS row_id, c_custkey, c_mktsegment AS c0,
  CASE WHEN c_acctbal < 0 THEN 'false' WHEN c_custkey % 3 = 0 THEN 'TRUE' ELSE '#True' END AS c1,
  concat(c_name, ' n', CAST(c_nationkey AS STRING)) AS c2, concat('b', CAST(c_custkey AS STRING)) AS c3, 'false' AS c4
FROM customer"""),
    "wf_argv": (["wf_matrix_line"], """
SELECT matrix_id, row_id, concat_ws(' ', '--segment', c0,
  CASE c1 WHEN 'TRUE' THEN '--dry' WHEN '#True' THEN '--dry True' END, '--inputs', c2, 'false', c3) AS argv
FROM wf_matrix_line"""),
    "wf_attempt": ([], """
SELECT user_id % 15 AS run_id, event_id AS task_id, event_type AS pool, ts AS start_ts,
  ts + to_minutes(CAST(floor(value) AS INT) + 1) AS end_ts FROM events"""),
    "wf_log": ([], """
SELECT user_id % 15 AS run_id, event_id AS line_no, date_trunc('second', ts) AS ts, 'wf.main' AS logger,
  concat('task_', CAST(user_id AS STRING)) AS task, event_type,
  CASE event_type WHEN 'signup' THEN ' assigned to executor small, task id 1' WHEN 'view' THEN ' staged to run'
    WHEN 'click' THEN ' finished running' WHEN 'error' THEN ' failed during execution'
    ELSE ' did not produce expected outputs' END AS said FROM events"""),
    "wf_registry_change": ([], """
SELECT CASE WHEN event_id % 11 = 0 THEN 'system_record' ELSE 'pipeline_record' END AS type, concat('p', CAST(user_id % 40 AS STRING)) AS name,
  CASE event_type WHEN 'signup' THEN 'install' WHEN 'purchase' THEN 'configure' ELSE 'uninstall' END AS op,
  ts AS changed_at, event_id AS seq FROM events WHERE event_type IN ('signup', 'purchase', 'error')"""),
    "wf_capture": ([], """
SELECT doc_id AS task_id, CASE WHEN doc_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS content FROM documents"""),
    "wf_candidate": ([], """
SELECT c_custkey AS pipeline_id, CASE c_custkey % 3 WHEN 0 THEN 'basic-threads-4' WHEN 1 THEN 'broken.py' END AS cmd_line,
  CASE WHEN c_custkey % 5 < 2 THEN 'basic-threads-8' WHEN c_custkey % 5 = 2 THEN 'missing.py' END AS pipeline_config,
  CASE WHEN c_custkey % 7 = 0 THEN 'developer-default' END AS pipeline_default,
  CASE WHEN c_nationkey < 5 THEN 'fail' ELSE 'use_package_default' END AS no_config_behavior FROM customer"""),
    "wf_setting_change": ([], """
SELECT s_suppkey AS change_id, CASE s_suppkey % 3 WHEN 0 THEN 'delete_temporary_files' WHEN 1 THEN 'no_parsl_config_behavior' ELSE 'unknown_key' END AS setting_key,
  CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'fail' ELSE 'use_package_default' END AS setting_value FROM supplier"""),
    "wf_package": ([], """
SELECT p_partkey % 50 AS pipeline_id, concat(lower(p_type), '=', CAST(p_size AS STRING)) AS tag, p_brand AS config_key,
  CASE WHEN p_partkey % 3 = 0 THEN concat('share/', p_name, '.jar') END AS executable_path FROM part"""),
    "wf_answer": ([], """
SELECT c_custkey AS answer_id, CASE c_custkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'path' ELSE 'radio' END AS q_type,
  'q' || (c_custkey % 4) AS question, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS answer, 'BUILDING' AS default_value, c_nationkey = 3 AS ignored FROM customer"""),
}


def using(views: str, sql: str, recursive: str = "") -> str:
    """``sql`` prefixed by the named views and everything they are built on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        visit(name)
    parts = [f"{name} AS ({VIEWS[name][1].strip()}\n)" for name in ordered]
    if recursive:
        return "WITH RECURSIVE " + ",\n".join([*parts, recursive.strip()]) + "\n" + sql.strip()
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
