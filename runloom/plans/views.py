"""The workflow tables as views of the given parquet tables, so that Spark and the checking
SQL start from the same rows.  Orders act as tasks, customers as runs, line items as
parameters and redirects, events as log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.functions.ordered import rank_by_size
from runloom.session import stored


class Views:
    """Lazily built views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _table(self, name: str) -> DataFrame:
        """A ranked view as a table of its own: a real history has the rank stored, and a view
        that is read several times would be ranked several times."""
        if name not in self._tables:
            self._tables[name] = stored(getattr(self, f"_{name}")(), name)[0]
        return self._tables[name]

    # --- workflow -------------------------------------------------------------------------

    def task(self) -> DataFrame:
        return self._table("task_ranked")

    def _places(self) -> DataFrame:
        """``run_id, task_id, seq`` alone, for those who need no more of the tasks; taken from them if they are there already."""
        if "task_ranked" in self._tables:
            return self.task().select("run_id", "task_id", "seq")
        return self._table("task_places")

    def _task_places(self) -> DataFrame:
        return self._in_order().select("run_id", "task_id", "seq")

    def _in_order(self, *columns: str) -> DataFrame:
        """The tasks of each run with their place by date and id, and further columns."""
        orders = self.base("orders").select(
            F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task_id"), "o_orderdate", *columns)
        return rank_by_size(
            orders, ["run_id"], ["o_orderdate", "task_id"],
            [F.col("o_orderdate"), F.floor(F.col("task_id") / 1_000_000)], "seq",
        )

    def _task_ranked(self) -> DataFrame:
        ranked = self._in_order("o_orderpriority", "o_orderstatus")
        task = F.col("task_id")
        return ranked.select(
            "run_id", "task_id", "seq",
            F.when(task % 4 == 0, "python").otherwise("bash").alias("kind"),
            F.col("o_orderpriority").alias("pool"),
            F.expr("CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'pending' END").alias("state"),
            (1 + task % 9).alias("duration_s"),
            (task % 5 == 0).alias("tmp_output"),
        )

    def port(self) -> DataFrame:
        """What is declared beside the parameters, and all distinct parts of the order as external inputs."""
        # dealt by order first, so that neither the distinct parts nor the join with the orders need a shuffle of their own
        lines = self.base("lineitem").select(F.col("l_orderkey").alias("task_id"), "l_partkey")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = lines.where("task_id IS NOT NULL").repartition(n, "task_id").distinct()
        runs = self.base("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task_id"))
        external = parts.join(runs, "task_id").select(
            "run_id", "task_id", F.lit("input").alias("role"),
            F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"),
        )
        return self.declared_port().unionByName(external)

    def declared_port(self) -> DataFrame:
        """Outputs, inputs from the parent in a binary heap, and waits on the task two places before."""
        out = self.task_rows().select(
            "run_id", "task_id", F.lit("output").alias("role"),
            F.concat(F.lit("out/"), F.col("task_id").cast("string")).alias("path"),
        )
        tasks = self._places()
        before = tasks.select("run_id", "seq", F.col("task_id").alias("other"))
        # both links of a task by one join
        links = tasks.select("run_id", "task_id", F.explode(F.expr(
            "array(IF(seq > 1, struct('input' AS role, floor(seq / 2) AS seq), NULL), IF(seq % 3 = 0, struct('wait_on' AS role, seq - 2 AS seq), NULL))"
        )).alias("link")).select("run_id", "task_id", "link.role", "link.seq")
        return out.unionByName(links.join(before, ["run_id", "seq"]).select(
            "run_id", "task_id", "role",
            F.expr("concat(IF(role = 'input', 'out/', ''), CAST(other AS STRING))").alias("path")))

    def manifest(self) -> DataFrame:
        return self.task_rows().where("state = 'completed' AND task_id % 7 <> 0").select(
            F.concat(F.lit("out/"), F.col("task_id").cast("string")).alias("path")
        )

    def task_rows(self) -> DataFrame:
        """Tasks where their order does not matter: no ranking, no shuffle."""
        return self.base("orders").select(
            F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task_id"),
            F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'python' ELSE 'bash' END").alias("kind"),
            F.col("o_orderpriority").alias("pool"),
            F.expr("CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'pending' END").alias("state"),
            (1 + F.col("o_orderkey") % 9).alias("duration_s"),
            (F.col("o_orderkey") % 5 == 0).alias("tmp_output"),
        )

    def program(self) -> DataFrame:
        return self.task().select(
            "run_id", "task_id", "seq", "kind",
            F.expr("CASE WHEN kind = 'python' THEN concat('step', substr(pool, 1, 1)) ELSE pool END").alias("name"),
            F.expr("CASE WHEN task_id % 3 <> 0 THEN concat('/opt/tools/', lower(pool), ' v2') END").alias("path"),
            F.expr("CASE WHEN task_id % 6 = 1 THEN 'sort' END").alias("subprogram"),
            F.expr("CASE WHEN task_id % 10 = 1 THEN concat('step ', CAST(task_id AS STRING)) END").alias("action"),
            F.expr("CASE WHEN task_id % 2 = 0 THEN array('0', '1', '128') END").alias("success_on"),
            F.expr("map('executor', pool)").alias("meta"),
        )

    def software(self) -> DataFrame:
        return self._table("site_software")

    def _site_software(self) -> DataFrame:
        return self.base("orders").where("o_orderpriority <> '5-LOW'").select(
            F.col("o_orderpriority").alias("name"),
            F.concat(F.lit("/opt/site/"), "o_orderpriority").alias("path"),
        ).distinct()

    PLACE = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]

    def _items(self) -> DataFrame:
        """Line items with the run of their order."""
        runs = self.base("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("l_orderkey"))
        return self.base("lineitem").join(runs, "l_orderkey")

    def _items_ranked(self) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("run_id", "l_orderkey").orderBy(*self.PLACE)).cast("long")
        return self._items().withColumn("pos", place).select(
            "run_id", "l_orderkey", "pos", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")

    def _tokens(self, ranked: bool) -> DataFrame:
        """Line items as parts of a command.  Their place is a structure that sorts, so that none has to be ranked; queries that read
        them several times take it ``ranked``, as a number from a stored table, and leave the columns behind that only sort."""
        items = self._table("items_ranked") if ranked else self._items().withColumn("pos", F.struct(*self.PLACE))
        return items.select(
            "run_id", F.col("l_orderkey").alias("task_id"), "pos",
            F.concat(F.lit("--"), "l_returnflag").alias("flag"),
            F.concat(F.lit("ref/"), (F.col("l_partkey") % 40).cast("string")).alias("val"),
            F.expr("CASE l_returnflag WHEN 'A' THEN 'input' WHEN 'R' THEN 'output' ELSE 'unmarked' END").alias("mark"),
            F.expr("CASE WHEN l_linestatus = 'F' THEN '=' ELSE ' ' END").alias("sep"),
            (F.col("l_suppkey") % 3).alias("stream"),
            F.concat(F.lit("log/"), F.col("l_partkey").cast("string")).alias("dest"),
            (F.col("l_linenumber") % 2 == 0).alias("is_data"),
        )

    def param(self, ranked: bool = False) -> DataFrame:
        """A flag and a file each, which is marked as input, as output or not at all."""
        return self._tokens(ranked).select(
            "run_id", "task_id", "pos", F.array("flag", "val").alias("tokens"), F.array(F.lit(None), "mark").alias("marks"), "sep")

    def redirect(self, ranked: bool = False) -> DataFrame:
        return self._tokens(ranked).select("run_id", "task_id", "pos", "stream", "dest", "is_data")

    def pipe(self) -> DataFrame:
        tasks = self.task().select("run_id", "task_id", "seq")
        left = tasks.where("seq % 4 = 0").select(
            "run_id", "task_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("pos"), "seq"
        ).select("run_id", "task_id", "pos", (F.col("seq") + F.col("pos")).alias("seq"))
        right = tasks.withColumnRenamed("task_id", "right_task_id")
        return left.join(right, ["run_id", "seq"]).select("run_id", "task_id", "pos", "right_task_id")

    def pool(self) -> DataFrame:
        """Stored, so that the planner sees how small the site's configuration is."""
        return self._table("site_pool")

    def _site_pool(self) -> DataFrame:
        known = self.base("orders").where("o_orderpriority <> '5-LOW'").select("o_orderpriority").distinct()
        return known.select(
            F.col("o_orderpriority").alias("label"),
            F.substring("o_orderpriority", 1, 1).cast("long").alias("cpu"),
            F.concat(F.substring("o_orderpriority", 1, 1), F.lit("G")).alias("mem"),
        ).unionByName(self.spark.range(1).select(
            F.lit("extra").alias("label"), F.lit(8).cast("long").alias("cpu"), F.lit("512M").alias("mem")
        ))

    def staged(self) -> DataFrame:
        return self._table("staged_order")

    def _staged_order(self) -> DataFrame:
        tasks = self.task().where("state <> 'pending'").select(
            "run_id", "task_id", (F.col("seq") + F.col("task_id") % 5).alias("turn")
        )
        return rank_by_size(
            tasks, ["run_id"], ["turn", "task_id"], [F.floor(F.col("turn") / 100_000)], "staged_pos"
        ).drop("turn")

    def artifact_use(self) -> DataFrame:
        """Uses of files in order: made, then read; every fifth output is temporary."""
        tasks = self.task().select("run_id", "task_id", "seq", "tmp_output")
        return self.port().where("role <> 'wait_on'").join(tasks, ["run_id", "task_id"]).select(
            "run_id", "path", F.struct(F.col("seq"), F.col("task_id"), F.col("role")).alias("seq"),
            F.col("role").alias("mode"), (F.col("tmp_output") & (F.col("role") == "output")).alias("tmp"),
        )

    # --- runs -----------------------------------------------------------------------------

    MATRIX_ROWS_PER_FILE = 500

    def matrix_line(self) -> DataFrame:
        """Lines of many matrices; line -1 of each is its header."""
        return self.matrix_header().unionByName(self.matrix_body())

    def matrix_body(self) -> DataFrame:
        return self.base("customer").select(
            F.floor(F.col("c_custkey") / self.MATRIX_ROWS_PER_FILE).alias("matrix_id"),
            F.col("c_custkey").alias("row_id"),
            F.concat_ws(
                "\t", "c_mktsegment",
                F.expr("CASE WHEN c_acctbal < 0 THEN 'false' WHEN c_custkey % 3 = 0 THEN 'TRUE' ELSE '#True' END"),
                F.concat("c_name", F.lit(" n"), F.col("c_nationkey").cast("string")),
                F.concat(F.lit("b"), F.col("c_custkey").cast("string")), F.lit("false"),
            ).alias("line"),
        )

    def matrix_header(self) -> DataFrame:
        return self._table("matrix_headers")

    def _matrix_headers(self) -> DataFrame:
        return self.matrix_body().select("matrix_id").distinct().select(
            "matrix_id", F.lit(-1).cast("long").alias("row_id"),
            F.lit("\t".join(["--segment", "--dry", "--inputs", "positional_1", "positional_0"])).alias("line"),
        )
    def attempt(self) -> DataFrame:
        return self.base("events").select(
            (F.col("user_id") % 15).alias("run_id"), F.col("event_id").alias("task_id"),
            F.col("event_type").alias("pool"), F.col("ts").alias("start_ts"),
            F.expr("timestampadd(MINUTE, CAST(floor(value) AS INT) + 1, ts)").alias("end_ts"),
        )

    def log_line(self) -> DataFrame:
        """Stored, because the optimizer would otherwise repeat the making of a line in every
        expression that parses it."""
        return self._table("log_text")

    def _log_text(self) -> DataFrame:
        return self.base("events").select(
            (F.col("user_id") % 15).alias("run_id"), F.col("event_id").alias("line_no"),
            F.expr(
                "concat('[', date_format(ts, 'ddMMMyyyy HH:mm:ss'), '|wf.main] > task_', CAST(user_id AS STRING),"
                " CASE event_type WHEN 'signup' THEN ' assigned to executor small, task id 1'"
                " WHEN 'view' THEN ' staged to run' WHEN 'click' THEN ' finished running'"
                " WHEN 'error' THEN ' failed during execution' ELSE ' did not produce expected outputs' END)"
            ).alias("line"),
        )

    def capture(self) -> DataFrame:
        return self.base("documents").select(
            F.col("doc_id").alias("task_id"),
            F.when(F.col("doc_id") % 2 == 0, "stdout").otherwise("stderr").alias("stream"),
            F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")).alias("content"),
        )

    # --- configuration --------------------------------------------------------------------

    def site_config(self) -> DataFrame:
        """One nested configuration per customer: a site's answers for its nation's template."""
        # A small file would be parsed in one task; as many tasks as a shuffle has, because the number of bytes says nothing of the work.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sites = self.base("customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(n, "c_custkey")
        joined = sites.join(self.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("config_id"),
            F.expr(
                """concat('{"', n_name, '":{"path":"/site/', CAST(c_custkey AS STRING),
                '","threads":{"q_type":"', CASE WHEN c_custkey % 7 = 0 THEN 'radio' ELSE 'list' END,
                '","message":"n","default":"', CAST(c_nationkey AS STRING), '"',
                CASE WHEN c_custkey % 4 = 0 THEN ',"always_default":"x"' ELSE '' END,
                '}},"shared":{"deep":{"ref_path":"', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('/ref/', c_mktsegment) END,
                '"}', CASE WHEN c_custkey % 11 = 0 THEN ',"count":3' ELSE '' END, '}}')"""
            ).alias("json"),
        )

    def registry_change(self) -> DataFrame:
        return self.base("events").where("event_type IN ('signup', 'purchase', 'error')").select(
            F.expr("CASE WHEN event_id % 11 = 0 THEN 'system_record' ELSE 'pipeline_record' END").alias("type"),
            F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("name"),
            F.expr("CASE event_type WHEN 'signup' THEN 'install' WHEN 'purchase' THEN 'configure' ELSE 'uninstall' END").alias("op"),
            F.col("ts").alias("changed_at"), F.col("event_id").alias("seq"),
        )

    def candidate(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").alias("pipeline_id"),
            F.expr("CASE c_custkey % 3 WHEN 0 THEN 'basic-threads-4' WHEN 1 THEN 'broken.py' END").alias("cmd_line"),
            F.expr("CASE WHEN c_custkey % 5 < 2 THEN 'basic-threads-8' WHEN c_custkey % 5 = 2 THEN 'missing.py' END").alias("pipeline_config"),
            F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'developer-default' END").alias("pipeline_default"),
            F.expr("CASE WHEN c_nationkey < 5 THEN 'fail' ELSE 'use_package_default' END").alias("no_config_behavior"),
        )

    def setting_change(self) -> DataFrame:
        return self.base("supplier").select(
            F.col("s_suppkey").alias("change_id"),
            F.expr(
                "CASE s_suppkey % 3 WHEN 0 THEN 'delete_temporary_files' WHEN 1 THEN 'no_parsl_config_behavior'"
                " ELSE 'unknown_key' END"
            ).alias("setting_key"),
            F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'fail' ELSE 'use_package_default' END").alias("setting_value"),
        )

    def package(self) -> DataFrame:
        return self.base("part").select(
            (F.col("p_partkey") % 50).alias("pipeline_id"), F.col("p_partkey").alias("seq"),
            F.concat(F.lower("p_type"), F.lit("="), F.col("p_size").cast("string")).alias("tag"),
            F.col("p_brand").alias("config_key"),
            F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('share/', p_name, '.jar') END").alias("executable_path"),
        )

    def answer(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").alias("answer_id"),
            F.expr("CASE c_custkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'path' ELSE 'radio' END").alias("q_type"),
            F.concat(F.lit("q"), F.expr("CAST(c_custkey % 4 AS STRING)")).alias("question"),
            F.expr("CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END").alias("answer"),
            F.lit("BUILDING").alias("default_value"), (F.col("c_nationkey") == 3).alias("ignored"),
        )
