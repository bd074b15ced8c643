"""What keeps shuffles and tasks small: same rows by less work, on rows made here."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from runloom.functions import ordered
from runloom.operators import graph, manifest
from runloom.plans.views import Views


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    prepared = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange") + prepared.count("Exchange ")


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    """Orders of five customers and one unknown; lines of an order share numbers, so that later columns decide."""
    at = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(2024, 1, 1)
    orders = [(k, None if k % 11 == 0 else k % 5, "OFP"[k % 3], 1.0, day + datetime.timedelta(days=k % 7), f"{1 + k % 5}-LOW") for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    lines = [(k % 60, (k * 7) % 45, k % 9, None if k % 17 == 0 else k % 2, 1.0 * (k % 3), 2.0, 0.1, 0.2, "ARN"[k % 3], "FO"[k % 2], day) for k in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
                          " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, k % 3, "BUILDING") for k in range(40)], "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(k, f"n{k}") for k in range(3)], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    return Views(spark, str(at))


@pytest.mark.parametrize("group_rows", [0, 10, 11, 1000])
def test_rank_by_size(views, group_rows):
    table = views.base("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    given = table, ["o_custkey"], ["o_orderdate", "o_orderkey"], [F.col("o_orderdate")], "n"
    assert bag(ordered.rank_by_size(*given, group_rows)) == bag(ordered.row_rank(*given))


def test_tasks_are_ranked_without_a_join(views):
    assert "Join" not in views._task_ranked()._jdf.queryExecution().optimizedPlan().toString()


def test_ranked_parts_of_commands(views):
    assert bag(manifest.render_arguments(views.param())) == bag(manifest.render_arguments(views.param(ranked=True)))
    assert bag(manifest.redirect_resolve(views.redirect())) == bag(manifest.redirect_resolve(views.redirect(ranked=True)))
    plan = views.param(ranked=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_tax" not in plan


@pytest.mark.parametrize("width", [1, 3, 12])
def test_modes_of_long_and_short_runs(views, monkeypatch, width):
    whole = bag(manifest.file_modes(views.task(), views.param()))
    monkeypatch.setattr(manifest, "SLICE", width)
    assert bag(manifest.file_modes(views.task(), views.param())) == whole


def test_files_are_counted_where_they_lie(views):
    files = manifest.task_files(views.declared_port(), views.redirect(), views.pipe())
    assert exchanges(files.groupBy("run_id", "task_id").count()) == exchanges(files)


@pytest.mark.parametrize("operator", [graph.critical_path, graph.cyclic_tasks])
def test_dependencies_are_found_once(spark, operator):
    """Tasks 0 to 8 in a chain, and 9 and 10 around each other."""
    pairs = [(1, k + 1, k) for k in range(8)] + [(1, 9, 10), (1, 10, 9)]
    found = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            found.add(len(batch))
            yield batch

    links = spark.createDataFrame(pairs, "run_id long, task_id long, depends_on long")
    tasks = spark.createDataFrame([(1, k, 1) for k in range(11)], "run_id long, task_id long, duration_s long")
    done = operator(tasks, links.mapInPandas(count, links.schema)).collect()
    assert len(done) == (9 if operator is graph.critical_path else 2)
    assert found.value == len(pairs)


def test_a_small_file_of_sites_is_parsed_by_many_tasks(spark, views):
    sites = views.site_config()
    assert sites.count() == 40
    assert sites.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_long_groups(spark, monkeypatch):
    """Null is a group; a full bucket holds short groups as well."""
    keys = [None] * 12 + [1] * 11 + [2] * 10 + [k for k in range(3, 40) for _ in range(k % 5)]
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    for buckets in (1, 3, ordered.BUCKETS):
        monkeypatch.setattr(ordered, "BUCKETS", buckets)
        for rows, want in ((10, [None, 1]), (11, [None]), (12, []), (1000, [])):
            found, n = ordered.long_groups(table, ["k"], rows)
            assert sorted([r["k"] for r in found.collect()], key=str) == sorted(want, key=str) and n == len(want)


def test_no_group_is_counted_where_no_bucket_is_full(spark, monkeypatch):
    labels = []
    real = ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, label, *c: (labels.append(label), real(df, label, *c))[1])
    assert ordered.long_groups(spark.range(1000), ["id"], 100)[1] == 0 and labels == ["full-buckets"]


def test_links_of_sub_workflows_are_stored_without_a_join(spark, rows, monkeypatch):
    """Repeats, links of unknown tasks, of a task to itself and without a run change no part."""
    plans = {}
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label, *c: (
        plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}), real(df, label, *c))[1])
    tasks = spark.createDataFrame([(r, t) for r in (1, 2, None) for t in range(6)], "run_id long, task_id long")
    links = [(1, 1, 0), (1, 1, 0), (1, 2, 99), (1, 99, 3), (1, 4, 4), (1, 5, 1), (2, 5, 3), (2, 3, 2), (3, 1, 0), (None, 1, 0)]
    links = spark.createDataFrame(links, "run_id long, task_id long, depends_on long")
    want = {(r, t, {(1, 1): 0, (1, 5): 0, (2, 3): 2, (2, 5): 2}.get((r, t), t)) for r in (1, 2, None) for t in range(6)}
    assert rows(graph.sub_workflows(tasks, links), "run_id", "task_id", "component") == want
    assert "Join" not in plans["links"] and "Aggregate" not in plans["links"]
    assert rows(graph.sub_workflows(tasks, links, 4), "run_id", "task_id", "component") == want


def test_ids_are_not_rounded(spark, rows):
    """Ids beyond 2**53 and text, some null."""
    big = 2 ** 60
    tasks = spark.createDataFrame([(1, big + t) for t in range(4)], "run_id long, task_id long")
    links = spark.createDataFrame([(1, big + 3, big + 1)], "run_id long, task_id long, depends_on long")
    assert rows(graph.sub_workflows(tasks, links), "task_id", "component") == {(big + t, big + (1 if t == 3 else t)) for t in range(4)}
    tasks = spark.createDataFrame([("r", t) for t in ("b", "a", None, "c")], "run_id string, task_id string")
    links = spark.createDataFrame([("r", "c", "b")], "run_id string, task_id string, depends_on string")
    assert rows(graph.sub_workflows(tasks, links), "task_id", "component") == {("a", "a"), ("b", "b"), ("c", "b"), (None, None)}


def test_ports_take_few_shuffles(spark, views, monkeypatch):
    """Line items are shuffled once to be told apart and joined, tasks once for both of their links; the ports rank no more than they need."""
    fresh = Views(spark, views.sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fresh.port()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4
    assert "task_places" in fresh._tables and "task_ranked" not in fresh._tables
    fresh = Views(spark, views.sf_dir)
    fresh.task()
    fresh.port()
    assert "task_places" not in fresh._tables
