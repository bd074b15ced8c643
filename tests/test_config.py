from __future__ import annotations

import json
from datetime import datetime

import pytest

from runloom.operators import config, pools
from runloom.sources import sinks, text

TREE = {
    "STAR": {"path": "Full path to STAR", "sjdb_overhang": {"q_type": "list", "message": "?", "choices": ["4", "8", "95"]}},
    "wget": {"path": "Full path to wget"},
    "ersatz": {"path": {"q_type": " PATH ", "message": "Full path to ersatz", "default": "/x"}},
    "plain": "Text", "Reference_Path": "A path",
}


def parsed(spark, *texts):
    return config.parse_config(spark.createDataFrame(list(enumerate(texts)), "config_id long, json string"))


def test_flatten(spark, rows):
    leaves = config.config_flatten(parsed(spark, json.dumps(TREE)))
    assert rows(leaves, "name", "leaf_type", "value", "default_value") == {
        ("root__STAR__path", "Path", "Full path to STAR", None), ("root__STAR__sjdb_overhang", "List", None, None),
        ("root__wget__path", "Path", "Full path to wget", None), ("root__ersatz__path", "Path", None, "/x"),
        ("root__plain", "Text", "Text", None), ("root__Reference_Path", "Path", "A path", None),
    }


def test_errors(spark, rows):
    bad = {"a": {"b": 3, "c": {"q_type": "radio"}, "d": None, "e": ["x"], "f": True}, "ok": "x", "none": {}}
    got = rows(config.config_errors(config.config_flatten(parsed(spark, json.dumps(bad), '"text"', "[1]", "{"))))
    assert got == {
        (0, "root__a__b", "unknown object"), (0, "root__a__c", "bad q_type"), (0, "root__a__d", "unknown object"),
        (0, "root__a__e", "unknown object"), (0, "root__a__f", "unknown object"),
        (1, "root", "outermost is not an object"), (2, "root", "outermost is not an object"),
    }


def test_root_may_hold_any_key(spark, rows):
    """A root member named like a question's type is a member, and braces in texts do not count as depth."""
    leaves = config.config_flatten(parsed(spark, '{"q_type": "x", "a": {"b": "{{{\\"}"}}'))
    assert rows(leaves, "name", "value", "error") == {("root__q_type", "x", None), ("root__a__b", '{{{"}', None)}


def test_round_trip(spark):
    deep: dict = {"leaf": "v"}
    for i in range(12):
        deep = {f"k{i}": deep, f"s__{i}": f"quote \" and \\ {i}"}
    docs = [{"a": {"b": {"c": "1", "d": "é\n"}}, "e": "2"}, deep]
    leaves = config.config_flatten(parsed(spark, *map(json.dumps, docs)))
    back = {r["config_id"]: json.loads(r["json"]) for r in config.config_inflate(leaves).collect()}
    assert back == dict(enumerate(docs))


def test_scan(spark, tmp_path, rows):
    (tmp_path / "good.json").write_text('{"a":\n "b"}')
    (tmp_path / "malformed.json").write_text('{"a: 1}')
    assert rows(text.config_scan(spark, str(tmp_path)), "config_id", "valid") == {("good.json", True), ("malformed.json", False)}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        text.config_scan(spark, str(tmp_path), strict=True).collect()
    sinks.config_sink(spark.createDataFrame([(1, '{"a":[true]}')], "config_id long, json string"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"]) == {"config_id": 1, "config": {"a": [True]}}


def test_overlay(spark, rows):
    leaves = config.config_flatten(parsed(spark, json.dumps({
        "a": "?", "b": {"q_type": "text", "default": "d"}, "c": {"q_type": "text", "default": "d", "always_default": 1}})))
    prior = spark.createDataFrame([(0, "root__a", ""), (0, "root__b", "p"), (0, "root__c", "p")], "config_id long, name string, value string")
    assert rows(config.config_overlay(leaves, prior), "name", "default_value") == {("root__a", None), ("root__b", "p"), ("root__c", "d")}


def test_cascade(spark, rows):
    cases = [
        ("basic-threads-4", "tiny.py", None), ("tiny.py", "tiny.py", None), ("malformed.json", "tiny.json", None),
        (None, "basic-threads-4", None), (None, "tiny.py", None), (None, "malformed.json", None), (None, None, None),
        (None, "", "own"), ("", None, "own"),
    ]
    table = spark.createDataFrame(
        [(i, *c, "use_package_default") for i, c in enumerate(cases)] + [(9, None, None, None, "fail")],
        "pipeline_id long, cmd_line string, pipeline_config string, pipeline_default string, no_config_behavior string")
    got = rows(config.config_cascade(table, spark.createDataFrame([("tiny.py",), ("tiny.py",)], "name string")))
    assert got == {
        (0, "basic-threads-4", "command line"), (1, "tiny.py", "command line"), (2, "basic-threads-2", "package default"),
        (3, "basic-threads-4", "pipeline config"), (4, "tiny.py", "pipeline config"), (5, "basic-threads-2", "package default"),
        (6, "basic-threads-2", "package default"), (7, "own", "pipeline default"), (8, "own", "pipeline default"), (9, None, "fail"),
    }


def test_software_paths(spark, rows):
    packages = spark.createDataFrame([
        (1, 1, "star", "STAR", None), (1, 2, "star=2.4.2a", "STAR", None), (1, 3, "picard=2", "picard", "share/picard.jar"),
    ], "pipeline_id long, seq long, tag string, config_key string, executable_path string")
    stored = spark.createDataFrame([(1, "STAR", "/old"), (1, "wget", "/usr/bin/wget")], "pipeline_id long, config_key string, path string")
    assert rows(config.software_path_inject(packages, "/envs", stored), "config_key", "path", "stored") == {
        ("STAR", "/envs/1/bin/star", "/old"), ("picard", "/envs/1/share/picard.jar", None), ("wget", "/usr/bin/wget", "/usr/bin/wget"),
    }


def test_registry(spark, rows):
    ops = [("a", "install"), ("a", "configure"), ("b", "install"), ("a", "uninstall"), ("a", "configure"), ("c", "install"),
           ("c", "configure"), ("c", "install"), ("d", "install"), ("d", "configure"), ("e", "configure")]
    kinds = [("pipeline_record", n, op) for n, op in ops] + [("system_record", "z", "install"), ("system_record", "b", "uninstall")]
    changes = spark.createDataFrame([(k, n, op, datetime(2024, 1, 1), i) for i, (k, n, op) in enumerate(kinds)],
                                    "type string, name string, op string, changed_at timestamp_ntz, seq long")
    current = config.registry_current(changes)
    assert rows(current, "name", "configured") == {("b", False), ("c", False), ("d", True)}
    assert [r["configured"] for r in config.registry_list(changes).collect()] == ["No", "No", "Yes"]
    files = spark.createDataFrame([("/p/b.py",), ("/p/a.py",), ("d.x.py",)], "path string")
    assert rows(config.installed_lookup(files, current), "path") == {("/p/b.py",)}


def test_settings_and_answers(spark, rows):
    changes = spark.createDataFrame([
        (1, "delete_temporary_files", "no"), (2, "delete_temporary_files", "maybe"), (3, "colour", "red"), (4, "delete_temporary_files", "yes"),
    ], "change_id long, setting_key string, setting_value string")
    assert rows(config.setting_validate(changes), "change_id", "outcome") == {(1, "set"), (2, "bad value"), (3, "bad key"), (4, "set")}
    assert rows(config.settings_current(changes)) == {("delete_temporary_files", "yes")}
    answers = spark.createDataFrame([
        (1, "a", "list", "8", "4", False), (2, "a", "list", "9", "4", False), (3, "a", "list", "", "4", False), (4, "t", "text", "", "d", False),
        (5, "r", "radio", "x", "d", False), (6, "a", "list", "9", "d", True), (7, "b", "list", "9", "4", False), (8, "b", "list", "8", "4", False),
    ], "answer_id long, question string, q_type string, answer string, default_value string, ignored boolean")
    rules = spark.createDataFrame([("a", ["4", "8"]), ("b", ["9"])], "question string, choices array<string>")
    assert rows(config.answer_validate(answers, rules)) == {
        (1, "8", "answered"), (2, "9", "not a choice"), (3, "4", "default"), (4, "d", "default"), (5, "x", "bad q_type"), (6, "d", "ignored"),
        (7, "9", "answered"), (8, "8", "not a choice"),
    }


POOL = "label string, cpu long, mem string"
SMALL, MED, LARGE = ("small", 1, "1G"), ("med", 2, "2G"), ("large", 3, "3G")


@pytest.mark.parametrize("labels, configured, match, assigned", [
    ([], [SMALL], "single/single", ["all"] * 4),
    ([], [SMALL, MED], "single/multi", ["all"] * 4),
    (["small", "med", "large"], [SMALL], "multi/single", ["all"] * 4),
    (["small", "med", "large"], [SMALL, MED, LARGE], "perfect", ["small", "med", "large", "all"]),
    (["small", "med", "large"], [SMALL, LARGE], "some", ["small", "all", "large", "all"]),
    (["small", "med", "large"], [SMALL, MED, LARGE, ("x", 1, "1G")], "some", ["small", "med", "large", "all"]),
    (["small", "med", "large"], [("x", 1, "1G"), ("y", 1, "1T")], "none", ["all"] * 4),
])
def test_pools(spark, rows, labels, configured, match, assigned):
    defined = spark.createDataFrame([(x,) for x in labels], "label string")
    pool = spark.createDataFrame(configured, POOL)
    tasks = spark.createDataFrame([(1, 1, "small", None), (1, 2, "med", "small"), (1, 3, None, "large"), (1, 4, None, None)],
                                  "run_id long, task_id long, executor string, site string")
    assert rows(pools.pool_match_report(defined, pool), "match") == {(match,)}
    assert rows(pools.pool_assignment(tasks, pool, defined), "task_id", "assigned") == set(enumerate(assigned, 1))
    if match == "perfect":
        got = rows(pools.pool_assignment(tasks, pool, defined, "large"), "task_id", "assigned")
        assert (4, "large") in got
        assert (4, "all") in rows(pools.pool_assignment(tasks, pool, defined, "x"), "task_id", "assigned")


def test_inflate_gives_back_what_was_flattened(spark):
    """Numbers, truth values, arrays, nulls and whole questions keep their type through both ways."""
    given = {
        1: {"a": {"b": 1, "c": 2.5, "d": True, "e": None, "f": [1, "x", {"g": None}]}, "t": "1", "e\"s": "é\n", "__": {"_": "x"}},
        2: {"q": {"q_type": "list", "message": "m?", "choices": ["a", "b"], "default": 3, "always_default": False, "nested": {"x": [0]}}, "deep": {"r": {"s": -0.125}}},
        3: {},
    }
    trees = config.parse_config(spark.createDataFrame([(i, json.dumps(c)) for i, c in given.items()], "config_id long, json string"))
    got = {r["config_id"]: json.loads(r["json"]) for r in config.config_inflate(config.typed_leaves(trees)).collect()}
    assert got == {i: c for i, c in given.items() if c}
    attributes = config.question_attributes(trees)
    assert {(r["name"], r["attribute"]): json.loads(r["json"]) for r in attributes.collect()} == {("root__q", k): v for k, v in given[2]["q"].items()}
    assert [tuple(r) for r in config.question_rules(attributes).collect()] == [(2, "root__q", ["a", "b"])]


def test_choices_hold_for_one_configuration(spark, rows):
    """Two configurations with one question name and different choices; rules that repeat do not multiply answers."""
    answers = spark.createDataFrame(
        [(1, 1, "q", "list", "a", None, False), (2, 2, "q", "list", "a", None, False), (3, 3, "q", "list", "z", None, False), (4, 1, "q", "list", "c", None, False)],
        "answer_id long, config_id long, question string, q_type string, answer string, default_value string, ignored boolean")
    rules = spark.createDataFrame([(1, "q", ["a", "b"]), (1, "q", ["a", "b"]), (2, "q", ["b"]), (3, "q", None)], "config_id long, question string, choices array<string>")
    assert rows(config.answer_validate(answers, rules), "answer_id", "status") == {(1, "answered"), (2, "not a choice"), (3, "answered"), (4, "not a choice")}
    assert rows(config.answer_validate(answers, rules.drop("config_id")), "answer_id", "status") == {(1, "answered"), (2, "answered"), (3, "not a choice"), (4, "not a choice")}
