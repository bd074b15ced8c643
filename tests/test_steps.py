from __future__ import annotations

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from runloom.operators import steps
from runloom.plans import catalog


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(f"{'hit' if i % 3 == 0 else 'miss'} {i}",) for i in range(30_000)], "line string").repartition(6).cache()


@pytest.mark.parametrize("parts", [1, 7])
def test_accepted_codes(lines, parts):
    found = steps.pipe_through(lines.repartition(parts), ["grep", "-F", "hit"], ["0", "1"]).cache()
    assert found.where("source = 'stdout'").count() == 10_000
    status = found.where("source = 'status'").collect()
    assert len(status) == parts and {(r["exit_code"], r["accepted"]) for r in status} == {(0, True)}


def test_rejected_code_fails(lines):
    with pytest.raises(PySparkException, match="ended with 1"):
        steps.pipe_through(lines, ["grep", "-F", "nowhere"]).collect()
    row = steps.pipe_through(lines.coalesce(1), ["grep", "-F", "nowhere"], on_error="row").collect()
    assert [(r["source"], r["exit_code"], r["accepted"]) for r in row] == [("status", 1, False)]


def test_streams_and_chain(spark, lines):
    one = lines.coalesce(1)
    both = steps.pipe_through(one, ["sh", "-c", "cat >/dev/null; echo out; echo err >&2; exit 3"], ["3"]).collect()
    # the streams are read side by side; the status comes last
    assert {(r["source"], r["line"], r["exit_code"]) for r in both} == {("stdout", "out", None), ("stderr", "err", None), ("status", None, 3)}
    assert both[-1]["source"] == "status" and len(both) == 3
    chain = steps.pipe_through(one, [["grep", "hit"], ["wc", "-l"]]).where("source = 'stdout'").collect()
    assert [int(r["line"]) for r in chain] == [10_000]


def test_program_that_stops_reading(lines):
    got = steps.pipe_through(lines.coalesce(1), ["head", "-n", "2"]).where("source = 'stdout'").collect()
    assert len(got) == 2


def test_empty_partitions_run_nothing(spark, lines):
    assert steps.pipe_through(lines.where("line = ''"), ["false"]).collect() == []


def test_python_step(lines):
    def double(batch: pd.DataFrame, times: int) -> pd.DataFrame:
        import re  # an import inside the function works, one outside would too
        return pd.DataFrame({"n": batch["line"].map(lambda v: times * int(re.search(r"\d+", v).group()))})

    total = steps.python_step(lines, double, "n long", times=2).groupBy().sum().first()[0]
    assert total == 30_000 * 29_999


def test_combine_hot_key(lines):
    def partial(batch):
        kind = batch["line"].str.split(" ").str[0]
        return pd.DataFrame({"kind": kind, "n": 1}).groupby("kind", as_index=False).sum()

    def merge(rows):
        return rows.groupby("kind", as_index=False).sum()

    got = steps.python_combine(lines, ["kind"], partial, merge, "kind string, n long", fan_in=2).collect()
    assert {tuple(r) for r in got} == {("hit", 10_000), ("miss", 20_000)}


def test_output_contract(spark, rows):
    ports = spark.createDataFrame([(1, "a", "output", "x"), (1, "a", "output", "y"), (1, "b", "output", "z"), (1, "b", "output", "")],
                                  "run_id long, task_id string, role string, path string")
    seen = spark.createDataFrame([("x",), ("z",), ("z",)], "path string")
    assert rows(steps.output_contract(ports, seen), "task_id", "n_declared", "n_missing", "kept") == {("a", 2, 1, False), ("b", 1, 0, True)}
    with pytest.raises(FileNotFoundError, match="y"):
        steps.require_outputs(ports, seen)
    steps.require_outputs(ports.where("task_id = 'b'"), seen)


def test_python_table(spark, rows):
    """Any number of rows for one, joined to the columns of the row they came from."""
    def letters(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"letter": batch["word"].map(list).explode().dropna()})

    words = spark.createDataFrame([(1, "ab"), (2, ""), (3, "c")], "id long, word string").repartition(2)
    assert rows(steps.python_table(words, letters, "letter string", ["id"])) == {(1, "a"), (1, "b"), (3, "c")}


def test_much_standard_error(lines):
    """Both streams are read while the program runs, however much it writes to either."""
    script = "while read -r x; do echo out; echo err >&2; done"
    found = steps.pipe_through(lines.coalesce(1), ["sh", "-c", script]).groupBy("source").count().collect()
    assert {tuple(r) for r in found} == {("stdout", 30_000), ("stderr", 30_000), ("status", 1)}


def test_registered_steps_take_nulls():
    """A null text has no lines and no length; a null language is a group."""
    batch = pd.DataFrame({"doc_id": [1, 2, 3], "lang": ["x", None, None], "text": ["ab\nc", None, "abc"]})
    assert catalog.measure_lines(batch).values.tolist() == [[1, 2, 2], [3, 1, 3]]
    both = pd.concat([catalog.total_lengths(batch), catalog.total_lengths(batch[1:2]), catalog.total_lengths(batch[:0])])
    got = catalog.add_lengths(both)
    assert {(lang if isinstance(lang, str) else None, n, int(t), int(m)) for lang, n, t, m in got.values.tolist()} == {("x", 1, 4, 4), (None, 3, 3, 3)}
    assert catalog.total_lengths(batch[1:2])["total"].isna().all()
