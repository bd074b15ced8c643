from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runloom.operators import matrix
from runloom.sources import text

HEADER = "--arg1\t--inputs\t--singleton\tpositional_0\tpositional_1"
LINES = [
    "val1\t/path/to/input1\ttrue\tapples\tblue",
    "val3\t/path/to/inputN\ttrue\tstrawberries\tgreen",
    "val2\t/path/to/inputABB\tfalse\tkale\tpurple",
]
ARGV = [
    "--arg1 val1 --inputs /path/to/input1 --singleton apples blue",
    "--arg1 val3 --inputs /path/to/inputN --singleton strawberries green",
    "--arg1 val2 --inputs /path/to/inputABB kale purple",
]


def table(spark, header, lines):
    body = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "matrix_id long, row_id long, line string")
    return matrix.with_header(body, spark.createDataFrame([(1, header)], "matrix_id long, line string"))


def vectors(df):
    return [r["argv"] for r in df.orderBy("row_id").collect()]


def test_documented_matrix(spark):
    assert vectors(matrix.run_arg_vector(table(spark, HEADER, LINES))) == [a.split(" ") for a in ARGV]


def test_cell_forms(spark):
    header = "--a\t--b\t--c\t--d\tpositional_10\tpositional_2\t--e"
    got = vectors(matrix.run_arg_vector(table(spark, header, [
        " TRUE\t#True \t#FALSE\tx  y\tlast one\tfalse\tFalse",
        "#x#\t\t##true\ttrueish\tp10\tp2\tv",
    ])))
    assert got == [
        ["--a", "--b", "True", "--c", "FALSE", "--d", "x", "y", "false", "last one"],
        ["--a", "#x#", "--b", "--c", "##true", "--d", "trueish", "--e", "v", "p2", "p10"],
    ]


def test_ragged(spark, rows):
    ragged = table(spark, "--a\t--b\t--c", ["1\t2\t3\t4", "1\t2", "", "1\t2\t3", "\t2\t3"])
    assert rows(matrix.ragged_rows(ragged), "row_id", "n_cells", "reason") == {
        (0, 4, "too long"), (1, 2, "short"), (2, 1, "blank"), (4, 2, "short"),
    }
    assert [r["row_id"] for r in matrix.run_arg_vector(ragged).where("refused IS NULL").orderBy("row_id").collect()] == [1, 2, 3, 4]


def test_defaults(spark, rows):
    runs = matrix.given_arguments(table(spark, "--logs-dir\t--dry\tpositional_0", ["/mine\ttrue\tfalse", "false\tfalse\tx"]))
    got = rows(matrix.run_arg_defaults(runs, {"logs_dir": "/all"}, {"logs_dir": ".", "dry": "no"}), "row_id", "name", "value", "source")
    assert got == {(0, "logs_dir", "/mine", "run"), (0, "dry", "true", "run"), (1, "logs_dir", "/all", "batch"), (1, "dry", "no", "default")}


def test_scan_splits_large_files(spark, tmp_path):
    lines = [f"v{i}\t/in/{i}\ttrue\ta{i}\tb{i}" for i in range(3000)]
    (tmp_path / "one.tsv").write_text("\n".join([HEADER, *lines]) + "\n")
    (tmp_path / "two.tsv").write_text("--x\n1\n--x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        found = text.matrix_scan(spark, str(tmp_path))
        big = found.where(F.col("file").endswith("one.tsv")).orderBy("row_no").collect()
        assert [r["cells"] for r in big] == [line.split("\t") for line in lines]
        assert [r["row_no"] for r in big] == list(range(1, 3001)) and big[0]["header"] == HEADER.split("\t")
        small = found.where(F.col("file").endswith("two.tsv")).orderBy("row_no").collect()
        assert [r["cells"] for r in small] == [["1"], ["--x"]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_literal(spark, tmp_path):
    (tmp_path / "m.txt").write_text("".join(f" {a}  \n" for a in ARGV) + "--q 'a b'\n")
    got = sorted(tuple(r["argv"]) for r in text.matrix_literal_scan(spark, str(tmp_path)).collect())
    assert got == sorted(map(tuple, [*(a.split(" ") for a in ARGV), ["--q", "'a", "b'"]]))


def test_batch_expand(spark, rows):
    template = spark.createDataFrame([("w", 1, "t", "i", "o"), ("w", 2, "u", "o", "p")], "workflow string, task_no long, name string, input string, output string")
    runs = spark.createDataFrame([(1, "w"), (2, "w"), (3, "none")], "run_id long, workflow string")
    assert rows(matrix.batch_expand(runs, template), "task_id", "input", "output") == {
        (f"run{r}/{n}", f"run{r}/{i}", f"run{r}/{o}") for r in (1, 2) for n, i, o in (("t", "i", "o"), ("u", "o", "p"))
    }


def test_refused_lines_keep_their_place(spark, rows):
    """A line longer than its header has neither vector nor map, and says so in both."""
    lines = table(spark, "--a", ["1", "1\t2"])
    assert rows(matrix.run_arg_vector(lines).withColumn("argv", F.array_join("argv", " "))) == {(1, 0, "--a 1", None), (1, 1, None, "too long")}
    given = matrix.given_arguments(lines)
    assert rows(matrix.run_arg_defaults(given, {}, {"a": "9"}), "row_id", "value", "source") == {(0, "1", "run"), (1, None, "refused")}


def test_repeated_header_and_words(spark, rows):
    given = matrix.given_arguments(table(spark, "--a\t--b\t--a", ["1\tx   y\t2"]))
    assert rows(matrix.run_arg_defaults(given, {}, {"a": "9", "b": "8"}), "name", "value") == {("a", "2"), ("b", "x y")}


def test_scan_survives_other_splits(spark, tmp_path):
    """Headers stay headers when the split size changes between planning and running."""
    for i in range(6):
        (tmp_path / f"{i}.tsv").write_text("".join([f"--h{i}\n", *[f"v{j}\n" for j in range(50)]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        found = text.matrix_scan(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        got = [(r["file"][-5:], r["row_no"], r["header"][0], r["cells"][0]) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted((f"{i}.tsv", j + 1, f"--h{i}", f"v{j}") for i in range(6) for j in range(50))
