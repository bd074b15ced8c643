"""Run matrices: tab-separated tables with one run per line.

The header and the cells of a line stay arrays in one row, so an argument vector is built
without a shuffle; only the header has to be joined to its lines, by ``matrix_id``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import strip, words


def split_line(line: Column) -> Column:
    """Cells of a line.  White space at both ends of the line is lost first, and with it any
    empty cells there; there is no quoting.  A blank line has one empty cell."""
    return F.split(strip(line), "\t")


def with_header(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Give every line (matrix_id, row_id, line) the header of its matrix (matrix_id, line)."""
    return lines.join(
        headers.select("matrix_id", split_line(F.col("line")).alias("header")), "matrix_id"
    ).select("matrix_id", "row_id", "header", split_line(F.col("line")).alias("cells"))


def matrix_cells(rows: DataFrame) -> DataFrame:
    """One row per cell; a cell beyond the header has no header."""
    cells = rows.select("matrix_id", "row_id", "header", F.posexplode_outer("cells").alias("pos", "value"))
    return cells.where("pos IS NOT NULL").select(
        "matrix_id", "row_id", F.col("pos").cast("long").alias("pos"),
        F.get("header", F.col("pos")).alias("header"), "value",
    )


def _argument(name: Column, value: Column) -> Column:
    """Tokens of an optional argument: a switch, a literal, nothing, or white-space-split values."""
    bare = strip(value)
    folded = F.lower(bare)
    return (
        F.when(folded == "true", F.array(name))
        .when(folded.isin("#true", "#false"), F.array(name, F.regexp_replace(bare, "^#+|#+$", "")))
        .when(folded == "false", F.array().cast("array<string>"))
        .otherwise(F.concat(F.array(name), words(value)))
    )


def _refusal() -> Column:
    return F.when(F.size("cells") > F.size("header"), F.lit("too long"))


def run_arg_vector(rows: DataFrame) -> DataFrame:
    """Arguments of each run: optionals in header order, then positionals by their number.

    ``positional_10`` comes after ``positional_2``; positionals are neither split nor
    interpreted.  A line longer than its header is refused: it has no vector, and ``refused`` says why.
    """
    named = F.arrays_zip(
        F.slice("header", 1, F.least(F.size("header"), F.size("cells"))).alias("name"),
        F.slice("cells", 1, F.least(F.size("header"), F.size("cells"))).alias("value"),
    )
    optional = F.flatten(F.transform(
        F.filter(named, lambda c: ~c["name"].startswith("positional_")),
        lambda c: _argument(c["name"], c["value"]),
    ))
    numbered = F.transform(
        F.filter(
            F.transform(named, lambda c, i: F.struct(c["name"].alias("name"), i.alias("i"), c["value"].alias("value"))),
            lambda c: c["name"].startswith("positional_"),
        ),
        lambda c: F.struct(
            F.substring_index(c["name"], "_", -1).try_cast("int").alias("n"), c["i"].alias("i"), c["value"].alias("value")
        ),
    )
    positional = F.transform(F.array_sort(numbered), lambda c: c["value"])
    return rows.select(
        "matrix_id", "row_id", F.when(_refusal().isNull(), F.concat(optional, positional)).alias("argv"), _refusal().alias("refused")
    )


def literal_arg_vector(lines: DataFrame) -> DataFrame:
    """A line without header is the argument vector itself, split at white space, no quoting."""
    return lines.select("matrix_id", "row_id", words(F.col("line")).alias("argv"))


def ragged_rows(rows: DataFrame) -> DataFrame:
    """Lines whose width differs from the header, with the reason."""
    width, cells = F.size("header"), F.size("cells")
    blank = (cells == 1) & (F.get("cells", F.lit(0)) == "")
    reason = F.when(blank, "blank").when(cells > width, "too long").when(cells < width, "short")
    return rows.select(
        "matrix_id", "row_id", cells.cast("long").alias("n_cells"), width.cast("long").alias("n_headers"),
        reason.alias("reason"),
    ).where("reason IS NOT NULL")


def given_arguments(rows: DataFrame) -> DataFrame:
    """Named arguments of each run as a map; those set to ``false`` are absent, switches are
    ``true``, the words of a value are joined by one blank.  Of headers with one name the last counts.  A line longer
    than its header is refused: it has no map, and ``refused`` says why."""
    pairs = F.filter(
        F.arrays_zip(F.col("header").alias("name"), F.col("cells").alias("value")),
        lambda c: c["name"].isNotNull() & c["value"].isNotNull() & (
            c["name"].startswith("positional_") | (F.lower(strip(c["value"])) != "false")
        ),
    )
    clean = F.transform(pairs, lambda c: F.struct(
        F.regexp_replace(F.regexp_replace(c["name"], "^-+", ""), "-", "_").alias("k"),
        F.when(c["name"].startswith("positional_"), c["value"])
        .when(F.lower(strip(c["value"])) == "true", F.lit("true"))
        .otherwise(F.array_join(words(F.regexp_replace(strip(c["value"]), "^#(?i)(true|false)$", "$1")), " ")).alias("v"),
    ))
    paired = rows.withColumn("_pairs", clean)
    last = F.filter("_pairs", lambda c, i: ~F.exists(
        F.slice(F.col("_pairs"), i + 2, F.greatest(F.size("_pairs") - i - 1, F.lit(0))), lambda later: later["k"] == c["k"]))
    return paired.select(
        "matrix_id", "row_id", F.when(_refusal().isNull(), F.map_from_entries(last)).alias("given"), _refusal().alias("refused"))


def run_arg_defaults(
    runs: DataFrame, batch: Mapping[str, str], defaults: Mapping[str, str | None]
) -> DataFrame:
    """Value of every declared argument of every run: given, else batch-wide, else default.

    ``runs`` has the map of :func:`given_arguments`; ``defaults`` declares the arguments.  A refused run has no values; its
    ``source`` is 'refused'.
    """
    declared = [
        F.struct(
            F.lit(name).alias("name"),
            F.when(F.col("refused").isNull(), F.coalesce(
                F.try_element_at("given", F.lit(name)), F.lit(batch.get(name)), F.lit(default))).alias("value"),
            F.when(F.col("refused").isNotNull(), "refused")
            .when(F.try_element_at("given", F.lit(name)).isNotNull(), "run")
            .when(F.lit(batch.get(name)).isNotNull(), "batch").otherwise("default").alias("source"),
        )
        for name, default in defaults.items()
    ]
    return runs.select("matrix_id", "row_id", F.explode(F.array(*declared)).alias("a")).select(
        "matrix_id", "row_id", "a.name", "a.value", "a.source"
    )


def batch_expand(runs: DataFrame, template: DataFrame) -> DataFrame:
    """The tasks of each run's workflow, with ids and paths of their own.

    ``runs`` (run_id, workflow) and ``template`` (workflow, task_no, name, input, output) are
    joined by workflow.  A workflow may own most runs: the template is the small side, which
    Spark broadcasts when its size allows; AQE splits the runs otherwise.
    """
    prefix = F.concat(F.lit("run"), F.col("run_id").cast("string"), F.lit("/"))
    return runs.select("run_id", "workflow").join(template, "workflow").select(
        "run_id", "workflow",
        F.concat(prefix, "name").alias("task_id"), "task_no",
        F.concat(prefix, "input").alias("input"), F.concat(prefix, "output").alias("output"),
    )
