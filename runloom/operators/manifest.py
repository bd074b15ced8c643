"""What exactly ran: programs, parameters, redirects and pipes as one table per run history.

Tables; task ids are unique within a run only, so everything is keyed by (run_id, task_id)

``tasks``      run_id, task_id, seq, kind ('bash'/'python'), name, path, subprogram, action; optionally success_on
               (array of accepted exit codes) and meta (map)
``software``   name, path                     (paths known from the site configuration)
``params``     run_id, task_id, pos, tokens, sep   (pos is anything that sorts); optionally ``marks``, an array along ``tokens``:
               null for text, 'input' or 'output' for a file so marked, anything else for a file without a mark
``redirects``  run_id, task_id, pos, stream, dest, is_data; optionally mark
``pipes``      run_id, task_id, pos, right_task_id
``ports``      run_id, task_id, role, path   (files and waits declared beside the parameters); optionally mark
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from runloom.functions import ordered
from runloom.functions.text import basename, redirect_stream, redirect_token
from runloom.session import stored

KEY = ["run_id", "task_id"]
#: Tasks of a run whose files one window looks up; longer runs are cut along ``seq``.
SLICE = 10_000
#: Fixed value: the destination that discards a stream.
NULL_DEVICE = "/dev/null"


def resolve_programs(tasks: DataFrame, software: DataFrame) -> DataFrame:
    """Final path, identifier and display name of each task.

    The path is the task's own, else the configured one; a program without either is marked
    ``resolved = false``.  ``basename`` ignores the subprogram.
    A task without accepted exit codes accepts '0'.
    """
    known = software.select(F.col("name"), F.col("path").alias("site_path"))
    joined = tasks.join(known, "name", "left")
    codes = F.col("success_on") if "success_on" in tasks.columns else F.lit(None).cast("array<string>")
    meta = F.col("meta") if "meta" in tasks.columns else F.lit(None).cast("map<string,string>")
    is_python = F.col("kind") == "python"
    path = F.coalesce("path", "site_path")
    base = F.when(is_python, F.col("name")).otherwise(F.replace(basename(path), F.lit(" "), F.lit("_")))
    full = F.concat_ws(" ", path, F.when(F.col("subprogram") != "", F.col("subprogram")))
    return joined.select(
        "run_id", "task_id", "seq", "kind",
        F.when(~is_python, F.when(path.isNotNull(), full)).alias("program"),
        F.concat_ws("_", base, F.col("seq").cast("string")).alias("app_id"),
        F.coalesce("action", F.when(path.isNotNull(), full)).alias("label"),
        (is_python | path.isNotNull()).alias("resolved"),
        F.coalesce(codes, F.array(F.lit("0"))).alias("success_on"), meta.alias("meta"),
    ).withColumn("label", F.when(is_python, F.col("app_id")).otherwise(F.col("label")))


def unresolved_programs(tasks: DataFrame, software: DataFrame) -> DataFrame:
    """Programs with no path of their own and none configured."""
    return resolve_programs(tasks, software).where(~F.col("resolved")).select("run_id", "task_id", "seq")


def redirect_resolve(redirects: DataFrame, both_is_output: bool = False) -> DataFrame:
    """Standard streams after the redirects of each task.

    Only the first two redirects count.  One that takes both streams ends the scan, and its
    destination is an output only if ``both_is_output``; otherwise the later redirect of a stream wins and a data
    destination becomes an output, unless it is the null device.  A redirect without a stream takes standard output, one
    without a destination discards.  ``n_ignored`` counts the redirects without effect: those behind the second, and behind one
    that takes both streams.  ``stream`` is a number or a token such as ``2>``.  One shuffle brings a task's redirects together for order, count and streams.
    """
    if isinstance(redirects.schema["stream"].dataType, StringType):
        redirects = redirects.withColumn("stream", redirect_stream(F.col("stream")))
    redirects = redirects.withColumns({
        "stream": F.coalesce("stream", F.lit(0).cast(redirects.schema["stream"].dataType)), "dest": F.coalesce("dest", F.lit(NULL_DEVICE))})
    redirects = redirects.withColumn("is_data", F.col("is_data") & (F.col("dest") != NULL_DEVICE))
    task = Window.partitionBy(*KEY)
    numbered = redirects.withColumns({"nth": F.row_number().over(task.orderBy("pos")), "n": F.count(F.lit(1)).over(task)})

    def of(nth: int, column: str):
        return F.max(F.when(F.col("nth") == nth, F.col(column)))

    pair = numbered.where("nth <= 2").groupBy(*KEY).agg(
        F.max("n").alias("n"), *[of(n, c).alias(f"{c}{n}") for n in (1, 2) for c in ("stream", "dest", "is_data")]
    )
    both_first = F.col("stream1") == 2
    both_second = ~both_first & (F.coalesce("stream2", F.lit(-1)) == 2)

    def target(stream: int):
        return (
            F.when(both_first, F.col("dest1"))
            .when(both_second, F.col("dest2"))
            .when(F.col("stream2") == stream, F.col("dest2"))
            .when(F.col("stream1") == stream, F.col("dest1"))
        )

    both_counts = F.lit(both_is_output)
    return pair.select(
        *KEY,
        target(0).alias("stdout"),
        target(1).alias("stderr"),
        F.when((both_counts | ~both_first) & F.col("is_data1"), F.col("dest1")).alias("output1"),
        F.when(~both_first & (both_counts | ~both_second) & F.col("is_data2"), F.col("dest2")).alias("output2"),
        redirect_token(F.col("stream1")).alias("token1"),
        redirect_token(F.col("stream2")).alias("token2"),
        (F.col("n") - F.when(both_first, 1).otherwise(F.least(F.col("n"), F.lit(2)))).cast("long").alias("n_ignored"),
    )


def _marked(params: DataFrame) -> DataFrame:
    """The files among the parameters' tokens: ``run_id, task_id, place, path, mark`` (null without one).  '' is no file."""
    if "marks" not in params.columns:
        return params.select(*KEY, F.struct("pos", F.lit(0).alias("tok")).alias("place"), F.lit(None).cast("string").alias("path"),
                             F.lit(None).cast("string").alias("mark")).where("false")
    each = params.select(*KEY, "pos", F.posexplode(F.arrays_zip(F.col("tokens").alias("path"), F.col("marks").alias("mark"))).alias("tok", "t"))
    return each.where("t.mark IS NOT NULL AND t.path <> ''").select(
        *KEY, F.struct("pos", "tok").alias("place"), F.col("t.path").alias("path"), F.when(F.col("t.mark").isin("input", "output"), F.col("t.mark")).alias("mark"))


def file_modes(tasks: DataFrame, params: DataFrame, *others: DataFrame) -> DataFrame:
    """The mode in force for every file among the parameters of every task: ``run_id, task_id, path, role, mode_defaulted``.

    A file is one thing throughout its run, and what it was last marked as, in order of registration (``seq``), holds for all that
    use it from there on: a task's own marks, wherever they stand among its parameters, come before it is registered.  A file
    never marked is an output, and the mode is ``mode_defaulted``.  ``others`` are tables with ``run_id, task_id, path, mark`` that
    mark files without being parameters.  In runs that go beyond ``SLICE`` the look-up is cut along ``seq``, so that a file used by
    every task of a run is no one task's work; the files of others are looked up by one window.
    """
    # dealt by task once, which serves the aggregate and the join
    use = _marked(params).repartition(*KEY).groupBy(*KEY, "path").agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("place"))).alias("mark"), F.lit(True).alias("used"))
    for other in others:
        use = use.unionByName(other.where("mark IN ('input', 'output') AND path <> ''").groupBy(*KEY, "path").agg(
            F.max("mark").alias("mark"), F.lit(False).alias("used")))
    if others:
        # parameters come after what is declared beside them
        use = use.groupBy(*KEY, "path").agg(
            F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("used", "mark"))).alias("mark"), F.max("used").alias("used"))
    placed = use.join(tasks.select(*KEY, "seq"), KEY)
    long, (n_long,) = stored(tasks.where(F.col("seq") >= SLICE).select("run_id").distinct(), "long-runs", F.count(F.lit(1)))
    file, order = ["run_id", "path"], ["seq", "task_id"]
    held = ordered.fill_in_order(placed.join(long, "run_id", "left_anti") if n_long else placed, file, order, ["mark"])
    if n_long:
        held = held.unionByName(ordered.fill_forward(
            placed.join(long, "run_id", "left_semi"), file, order, [F.floor(F.col("seq") / SLICE)], ["mark"]))
    return held.where("used").select(
        *KEY, "path", F.when(F.col("mark") == "input", "input").otherwise("output").alias("role"), F.col("mark").isNull().alias("mode_defaulted"))


def first_pipes(pipes: DataFrame) -> DataFrame:
    """Only the first pipe of a task counts; ``n_ignored`` are the others."""
    return pipes.groupBy(*KEY).agg(
        F.min_by("right_task_id", "pos").alias("right_task_id"), (F.count(F.lit(1)) - 1).alias("n_ignored"))


def render_arguments(params: DataFrame) -> DataFrame:
    """Tokens joined by the parameter's separator, parameters by a blank, in order: one row per task."""
    return (
        params.select(*KEY, "pos", F.expr("array_join(tokens, sep)").alias("arg"))
        .groupBy(*KEY)
        .agg(F.expr("listagg(arg, ' ') WITHIN GROUP (ORDER BY pos)").alias("arguments"))
    )


def blueprints(
    tasks: DataFrame, software: DataFrame, params: DataFrame, redirects: DataFrame, tmp_dir: str, streams: DataFrame | None = None
) -> DataFrame:
    """Commands and streams before pipes; one row per task.

    A stream that is not redirected goes to ``<tmp_dir>/<app_id>.stdout`` or ``.stderr``.  ``streams`` is the result of
    :func:`redirect_resolve` where it is at hand.
    """
    programs = resolve_programs(tasks, software).where("resolved and kind = 'bash'")
    streams = (redirect_resolve(redirects) if streams is None else streams).select(*KEY, "stdout", "stderr")
    joined = programs.join(render_arguments(params), KEY, "left").join(streams, KEY, "left")

    def default(name: str):
        return F.coalesce(name, F.concat(F.lit(tmp_dir + "/"), "app_id", F.lit("." + name))).alias(name)

    return joined.select(
        *KEY, "app_id", "label", F.col("stderr").alias("left_stderr"), default("stdout"), default("stderr"),
        F.concat_ws(" ", "program", "arguments").alias("cmd"), "success_on", "meta",
    )


def pipe_compose(blueprint: DataFrame, pipes: DataFrame) -> DataFrame:
    """``left [2> err] | right``: the streams become those of the right side, accepted codes stay the left side's.

    ``blueprint`` has the columns of :func:`blueprints`; so has the result, so that longer
    chains are composed by applying the function to its own output.
    """
    right = blueprint.select(
        "run_id", F.col("task_id").alias("right_task_id"), F.col("cmd").alias("right_cmd"),
        F.col("stdout").alias("right_stdout"), F.col("stderr").alias("right_stderr"),
    )
    pairs = first_pipes(pipes).drop("n_ignored").join(right, ["run_id", "right_task_id"]).drop("right_task_id")
    piped = F.col("right_cmd").isNotNull()
    both = F.concat_ws(
        " ", "cmd", F.when(F.col("left_stderr").isNotNull(), F.concat(F.lit("2> "), F.col("left_stderr"))), F.lit("|"), "right_cmd")
    return blueprint.join(pairs, KEY, "left").select(
        *KEY, "app_id", "label", F.when(~piped, F.col("left_stderr")).alias("left_stderr"),
        F.coalesce("right_stdout", "stdout").alias("stdout"), F.coalesce("right_stderr", "stderr").alias("stderr"),
        F.when(piped, both).otherwise(F.col("cmd")).alias("cmd"), "success_on", "meta", piped.alias("is_piped"),
    )


def task_files(
    ports: DataFrame, redirects: DataFrame, pipes: DataFrame, modes: DataFrame | None = None, streams: DataFrame | None = None
) -> DataFrame:
    """Every file and wait of a task, one row each: ``run_id, task_id, role, path, mode_defaulted``.

    Those of its parameters (``modes``, from :func:`file_modes`), those declared beside them, redirected data, and those of a pipe's
    right side.  A list per task would not be bounded.  ``mode_defaulted`` says that nothing but a parameter without a mark
    makes the file an output.  The rows come dealt by task, so that counts per task need no further shuffle.
    """
    streams = redirect_resolve(redirects) if streams is None else streams
    redirected = streams.select(
        *KEY, F.lit("output").alias("role"),
        F.explode(F.array_compact(F.array("output1", "output2"))).alias("path"),
    )
    own = ports.select(*KEY, "role", "path").unionByName(redirected).withColumn("mode_defaulted", F.lit(False))
    if modes is not None:
        own = own.unionByName(modes.select(*own.columns))
    left_of = first_pipes(pipes).select("run_id", F.col("right_task_id").alias("task_id"), F.col("task_id").alias("left_id"))
    return (
        own.where("path <> ''").join(left_of, KEY, "left")
        .select("run_id", F.explode(F.array_compact(F.array("task_id", "left_id"))).alias("task_id"), "role", "path", "mode_defaulted")
        .repartition(*KEY).groupBy(*KEY, "role", "path").agg(F.min("mode_defaulted").alias("mode_defaulted"))
    )


def command_files(tasks: DataFrame, params: DataFrame, redirects: DataFrame, pipes: DataFrame, ports: DataFrame) -> DataFrame:
    """:func:`task_files` with the files of the parameters derived from their marks."""
    return task_files(ports, redirects, pipes, file_modes(tasks, params, *_marking(redirects, ports)))


def _marking(redirects: DataFrame, ports: DataFrame) -> list[DataFrame]:
    marks = [redirects.where("is_data").select(*KEY, F.col("dest").alias("path"), "mark")] if "mark" in redirects.columns else []
    return marks + ([ports.where("role <> 'wait_on'").select(*KEY, "path", "mark")] if "mark" in ports.columns else [])


def command_manifest(
    tasks: DataFrame,
    software: DataFrame,
    params: DataFrame,
    redirects: DataFrame,
    pipes: DataFrame,
    ports: DataFrame,
    tmp_dir: str = "tmp",
    both_is_output: bool = False,
) -> DataFrame:
    """One row per program run: what was executed, which exit codes it accepts, where its
    streams went, how many files it reads and writes, how many of the latter only for want of a mark, how many tasks it waits on,
    and how many redirects and pipes had no effect.

    A program on the right of a pipe runs as part of the left one and has no row of its own.  Streams are stored once, because
    commands and files read them, and so are commands before pipes, because both sides of a pipe read them.
    """
    streams, _ = stored(redirect_resolve(redirects, both_is_output), "streams")
    blueprint, _ = stored(blueprints(tasks, software, params, redirects, tmp_dir, streams), "blueprints")
    first, _ = stored(first_pipes(pipes), "first-pipes")
    rights = pipes.select("run_id", F.col("right_task_id").alias("task_id")).distinct()
    composed = pipe_compose(blueprint, first.withColumn("pos", F.lit(0))).join(rights, KEY, "left_anti")
    modes = file_modes(tasks, params, *_marking(redirects, ports)) if "marks" in params.columns else None
    # stored, so that the task that counts does not hold the rows of the joins as well
    counts, _ = stored(
        task_files(ports, redirects, first.withColumn("pos", F.lit(0)), modes, streams)
        .groupBy(*KEY)
        .agg(*[
            F.count_if(F.col("role") == role).alias(name)
            for role, name in (("input", "n_inputs"), ("output", "n_outputs"), ("wait_on", "n_waits"))
        ], F.count_if("mode_defaulted").alias("n_defaulted")), "counts")
    ignored = streams.select(*KEY, "n_ignored").unionByName(first.select(*KEY, "n_ignored")).groupBy(*KEY).agg(F.sum("n_ignored").alias("n_ignored"))
    logged = F.concat(F.col("cmd"), F.lit(" > "), F.col("stdout"), F.lit(" 2> "), F.col("stderr"))
    return composed.join(counts, KEY, "left").join(ignored, KEY, "left").select(
        *KEY, "app_id", "label", "cmd", logged.alias("logged"), "stdout", "stderr", "success_on", "meta",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_inputs", "n_outputs", "n_waits", "n_defaulted", "n_ignored")],
    )


def program_inventory(tasks: DataFrame, software: DataFrame) -> DataFrame:
    """Distinct program paths in use, and how many runs and tasks use each."""
    programs = resolve_programs(tasks, software).where("program is not null")
    per_run = programs.groupBy("program", "run_id").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("program").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_tasks")
    )
