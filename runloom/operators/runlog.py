"""Run logs: what happened, in which order, how many tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.ordered import next_value, row_rank, running_sum
from runloom.functions.text import FILE_STAMP, LOG_STAMP, stem, strip

# What log messages say about a task, the state it leaves the task in, and the
# kind of failure.
PHRASES = {
    "assigned to executor": ("pending", None),
    "staged to run": ("running", None),
    "finished running": ("completed", None),
    "failed during execution": ("failed", "app failure"),
    "had a dependency fail": ("failed", "dependency failed"),
    "did not produce expected outputs": ("failed", "missing outputs"),
    "produced a general error": ("failed", "other"),
    "User aborted run": ("failed", "aborted"),
    "produced a RemoteError": ("failed", "remote"),
}
# A general error may be qualified by one word.
GENERAL_ERROR = r"produced a general \w+ error"
MESSAGE = r"^(?:\S++ )?(" + "|".join([*PHRASES, GENERAL_ERROR]) + ")"

# Which state wins when two have the same time.
SEVERITY = {"pending": 0, "running": 1, "completed": 2, "failed": 3}

# Form of a log line and of a log file name.
LOG_LINE = r"^\[\d{2}[A-Za-z]{3}\d{4} \d{2}:\d{2}:\d{2}\|[^\]]*\] > "
TAG_LINE = r"^@\w+_(start|end) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s*$"
LOG_FILE = r"^(.*)_(\d{2}[A-Za-z]{3}\d{4}_\d{6})\.\w+\.log$"


def state_stamp(ts: Column, state: Column) -> Column:
    """Time and severity as one number: the largest is the state that counts.  A number is
    aggregated by hashing, a structure would be sorted."""
    rank = F.lit(0)
    for name, value in SEVERITY.items():
        rank = F.when(state == name, value).otherwise(rank)
    return F.unix_micros(ts.cast("timestamp")) * len(SEVERITY) + rank


def stamped_state(stamp: Column) -> Column:
    rank = F.pmod(stamp, F.lit(len(SEVERITY)))
    state = F.lit(None).cast("string")
    for name, value in SEVERITY.items():
        state = F.when(rank == value, name).otherwise(state)
    return state


def stamped_time(stamp: Column) -> Column:
    # whole numbers throughout: a quotient of doubles is off by microseconds in later years
    return F.timestamp_micros((stamp - F.pmod(stamp, F.lit(len(SEVERITY)))).cast("decimal(20,0)").__truediv__(len(SEVERITY)).cast("long"))


def parse_line(line: Column) -> Column:
    """Struct (ts, logger, message) of a log line; all null on a continuation line."""
    head = line.rlike(LOG_LINE)
    close = F.position(F.lit("] > "), line)
    return F.struct(
        F.when(head, F.try_to_timestamp(F.substring(line, 2, 18), F.lit(LOG_STAMP)).cast("timestamp_ntz")).alias("ts"),
        F.when(head, F.substring(line, F.lit(21), close - 21)).alias("logger"),
        F.when(head, F.substring(line, close + 4, F.length(line))).alias("message"),
    )


def task_events(log: DataFrame) -> DataFrame:
    """Log rows that speak about a task, with the state they leave it in.

    One pattern finds the phrase; state and kind of failure follow by lookup, so that a filter
    on them costs one more match and not one per phrase.
    """
    def lookup(pick: int, otherwise: str) -> Column:
        pairs = [F.lit(x) for text, labels in PHRASES.items() for x in (text, labels[pick] or "")]
        found = F.try_element_at(F.create_map(*pairs), F.col("phrase"))
        return F.nullif(F.coalesce(found, F.lit(otherwise)), F.lit(""))

    spoken = log.withColumn("phrase", F.regexp_extract("message", MESSAGE, 1)).where("phrase <> ''")
    task = F.when(F.col("phrase") != "User aborted run", F.substring_index("message", " ", 1))
    return spoken.select(
        "*", task.alias("task"), lookup(0, "failed").alias("state"), lookup(1, "general").alias("failure")
    )


def log_file_identity(name: Column) -> Column:
    """Struct (run_name, started) of a log file name; a run name may contain underscores."""
    return F.struct(
        F.regexp_extract(name, LOG_FILE, 1).alias("run_name"),
        F.try_to_timestamp(F.nullif(F.regexp_extract(name, LOG_FILE, 2), F.lit("")), F.lit(FILE_STAMP))
        .cast("timestamp_ntz").alias("started"),
    )


def run_provenance(log: DataFrame) -> DataFrame:
    """Command, user, host, folder and run name as logged when a run starts."""
    message = F.col("message")

    def first(pattern: str, group: int) -> Column:
        return F.min_by(
            F.when(message.rlike(pattern), F.regexp_extract(message, pattern, group)),
            F.when(message.rlike(pattern), F.struct("ts", "line_no")),
        )

    where = r"^Who and where: ([^@]*)@([^:]*):(.*)$"
    return log.groupBy("run_id").agg(
        first(r"^Executing: \S+ (.*)$", 1).alias("command"),
        first(where, 1).alias("user"), first(where, 2).alias("host"), first(where, 3).alias("folder"),
        F.coalesce(first(r"^Run name: (.*)$", 1), F.lit("run")).alias("run_name"),
    )


def run_tags(log: DataFrame) -> DataFrame:
    """Start, end and elapsed microseconds of each run, from its tag lines; null for what is not there.

    A tag is a line of its own, ``@<name>_start`` or ``@<name>_end`` and a time with microseconds.
    """
    def tag(which: str) -> Column:
        found = F.when(F.regexp_extract("message", TAG_LINE, 1) == which, F.regexp_extract("message", TAG_LINE, 2))
        return F.max(found.try_cast("timestamp_ntz"))

    spans = log.groupBy("run_id").agg(tag("start").alias("started"), tag("end").alias("ended"))
    return spans.withColumn("elapsed_us", F.timestamp_diff("MICROSECOND", F.col("started"), F.col("ended")))


def task_state_final(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Last state of every task; a task the log never mentions is pending."""
    last = events.groupBy("run_id", "task").agg(
        F.max(state_stamp(F.col("ts"), F.col("state"))).alias("stamp")
    ).select("run_id", "task", stamped_state(F.col("stamp")).alias("state"))
    return tasks.select("run_id", "task").join(last, ["run_id", "task"], "left").select(
        "run_id", "task", F.coalesce("state", F.lit("pending")).alias("state")
    )


def failure_kinds(events: DataFrame) -> DataFrame:
    return events.where("failure IS NOT NULL").groupBy("run_id", "failure").agg(
        F.count(F.lit(1)).alias("n")
    )


def failure_lists(tasks: DataFrame) -> DataFrame:
    """Failed and never-run tasks of each run, one row for each, numbered in registration order.

    ``tasks`` has (run_id, seq, name, state).  A run without such tasks has one row with the name 'None' and number 0.
    """
    wanted = tasks.where("state IN ('failed', 'pending')").select("run_id", "state", "seq", "name")
    ranked = row_rank(wanted, ["run_id", "state"], ["seq"], [F.floor(F.col("seq") / 100_000)], "nth").drop("seq")
    every = tasks.select("run_id").distinct().select(
        "run_id", F.explode(F.array(F.lit("failed"), F.lit("pending"))).alias("state")
    )
    return every.join(ranked, ["run_id", "state"], "left").select(
        "run_id", "state", F.coalesce("nth", F.lit(0).cast("long")).alias("nth"), F.coalesce("name", F.lit("None")).alias("name"),
    )


def run_summary(events: DataFrame) -> DataFrame:
    """First and last record of each run, and how many of its tasks ended in which state.

    A task that is reported several times counts once, with its last state.  Aggregates are combined before both shuffles.
    """
    task = events.groupBy("run_id", "task").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"),
        F.max(state_stamp(F.col("ts"), F.col("state"))).alias("stamp"))
    state, known = stamped_state(F.col("stamp")), F.col("task").isNotNull()
    return task.groupBy("run_id").agg(
        F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("n").alias("n_records"), F.count_if(known).alias("n_tasks"),
        *[F.count_if(known & (state == s)).alias(f"n_{s}") for s in SEVERITY],
    ).withColumn("elapsed_s", F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))


def run_elapsed(attempts: DataFrame) -> DataFrame:
    """Elapsed time of each run: in full, and the seconds within the last day."""
    spans = attempts.groupBy("run_id").agg(F.min("start_ts").alias("s"), F.max("end_ts").alias("e"))
    total = F.timestamp_diff("SECOND", F.col("s"), F.col("e"))
    return spans.select(
        "run_id", total.alias("total_seconds"), (total % 86400).alias("elapsed_seconds")
    )


def concurrency_series(attempts: DataFrame) -> DataFrame:
    """Tasks running in each run after every instant at which that number may change.

    Starts and ends at one instant are added up first; that is the same as letting ends go
    before starts, and leaves one row per instant to be ordered.
    """
    moves = attempts.select(
        "run_id",
        F.explode(F.array(
            F.struct(F.col("start_ts").alias("ts"), F.lit(1).cast("long").alias("d")),
            F.struct(F.col("end_ts").alias("ts"), F.lit(-1).cast("long").alias("d")),
        )).alias("m"),
    ).groupBy("run_id", F.col("m.ts").alias("ts")).agg(F.sum("m.d").alias("d"))
    return running_sum(
        moves, ["run_id"], ["ts"], [F.date_trunc("minute", "ts")], F.col("d"), "running"
    ).drop("d")


def running_concurrency(attempts: DataFrame) -> DataFrame:
    """Most tasks running at once in each run, and the first time this was so."""
    return concurrency_series(attempts).groupBy("run_id").agg(
        F.max(F.struct("running", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), "ts")).alias("top")
    ).select("run_id", F.col("top.running").alias("peak"), F.col("top.ts").alias("peak_at"))


def running_set_change(attempts: DataFrame, poll_s: float = 600) -> DataFrame:
    """Which tasks enter and leave the running set at polls taken every ``poll_s`` seconds.

    A task enters at the first poll at or after its start.  It leaves at the first poll at or after its end, but
    not before the poll that follows the one at which it entered: every task is seen, however short.  The difference of
    consecutive sets follows per task, without building the sets.  ``poll_s`` may be a fraction of a second.
    """
    every = round(poll_s * 1_000_000)
    start, end = (F.expr(f"-((-unix_micros(CAST({c} AS TIMESTAMP)) - pmod(-unix_micros(CAST({c} AS TIMESTAMP)), {every}))) div {every}")
                  for c in ("start_ts", "end_ts"))
    seen = attempts.select("run_id", "task_id", start.alias("a"), end.alias("b")).withColumn("b", F.greatest("b", F.col("a") + 1))
    return seen.select(
        "run_id", "task_id",
        F.explode(F.array(
            F.struct(F.col("a").alias("n"), F.lit("entered").alias("change")),
            F.struct(F.col("b").alias("n"), F.lit("left").alias("change")),
        )).alias("c"),
    ).select("run_id", "task_id", (F.col("c.n") * F.lit(every) / 1_000_000).alias("poll_s"), "c.change")


#: Levels of cells in an index of running tasks: the longest are 2 ** 40 times the shortest.
CELL_LEVELS = 40


def running_index(attempts: DataFrame, cell_s: int = 600) -> DataFrame:
    """An index of what runs when: ``run_id, level, cell, task_id, start_us, end_us``.

    Time is cut into cells of ``cell_s`` seconds, and pairs of cells make the cells of the next level.  A task is listed at the largest cells
    that it fills, two for each level at most, with null times, and with its times at the one or two shortest cells that it only
    reaches into.  So a task of any length has few rows, and no list spans a run.
    """
    size = cell_s * 1_000_000
    start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("start_ts", "end_ts"))
    timed = attempts.select("run_id", "task_id", start.alias("start_us"), end.alias("end_us")).where("start_us < end_us")
    inside = timed.withColumns({
        "_a": F.expr(f"CAST((start_us - pmod(start_us, {size})) / {size} AS BIGINT) + IF(pmod(start_us, {size}) = 0, 0, 1)"),
        "_b": F.expr(f"CAST((end_us - pmod(end_us, {size})) / {size} AS BIGINT)")})
    full = F.expr(f"""flatten(transform(sequence(0, {CELL_LEVELS}), k -> transform(
        filter(array(
            struct(-shiftright(-_a, k) AS cell, -shiftright(-_a, k) % 2 <> 0 AS own),
            struct(shiftright(_b, k) - 1 AS cell, shiftright(_b, k) % 2 <> 0 AS own)),
          c -> c.own AND -shiftright(-_a, k) < shiftright(_b, k)),
        c -> struct(k AS level, c.cell AS cell))))""")
    filled = inside.select("run_id", "task_id", F.explode(full).alias("c")).select(
        "run_id", F.col("c.level").cast("int").alias("level"), "c.cell", "task_id", *[F.lit(None).cast("long").alias(x) for x in ("start_us", "end_us")])
    # a cell at an end that is not filled
    ends = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("_a") * size > F.col("start_us"), F.col("_a") - 1),
        F.when(F.col("_b") * size < F.col("end_us"), F.col("_b")))))
    reached = inside.select("run_id", F.lit(0).alias("level"), F.explode(ends).alias("cell"), "task_id", "start_us", "end_us")
    return filled.unionByName(reached)


def running_at(instants: DataFrame, index: DataFrame, cell_s: int = 600) -> DataFrame:
    """``run_id, at, task_id``: the tasks of each run that run at given instants (run_id, at), their ends excluded, from :func:`running_index`.

    An instant lies in one cell of each level, so its set is read by equality of cells, whatever the length of the run.
    """
    size = cell_s * 1_000_000
    us = F.unix_micros(F.col("at").cast("timestamp"))
    base = ((us - F.pmod(us, F.lit(size))) / size).cast("long")
    cells = instants.select("run_id", "at", us.alias("_us"), base.alias("_base")).distinct().select(
        "run_id", "at", "_us", "_base", F.explode(F.sequence(F.lit(0), F.lit(CELL_LEVELS))).alias("level"))
    cells = cells.withColumn("cell", F.expr("shiftright(_base, level)"))
    return cells.join(index, ["run_id", "level", "cell"]).where("start_us IS NULL OR start_us <= _us AND _us < end_us").select("run_id", "at", "task_id")


def _log_slices() -> list[Column]:
    """Log times are whole seconds; even a second that holds most of a log is cut by line."""
    return [F.col("ts"), F.floor(F.col("line_no") / 1_000_000)]


def launch_rank(events: DataFrame) -> DataFrame:
    """Order in which the tasks of a run were staged."""
    staged = events.where("state = 'running'").select("run_id", "task", "ts", "line_no")
    return row_rank(
        staged, ["run_id"], ["ts", "line_no"], _log_slices(), "staged_pos"
    )


def state_dwell(events: DataFrame) -> DataFrame:
    """Seconds between consecutive states of a task."""
    rows = events.select("run_id", "task", "line_no", "ts", "state")
    following = next_value(
        rows, ["run_id", "task"], ["ts", "line_no"], _log_slices(), "ts", "next_ts"
    )
    return following.select(
        "run_id", "task", "line_no", "state",
        F.timestamp_diff("SECOND", F.col("ts"), F.col("next_ts")).alias("seconds"),
    )


def longest_tasks(attempts: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` tasks that ran longest."""
    seconds = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts"))
    return attempts.select("run_id", "task_id", seconds.alias("seconds")).orderBy(
        F.desc("seconds"), "task_id"
    ).limit(k)


def first_n_records(records: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` records of each file.  Spark cuts each group to ``n`` rows before the
    shuffle."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return records.withColumn("nth", nth).where(F.col("nth") <= n).withColumn("nth", F.col("nth").cast("long"))


def capture_attach(captures: DataFrame, tasks: DataFrame) -> DataFrame:
    """Log records that carry the captured output (run_id, task_id, stream, content) of each task.

    Empty captures are dropped, those that could not be read (null) are reported.  ``known`` tells whether the run has
    the task; captures of unknown tasks stay.
    """
    ids = tasks.select("run_id", "task_id").distinct().withColumn("known", F.lit(True))
    of = F.concat("stream", F.lit(" stream of "), F.col("task_id").cast("string"))
    return captures.where("content IS NULL OR content <> ''").join(ids, ["run_id", "task_id"], "left").select(
        "run_id", "task_id", "stream", F.coalesce("known", F.lit(False)).alias("known"),
        F.when(F.col("content").isNull(), F.concat(F.lit("Could not read "), of))
        .otherwise(F.concat(F.lit("Output from "), of, F.lit(":\n"), "content")).alias("message"),
    )


def text_metric(
    captures: DataFrame, pattern: str = r"(\d+) \+ \d+ mapped", divisor: float = 2.0
) -> DataFrame:
    """The first number that ``pattern`` finds in each text, divided; null where there is none."""
    found = F.regexp_extract("content", pattern, 1)
    return captures.select(
        "task_id", (F.nullif(found, F.lit("")).cast("double") / divisor).alias("metric")
    )


def last_part(line: Column) -> Column:
    """Text after the last ``>`` of a log line."""
    return strip(F.substring_index(line, ">", -1))


def capture_names(files: DataFrame) -> DataFrame:
    """Captures (task_id, stream, content) from files (name, content); empty ones are dropped.
    A null content (the file could not be read) is kept with ``readable = false``."""
    base = F.substring_index("name", "/", -1)
    return files.select(
        stem(F.col("name")).alias("task_id"), F.substring_index(base, ".", -1).alias("stream"), "content",
        F.col("content").isNotNull().alias("readable"),
    ).where("content IS NULL OR content <> ''")


def pool_load(events: DataFrame) -> DataFrame:
    """Tasks per assigned pool and run, with totals (null), read back from the log."""
    pool = F.regexp_extract("message", r"assigned to executor (\S+), task id", 1)
    assigned = events.select("run_id", pool.alias("pool")).where("pool <> ''")
    return assigned.cube("pool", "run_id").agg(F.count(F.lit(1)).alias("n_tasks"))
