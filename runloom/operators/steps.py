"""External programs and Python functions over the rows of a DataFrame.

Spark partitions the rows and retries failed tasks; a program sees one partition as lines on
its standard input.
"""

from __future__ import annotations

import itertools
import queue
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import IO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runloom.operators.lineage import missing_outputs

PROGRAM_ROWS = "source string, partition int, line string, exit_code int, accepted boolean"
_BATCH = 4096


class ProgramFailed(RuntimeError):
    """A program ended with a code that was not declared a success."""


def pipe_through(
    df: DataFrame,
    argv: Sequence[str] | Sequence[Sequence[str]],
    success_on: Sequence[str] = ("0",),
    column: str = "line",
    on_error: str = "raise",
) -> DataFrame:
    """Run a program, or a chain of programs joined by pipes, on each partition of ``df``.

    ``column`` is written to standard input line by line.  The rows returned have ``source``
    'stdout' or 'stderr' for lines of these streams and 'status' for the exit of each
    partition's chain, whose code is that of its last program.  Codes are compared as strings
    with ``success_on``; another code fails the task, which Spark then retries, or with
    ``on_error='row'`` is reported in the status row.  The exception shows the first 20 lines of standard error; rows have
    all of them.  No shell is involved.  Rows are fed from one thread and streams are read by others, through a short queue, so
    memory does not grow with the partition.  Partitions without rows run nothing.

    Reading both streams and the status means persisting the result first.
    """
    chain = [list(argv)] if isinstance(argv[0], str) else [list(a) for a in argv]
    accepted = {str(code) for code in success_on}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = (b for b in batches if len(b))
        head = next(filled, None)
        if head is None:
            return
        partition = TaskContext.get().partitionId()

        def rows(source: str, lines: Iterable[str | None], code: int | None = None, good: bool | None = None):
            lines = list(lines)
            return pd.DataFrame({
                "source": source, "partition": partition, "line": pd.Series(lines, dtype=object),
                "exit_code": pd.array([code] * len(lines), dtype="Int32"),
                "accepted": pd.array([good] * len(lines), dtype="boolean"),
            })

        procs: list[subprocess.Popen] = []
        for command in chain:
            source = procs[-1].stdout if procs else subprocess.PIPE
            procs.append(subprocess.Popen(command, stdin=source, stdout=subprocess.PIPE, stderr=subprocess.PIPE))
            if len(procs) > 1:
                procs[-2].stdout.close()
        trouble: list[BaseException] = []
        said: queue.Queue = queue.Queue(maxsize=4)

        def feed() -> None:
            try:
                with procs[0].stdin as sink:
                    for batch in itertools.chain([head], filled):
                        text = "".join(f"{v}\n" for v in batch[column].fillna(""))
                        sink.write(text.encode())
            except BrokenPipeError:
                for _ in filled:  # the program stopped reading, as ``head`` does
                    pass
            except BaseException as error:
                trouble.append(error)

        def listen(source: str, stream: IO[bytes]) -> None:
            lines = (raw.decode(errors="replace").rstrip("\n") for raw in stream)
            while part := list(itertools.islice(lines, _BATCH)):
                said.put((source, part))
            said.put((source, None))

        streams = [("stdout", procs[-1].stdout), *[("stderr", p.stderr) for p in procs]]
        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        for source, stream in streams:
            threading.Thread(target=listen, args=(source, stream), daemon=True).start()
        first: list[str] = []
        open_streams = len(streams)
        try:
            while open_streams:
                source, lines = said.get()
                if lines is None:
                    open_streams -= 1
                    continue
                if source == "stderr":
                    first += lines[: 20 - len(first)]
                yield rows(source, lines)
            feeder.join()
            codes = [p.wait() for p in procs]
        finally:
            for p in procs:
                if p.poll() is None:
                    p.kill()
        if trouble:
            raise trouble[0]
        good = str(codes[-1]) in accepted
        if not good and on_error == "raise":
            message = "\n".join(first)
            raise ProgramFailed(f"{chain[-1][0]} ended with {codes[-1]}, accepted are {sorted(accepted)}: {message}")
        yield rows("status", [None], codes[-1], good)

    return df.select(F.col(column).cast("string")).mapInPandas(run, PROGRAM_ROWS)


def python_step(
    df: DataFrame, func: Callable[..., pd.DataFrame], schema: StructType | str, **kwargs
) -> DataFrame:
    """Apply ``func(batch, **kwargs)`` to batches of rows.  The function is shipped with its
    closure; persist the result to run it once for several readers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield func(batch, **kwargs)

    return df.mapInPandas(run, schema)


def python_table(
    df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, keep: Sequence[str] = ()
) -> DataFrame:
    """A Python table function: any number of rows for each row, a batch at a time.

    ``func`` returns rows whose index is the position of the input row that each belongs to; the columns ``keep`` of that
    row are put before them.  A row that is named by none gives none.
    """
    own = StructType([df.schema[c] for c in keep])
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            out = func(batch)
            kept = batch[list(keep)].take(out.index).reset_index(drop=True)
            yield pd.concat([kept, out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, StructType([*own.fields, *made.fields]))


def python_combine(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    fan_in: int = 64,
) -> DataFrame:
    """A Python aggregate of many rows into one per key, safe for keys of any size.

    ``partial`` reduces a batch, and ``merge`` rows of its own kind, to one row per key; both may see many keys at once and
    keep ``schema``.  Batches are reduced where they are read.  The partial rows of a key are
    spread over ``fan_in`` groups, merged, and merged again.
    """

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            part = partial(batch)
            held = part if held is None else merge(pd.concat([held, part], ignore_index=True))
            if len(held) > 100_000:  # many keys: pass them on instead of holding them
                yield held
                held = None
        if held is not None:
            yield held

    parts = df.mapInPandas(reduce_batches, schema)
    names = parts.columns
    spread = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    once = spread.groupBy(*keys, "_salt").applyInPandas(lambda g: merge(g[names]), schema)
    return once.groupBy(*keys).applyInPandas(lambda g: merge(g[names]), schema)


def output_contract(ports: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per task: declared outputs, missing ones, and whether the contract holds."""
    declared = ports.where("role = 'output' AND path <> ''").select("run_id", "task_id", "path").distinct()
    present = manifest.select("path").distinct().withColumn("there", F.lit(True))
    return declared.join(present, "path", "left").groupBy("run_id", "task_id").agg(
        F.count(F.lit(1)).alias("n_declared"), F.count_if(F.col("there").isNull()).alias("n_missing")
    ).withColumn("kept", F.col("n_missing") == 0)


def require_outputs(ports: DataFrame, manifest: DataFrame) -> None:
    """Raise if a declared output is missing; shows up to ten of them."""
    missing = missing_outputs(ports, manifest).select("path").take(10)
    if missing:
        raise FileNotFoundError("missing outputs: " + ", ".join(r["path"] for r in missing))
