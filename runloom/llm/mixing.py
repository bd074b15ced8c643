"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in seeded random order, read twice at most.  A document finishes at the virtual
time ``words of its source so far / target of the source``, so that at any virtual time all sources have given the same
part of their targets.  The mix is the documents in order of finish, cut where the total budget is reached: virtual time
1.  The one document of each source that is being read at the cut gives its leading words up to the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm import common
from runloom.session import stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
READS = 2
SEED = 29
_WORD = r"[^\x20\x09-\x0D]+"


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, reads: int = READS) -> DataFrame:
    """``source, source_size, weight, target`` from rows with ``source`` and ``size``.

    Sources by code point, null last, weigh ``weights`` in turn.  They share ``budget`` times all words by weight; no target
    is above ``reads`` times its source's words, and what is over goes to the others by weight until none is.
    One row for each source is all that is ordered here.
    """
    source, _ = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # strings compare by UTF-8 bytes, which is code point order
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    each = source.select("source", "source_size", weigh.alias("weight"), (F.lit(reads) * F.col("source_size")).alias("most"))
    # fill in order of how soon a source is full: a level is right once the next source would not be full at it
    ratio = F.col("most") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").isNull(), "source")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("most").over(earlier), F.lit(0))
    level = (F.lit(budget) * F.sum("source_size").over(everything) - full) / F.sum("weight").over(onward)
    return each.withColumn("_fits", F.when(ratio > level, level)).withColumn("_level", F.max("_fits").over(everything)).select(
        "source", "source_size", "weight",
        F.coalesce(F.least(F.col("most").cast("double"), F.col("_level") * F.col("weight")), F.col("most").cast("double")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, reads: int = READS, seed: int = SEED
) -> DataFrame:
    """One row for each document: ``doc_id, text_hash, source, size, source_size, target, taken, reads, finish``.

    ``taken`` is the number of its words in the mix, repeats counted; ``reads`` has the words of each reading and
    ``finish`` their virtual finish times, null for readings that are not taken.  Null and empty texts have no words and are not
    taken; a source of no words has target 0.  Rows that are equal in id and text are told apart by nothing and share
    their places in the queue in arbitrary order.  Extra columns are ignored; an empty table gives no rows.
    """
    sized, _ = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words().alias("size")), "sizes")
    goal, _ = stored(targets(sized, weights, budget, reads), "targets")
    turn = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    queue = common.running_total(
        sized.withColumn("_turn", turn), ["source"], ["_turn", "doc_id", "text_hash"], "size", "_before", "queue")
    met = queue.withColumnRenamed("source", "_source").join(
        goal, F.col("_source").eqNullSafe(F.col("source")))
    start = [F.col("_before") + F.lit(k) * F.col("source_size") for k in range(reads)]
    given = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - s)).cast("long") for s in start]
    finish = [F.when(g > 0, (s + g) / F.col("target")) for s, g in zip(start, given)]
    total = given[0]
    for g in given[1:]:
        total = total + g
    return met.select(
        "doc_id", "text_hash", F.col("_source").alias("source"), "size", "source_size", "target", total.alias("taken"),
        F.array(*given).alias("reads"), F.array(*finish).alias("finish"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document once for every reading, whole, in order of virtual finish time.

    Rows equal in id, text and source, which have as many places as there are of them, are the same row in each.  The cut falls inside one document of each source; that one is in when half of it or more is.  The rows are range-partitioned
    and sorted by finish time, with ``finish`` as a further column.
    """
    plan = mix(docs, **options)
    # a row for each reading; rows equal in id, text and source are one row of docs, so that the join multiplies nothing
    taken = plan.select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"), "size", F.explode(F.arrays_zip("reads", "finish")).alias("r")
    ).where("r.reads > 0 AND r.reads * 2 >= size").select("_doc", "_hash", "_source", F.col("r.finish").alias("finish"))
    marked = docs.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash", "source"])
    met = marked.join(
        taken, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("_text_hash").eqNullSafe(F.col("_hash"))
        & F.col("source").eqNullSafe(F.col("_source")))
    out = met.select(*docs.columns, "finish")
    return out.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")
