"""Order-dependent columns that stay parallel inside one group.

A window puts each group into one task.  Here every group is cut into slices by expressions that never
decrease along the sort order (a day, an hour, a block of sequence numbers; nulls come first).  The window runs per slice, and
what the other slices contribute is added from one row per slice.  All groups are treated alike, whatever
their size.  Keys and slices are compared as structures, in which null equals null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import stored

#: Rows of a group that one window ranks; longer groups are cut into slices.
GROUP_ROWS = 100_000
#: Buckets in which the rows of groups are counted before any group is.
BUCKETS = 1 << 14
_PLACE = ["_key", "_slice"]


def _sliced(df: DataFrame, keys: Sequence[str], slices: Sequence[Column]) -> DataFrame:
    return df.select(
        *df.columns, F.struct(*keys).alias("_key"), F.struct(*[s.alias(f"s{i}") for i, s in enumerate(slices)]).alias("_slice"))


def _inside(order: Sequence[str | Column]):
    return Window.partitionBy(*_PLACE).orderBy(*order)


def _along():
    return Window.partitionBy("_key").orderBy("_slice")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slices: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` from the first row of the group to the current one."""
    cut = _sliced(df.withColumn("_v", value), keys, slices)
    before = _along().rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*_PLACE).agg(F.sum("_v").alias("_total")).select(*_PLACE, F.sum("_total").over(before).alias("_carry"))
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum("_v").over(upto))
    total = F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(F.col("_carry") + F.coalesce("_local", F.lit(0)))
    return local.join(carry, _PLACE).select(*df.columns, total.alias(out))


def row_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slices: Sequence[Column], out: str
) -> DataFrame:
    """1-based position of each row in its group."""
    return running_sum(df, keys, order, slices, F.lit(1).cast("long"), out)


def long_groups(df: DataFrame, keys: Sequence[str], rows: int) -> tuple[DataFrame, int]:
    """The groups with more than ``rows`` rows, null keys included, and how many they are.

    Rows are first counted by a hash of their group, which shuffles a few numbers a task: a bucket of no more than ``rows`` rows has
    no long group.  Only the groups of larger buckets are counted one by one.  ``df`` is read once, or twice if there are such buckets.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    full = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select("_bucket")
    full, (n_full,) = stored(full, "full-buckets", F.count(F.lit(1)))
    some = df.select(*keys, bucket).join(full, "_bucket", "left_semi") if n_full else df.select(*keys).where("false")
    long = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select(*keys)
    if not n_full:
        return long, 0
    long, (n_long,) = stored(long, "long-groups", F.count(F.lit(1)))
    return long, n_long


def rank_by_size(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slices: Sequence[Column], out: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """:func:`row_rank` where most groups are small: those of up to ``group_rows`` rows are ranked by one window, without slices and
    without a join, and only longer ones are cut.  ``df`` is read again for the sizes of its groups."""
    long, n_long = long_groups(df, keys, group_rows)
    long = long.select(F.struct(*keys).alias("_long"))

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))

    if not n_long:
        return whole(df)
    mine = F.struct(*keys) == F.col("_long")
    return whole(df.join(long, mine, "left_anti")).unionByName(row_rank(df.join(long, mine, "left_semi"), keys, order, slices, out))


def fill_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """:func:`fill_forward` for groups that are known to be small: one window, no slices and no join."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slices: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """Replace nulls by the last value seen before them in the group."""
    position = F.struct(*order)
    cut = _sliced(df, keys, slices)
    before = _along().rowsBetween(Window.unboundedPreceding, -1)
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy(*_PLACE).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_end_{c}") for c in columns])
    carry = ends.select(*_PLACE, *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
    local = cut.select("*", *[F.last(c, ignorenulls=True).over(upto).alias(f"_fill_{c}") for c in columns])
    return local.join(carry, _PLACE).select(*[
        F.coalesce(f"_fill_{c}", f"_carry_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slices: Sequence[Column], value: str, out: str
) -> DataFrame:
    """``value`` of the following row in the group, null on the last one."""
    cut = _sliced(df, keys, slices)
    first = cut.groupBy(*_PLACE).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
    carry = first.select(*_PLACE, F.lead("_first").over(_along()).alias("_carry"))
    local = cut.withColumn("_row", F.lead(F.struct(F.col(value).alias("v"))).over(_inside(order)))
    return local.join(carry, _PLACE).select(*df.columns, F.coalesce("_row", "_carry").getField("v").alias(out))
