"""Running values in order within a key, safe for keys of any size.

A window partitioned by key puts each key into one task. Here a table is
range-partitioned by key, order and row number first and written once, so its
partitions are slices of bounded size that follow each other: a key with most
rows spans many slices, and so do rows that agree in key and order. Every
(key, slice) group is scanned on its own, and what a slice inherits from earlier
slices of its key comes from a summary. Only the first key of a slice can go on
from an earlier one, so that summary has at most one row per slice. The table is
bucketed by slice: scans of its groups, one after the other, read it in place.
There is one path at every table size; NULL keys are a key like any other and
NULL order values come first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.session import bucketed

SLICE, ROW = "__slice", "__row"


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def epoch_ms(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / 1000).cast("long")


def with_slices(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Adds the slice and a row number; written below the checkpoint folder.

    ``slices`` sets the number of partitions, which otherwise follows the
    session (``spark.sql.shuffle.partitions`` and adaptive execution). The
    number changes the layout, never a result.
    """
    columns = [*keys, *order, ROW]
    marked = df.withColumn(ROW, F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(slices, *columns) if slices else marked.repartitionByRange(*columns)
    return bucketed(dealt.withColumn(SLICE, F.spark_partition_id()), SLICE)


def unsliced(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, ROW)


def join_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """``summary`` beside the rows of its (key, slice); NULL keys match.

    ``summary`` has rows of keys that span slices only, one per (key, slice): at
    most two such keys touch a slice, so it is sent to the tasks.
    """
    on = [*keys, SLICE]
    renamed = summary.select(
        *[F.col(f"`{c}`").alias(f"__s_{c}") for c in on],
        *[F.col(c) for c in summary.columns if c not in on],
    )
    match = reduce(and_, [df[f"`{c}`"].eqNullSafe(renamed[f"`__s_{c}`"]) for c in on])
    return df.join(F.broadcast(renamed), match, "left").drop(*[f"__s_{c}" for c in on])


def _local(keys: list[str], order: list[str], end: int):
    return Window.partitionBy(*keys, SLICE).orderBy(*order, ROW).rowsBetween(Window.unboundedPreceding, end)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def carry_last(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, include_current: bool
) -> DataFrame:
    """Last non-null ``value`` up to (or before) each row of its key, over a sliced table."""
    end = Window.currentRow if include_current else -1
    summary = (
        df.groupBy(*keys, SLICE)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order, ROW))).alias("__v"))
        .withColumn("__carry", F.last("__v", ignorenulls=True).over(_earlier(keys))).drop("__v")
        .where("__carry IS NOT NULL")
    )
    scanned = df.withColumn(out, F.last(value, ignorenulls=True).over(_local(keys, order, end)))
    return join_summary(scanned, summary, keys).withColumn(out, F.coalesce(out, "__carry")).drop("__carry")


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str = "prev") -> DataFrame:
    """Struct ``out`` with ``columns`` of the row before; NULL on the first row."""
    packed = df.withColumn("__pack", F.struct(*columns))
    return carry_last(packed, keys, order, "__pack", out, include_current=False).drop("__pack")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to this row, over a sliced table."""
    valued = df.withColumn("__value", value)
    summary = (
        valued.groupBy(*keys, SLICE).agg(F.sum("__value").alias("__s"))
        .withColumn("__before", F.sum("__s").over(_earlier(keys))).drop("__s")
        .where("__before IS NOT NULL")
    )
    scanned = valued.withColumn(out, F.sum("__value").over(_local(keys, order, 0))).drop("__value")
    # NULL values count as nothing; the sum stays NULL until the first known one.
    both = F.col(out).isNotNull() & F.col("__before").isNotNull()
    total = F.when(both, F.col(out) + F.col("__before")).otherwise(F.coalesce(out, "__before"))
    return join_summary(scanned, summary, keys).withColumn(out, total).drop("__before")


def rank_in_key(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position in order within the key."""
    return unsliced(running_sum(with_slices(df, keys, order), keys, order, F.lit(1), out))


def _counts(sliced: DataFrame) -> list[tuple[int, int]]:
    """(slice, rows) in order: one row per partition of the table."""
    return sorted((r[SLICE], r["count"]) for r in sliced.groupBy(SLICE).count().collect())


def rows_between(df: DataFrame, order: list[str], start: int, stop: int, slices: int | None = None) -> DataFrame:
    """Rows ``start`` .. ``stop`` (exclusive) in order.

    Slices wholly inside the range are taken as they are; only the slices at
    its two ends are sorted, so neither a deep offset nor a large limit sorts
    or gathers the table.
    """
    sliced = with_slices(df, [], order, slices)
    whole, ends, seen = [], [], 0
    for number, rows in _counts(sliced):
        low, high = max(start - seen, 0), min(stop - seen, rows)
        if low == 0 and high == rows:
            whole.append(number)
        elif low < high:
            part = sliced.where(F.col(SLICE) == number).orderBy(*order, ROW)
            ends.append(part.offset(low).limit(high - low))
        seen += rows
    out = sliced.where(F.col(SLICE).isin(whole or [-1]))
    for part in ends:
        out = out.unionByName(part)
    return unsliced(out)


def _below(value: Column, other: Column) -> Column:
    return (value.isNull() & other.isNotNull()) | F.coalesce(value < other, F.lit(False))


def kth_smallest_cut(df: DataFrame, score: str, tie: str, k: int, slices: int | None = None) -> Column:
    """Condition that holds for exactly the ``k`` lowest rows by (score, tie), NULL first.

    ``tie`` is unique and of any type that sorts; the condition is never NULL. The two columns are sliced
    once, the slice of the k-th row is found by counting, and that row gives the
    cut; nothing but it reaches the driver.
    """
    if k <= 0:
        return F.lit(False)
    sliced = with_slices(df.select(score, tie), [], [score, tie], slices)
    for number, rows in _counts(sliced):
        if rows >= k:
            part = sliced.where(F.col(SLICE) == number).orderBy(score, tie)
            edge = part.offset(k - 1).limit(1).first()
            kind = dict(df.dtypes)
            at, last = F.lit(edge[score]).cast(kind[score]), F.lit(edge[tie]).cast(kind[tie])
            same = F.col(score).eqNullSafe(at)
            return _below(F.col(score), at) | (same & (_below(F.col(tie), last) | F.col(tie).eqNullSafe(last)))
        k -= rows
    return F.lit(True)
