"""Counters, histograms, gauges, quantiles and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators import ordered

MINUTE_US = 60_000_000


def counter(events: DataFrame, labels: Sequence[str], amount: Column | None = None) -> DataFrame:
    return events.groupBy(*labels).agg(F.sum(F.lit(1) if amount is None else amount).alias("value"))


def histogram(events: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float]) -> DataFrame:
    """(labels, le, cumulative, total_count, total_sum); the last bucket is +Inf.

    One pass with one conditional sum per bucket; rows are not multiplied by
    the buckets.
    """
    bounds = sorted(buckets)
    sums = [
        F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"__b{i}") for i, b in enumerate(bounds)
    ]
    agg = events.groupBy(*labels).agg(
        *sums, F.count(value).alias("total_count"), F.sum(value).alias("total_sum")
    )
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("total_count").alias("cumulative"))]
    return agg.select(
        *labels, F.explode(F.array(*rows)).alias("b"), "total_count", "total_sum"
    ).select(*labels, "b.le", "b.cumulative", "total_count", "total_sum")


def gauge(events: DataFrame, labels: Sequence[str], value: str, order: list[str]) -> DataFrame:
    """Last value per label set."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def histogram_quantiles(
    events: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float],
    quantiles: Sequence[float] = (0.5, 0.95, 0.99), decimals: int = 6,
) -> DataFrame:
    """Quantiles interpolated inside histogram buckets, one column per quantile."""
    bounds = [float(b) for b in sorted(buckets)]
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"__b{i}") for i, b in enumerate(bounds)]
    agg = events.groupBy(*labels).agg(*sums, F.count(value).alias("__n"))

    def at(q: float) -> Column:
        rank = F.lit(q) * F.col("__n")
        out = F.lit(bounds[-1])
        for i in range(len(bounds) - 1, -1, -1):
            below = F.col(f"__b{i - 1}") if i else F.lit(0)
            low = F.lit(bounds[i - 1]) if i else F.lit(min(0.0, bounds[0]))
            inside = low + (F.lit(bounds[i]) - low) * (rank - below) / (F.col(f"__b{i}") - below)
            # An empty bucket is only reached at rank 0, where its lower end counts.
            value_i = F.when(F.col(f"__b{i}") > below, inside).otherwise(low)
            out = F.when(F.col(f"__b{i}") >= rank, value_i).otherwise(out)
        return F.round(out, decimals).alias(f"p{int(q * 100)}")

    return agg.select(*labels, *[at(q) for q in quantiles])


def approx_quantiles(events: DataFrame, labels: Sequence[str], value: str, quantiles=(0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Sketch quantiles: bounded memory per group, mergeable across partitions."""
    found = events.groupBy(*labels).agg(
        F.percentile_approx(value, list(quantiles), accuracy).alias("q")
    )
    return found.select(*labels, *[F.col("q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(quantiles)])


def sliding_rates(events: DataFrame, label: str, us: str, minutes: int = 5) -> DataFrame:
    """(label, minute, rate): events per second over the ``minutes`` ending with each minute.

    Events are first counted per minute; only those counts are spread over the
    windows they belong to.
    """
    per_minute = events.groupBy(label, F.floor(F.col(us) / MINUTE_US).cast("long").alias("m")).agg(
        F.count("*").alias("n")
    )
    spread = per_minute.select(
        label, "n", F.explode(F.sequence(F.col("m"), F.col("m") + (minutes - 1))).alias("minute")
    )
    return spread.groupBy(label, "minute").agg((F.sum("n") / (minutes * 60.0)).alias("rate"))


def error_rate_alerts(
    events: DataFrame, label: str, us: str, threshold: float = 0.1, hold: int = 5, minutes: int = 5
) -> DataFrame:
    """(label, started, ended, minutes): runs of at least ``hold`` minutes above the threshold."""
    hot = sliding_rates(events, label, us, minutes).where(F.col("rate") > threshold)
    # Consecutive minutes share (minute - position).
    placed = ordered.rank_in_key(hot, [label], ["minute"], "__n")
    runs = placed.groupBy(label, (F.col("minute") - F.col("__n")).alias("__run")).agg(
        F.min("minute").alias("started"), F.max("minute").alias("ended"), F.count("*").alias("minutes")
    )
    return runs.where(F.col("minutes") >= hold).drop("__run")


def threshold_alerts(samples: DataFrame, label: str, us: str, order: str, breach: Column, hold_seconds: int) -> DataFrame:
    """(label, started_us, fired_us, samples): breaches that last ``hold_seconds``.

    A breach starts at its first breaching sample and ends with the first good one.
    """
    flagged = ordered.with_slices(samples.withColumn("__bad", breach), [label], [us, order])
    before = ordered.previous(flagged, [label], [us, order], ["__bad"])
    starts = F.col("__bad") & ~F.coalesce("prev.__bad", F.lit(False))
    marked = before.withColumn("__start", F.when(starts, F.struct(us, order)))
    runs = ordered.unsliced(ordered.carry_last(marked, [label], [us, order], "__start", "__run", True))
    held = F.col(us) - F.col(f"__run.{us}") >= hold_seconds * 1_000_000
    return runs.where("__bad").groupBy(label, "__run").agg(
        F.min(F.when(held, F.col(us))).alias("fired_us"), F.count("*").alias("samples")
    ).where("fired_us IS NOT NULL").select(label, F.col(f"__run.{us}").alias("started_us"), "fired_us", "samples")


def mean_latency(events: DataFrame, label: str, us: str, value: str, minutes: int = 60) -> DataFrame:
    """(label, window_no, mean): sum over count per tumbling window."""
    window = F.floor(F.col(us) / (MINUTE_US * minutes)).cast("long").alias("window_no")
    return events.groupBy(label, window).agg(
        F.round(F.sum(value) / F.count(value), 6).alias("mean")
    )


def distinct_counts(rows: DataFrame, group: str, value: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(value) if approximate else F.countDistinct(value)
    return rows.groupBy(group).agg(count.alias("distinct_values"))
