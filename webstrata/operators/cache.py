"""Page cache: freshness decisions and version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.operators import ordered
from webstrata.operators.robots import (
    DEFAULT_TTL, STABLE_FACTOR, VOLATILE_CAP, VOLATILE_FACTOR, clamp_ttl,
)


def decide(max_age: Column, min_age: Column, age: Column, has_data: Column) -> Column:
    """bypass / miss / hit / stale / error for one request.

    ``age`` is NULL when no entry was live; ``min_age`` asks for cached content
    only, so its miss is an error.
    """
    wants_max = F.coalesce(max_age > 0, F.lit(False))
    wants_min = F.coalesce(min_age > 0, F.lit(False))
    return (
        F.when(~wants_max & ~wants_min, F.lit("bypass"))
        .when(age.isNull() & wants_min, F.lit("error"))
        .when(age.isNull(), F.lit("miss"))
        .when(wants_min & ~has_data, F.lit("error"))
        .when(wants_max & (age >= max_age), F.lit("stale"))
        .otherwise(F.lit("hit"))
    )


def cache_decision(
    requests: DataFrame, entries: DataFrame, slices: int | None = None
) -> DataFrame:
    """Decision per request from the latest entry stored at or before it.

    ``requests``: request_id, url, ms, max_age_ms, min_age_ms; ``entries``: url,
    cached_ms, ttl_ms, has_data. An as-of match: both are laid on one time line
    per URL and the last entry is carried forward, so a popular URL costs the
    sum of its rows, not the product.
    """
    key = U.url_sha(F.col("url")).alias("key")
    line = requests.select(
        key, F.col("ms").alias("at"), F.lit(1).alias("kind"), "request_id", "url",
        "max_age_ms", "min_age_ms",
    ).unionByName(
        entries.select(
            key, F.col("cached_ms").alias("at"), F.lit(0).alias("kind"),
            F.struct("cached_ms", "ttl_ms", "has_data").alias("entry"),
        ),
        allowMissingColumns=True,
    )
    sliced = ordered.with_slices(line, ["key"], ["at", "kind"], slices)
    carried = ordered.carry_last(sliced, ["key"], ["at", "kind"], "entry", "latest", include_current=True)
    live = is_live(F.col("at"), F.col("latest.cached_ms"), F.col("latest.ttl_ms"))
    age = F.when(live, F.col("at") - F.col("latest.cached_ms"))
    return carried.where("kind = 1").select(
        "request_id", "url", age.alias("age_ms"),
        decide(F.col("max_age_ms"), F.col("min_age_ms"), age, F.coalesce("latest.has_data", F.lit(False))).alias("decision"),
    )


def ttl_seconds(ttl_ms: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(ttl_ms / 1000)).cast("long")


def is_live(now_ms: Column, cached_ms: Column, ttl_ms: Column) -> Column:
    return now_ms < cached_ms + ttl_seconds(ttl_ms) * 1000


def live_entries(entries: DataFrame, now_ms: Column) -> DataFrame:
    return entries.where(is_live(now_ms, F.col("cached_ms"), F.col("ttl_ms")))


def cache_age_ms(entries: DataFrame, now_ms: Column) -> DataFrame:
    return entries.withColumn("age_ms", now_ms - F.col("cached_ms"))


def freshness_history(
    versions: DataFrame, key: str, order: list[str], text: str,
    slices: int | None = None,
) -> DataFrame:
    """Adds content_hash, fetch_count, first_fetched (order value), change_count.

    The text itself is read once, for its hash, and left out of the result.
    """
    hashed = versions.withColumn("content_hash", F.sha2(F.col(text), 256)).drop(text)
    sliced = ordered.with_slices(hashed, [key], order, slices)
    before = ordered.previous(sliced, [key], order, ["content_hash", *order[:1]])
    changed = F.when(F.col("prev.content_hash") != F.col("content_hash"), 1).otherwise(0)
    counted = ordered.running_sum(before, [key], order, changed, "change_count")
    counted = ordered.running_sum(counted, [key], order, F.lit(1), "fetch_count")
    # The first version marks itself and is carried along: no join back on the key.
    marked = counted.withColumn("__first", F.when(F.col("prev").isNull(), F.col(order[0])))
    carried = ordered.carry_last(marked, [key], order, "__first", "first_fetched", include_current=True)
    return ordered.unsliced(carried).withColumn("has_prior", F.col("prev").isNotNull()).drop("prev", "__first")


def adaptive_ttl(history: DataFrame, base_ttl: Column | None = None) -> DataFrame:
    """Adds ``ttl``: stable pages live longer, volatile ones shorter; adapter rows are not cached."""
    changes = F.col("change_count")
    factor = (
        F.when((changes == 0) & F.col("has_prior"), STABLE_FACTOR)
        .when(changes >= 3, VOLATILE_FACTOR).otherwise(1.0)
    )
    ttl = clamp_ttl(F.lit(DEFAULT_TTL) if base_ttl is None else base_ttl, factor)
    capped = F.when(changes >= 5, F.least(ttl, F.lit(VOLATILE_CAP))).otherwise(ttl)
    cached = history.where("source <> 'adapter'") if "source" in history.columns else history
    return cached.withColumn("ttl", capped)
