"""Top-k choices per query.

Every ranking is ``row_number() <= k`` straight above its window, so Spark
applies the limit inside each input partition before the shuffle: a query that
owns a third of all rows sends at most k rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import urls as U


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1, "__first").drop("__first")


def rank_urls(df: DataFrame, key: str, pos: str, url: str = "url", max_urls: int = 20) -> DataFrame:
    """Best ``max_urls`` per query by extractability; equal scores keep input order."""
    scored = df.withColumn("score", U.score_url(F.col(url))).where("score > -1000")
    return top_k(scored, [key], [F.desc("score"), pos], max_urls).select(
        key, pos, url, "score", "rank"
    )


def pick_sources(df: DataFrame, key: str, pos: str, url: str = "url", min_sources: int = 3) -> DataFrame:
    """Successful text sources first, video platforms only to fill up."""
    usable = df.where("success").withColumn("video", U.is_video_platform(F.col(url)))
    return top_k(usable, [key], ["video", pos], min_sources).select(
        key, pos, url, "video", "rank"
    )


def first_successes(df: DataFrame, job: str, finished: list, n: int) -> DataFrame:
    """Early stop of a batch: the first ``n`` successes in completion order."""
    return top_k(df.where("success"), [job], finished, n)


def merge_results(df: DataFrame, key: str, order: list[str], limit: int, url: str = "url") -> DataFrame:
    """One row per URL of a query (first list, first position wins), then a cap."""
    firsts = first_per_key(df.where(F.col(url) != ""), [key, url], order)
    return top_k(firsts, [key], order, limit)
