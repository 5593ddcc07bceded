"""Change detection over page versions and search results."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.operators import ordered, ranking

DIFF_LINES = 100
HISTORY = 50


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified diff with three context lines, at most 100 lines."""
    def one(a, b):
        lines = difflib.unified_diff(
            (a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True),
            fromfile="previous", tofile="current", n=3,
        )
        return "".join(line for line, _ in zip(lines, range(DIFF_LINES)))

    return pd.Series([one(a, b) for a, b in zip(old, new)])


def detect_changes(
    versions: DataFrame, monitor: str, order: str, text: str, with_diff: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """(all columns but the text, changed, last_result, previous_length, current_length).

    Windows see hashes and lengths; ``with_diff`` adds ``text`` and ``diff``,
    and only then do the texts of changed rows meet, by ``order``, which is
    unique within the table.
    """
    keyed = versions.withColumns({"__sha": F.sha2(F.col(text), 256), "__len": F.length(text)}).drop(text)
    before = ordered.previous(
        ordered.with_slices(keyed, [monitor], [order], slices), [monitor], [order], [order, "__sha", "__len"]
    )
    changed = F.coalesce(
        (F.col("prev.__len") > 0) & (F.col("prev.__sha") != F.col("__sha")), F.lit(False)
    )
    out = ordered.unsliced(before).withColumn("changed", changed).withColumns({
        "last_result": F.when(F.col("changed"), "changed").otherwise("unchanged"),
        "previous_length": F.when(F.col("changed"), F.col("prev.__len")),
        "current_length": F.when(F.col("changed"), F.col("__len")),
        "__before": F.when(F.col("changed"), F.col(f"prev.{order}")),
    }).drop("prev", "__sha", "__len")
    if with_diff:
        old = versions.select(F.col(order).alias("__before"), F.col(text).alias("__old"))
        out = out.join(versions.select(order, text), order).join(old, "__before", "left")
        # Unchanged rows send two empty strings to Python instead of two pages.
        pair = [F.when(F.col("changed"), c).otherwise("") for c in (F.col("__old"), F.col(text))]
        out = out.withColumn("diff", unified_diff(*pair)).drop("__old")
    return out.drop("__before")


def change_stats(versions: DataFrame, monitor: str, order: str, text: str, slices: int | None = None) -> DataFrame:
    """(order, added, removed): distinct lines against the version before.

    The window sees ids only; each pair of texts meets in two joins by id.
    """
    ids = ordered.with_slices(versions.select(monitor, order), [monitor], [order], slices)
    pairs = ordered.previous(ids, [monitor], [order], [order]).select(order, F.col(f"prev.{order}").alias("__before"))
    old = versions.select(F.col(order).alias("__before"), F.col(text).alias("__old"))
    both = pairs.join(versions.select(order, text), order).join(old, "__before", "left")
    added, removed = diff_stats(F.col("__old"), F.col(text))
    return both.select(order, added.alias("added"), removed.alias("removed"))


def diff_stats(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) distinct lines."""
    a, b = F.split(F.coalesce(old, F.lit("")), "\n"), F.split(new, "\n")
    return F.size(F.array_except(b, a)), F.size(F.array_except(a, b))


def check_history(checks: DataFrame, monitor: str, order: list, keep: int = HISTORY) -> DataFrame:
    """Last ``keep`` checks per monitor."""
    return ranking.top_k(checks, [monitor], order, keep)


def new_results(results: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose URL was not seen before."""
    return results.where(F.col("url") != "").join(seen.select(*keys, "url").distinct(), [*keys, "url"], "left_anti")


def monitor_status(monitors: DataFrame, checks: DataFrame, monitor: str, order: Column) -> DataFrame:
    """Monitors with the result of their last check."""
    last = checks.groupBy(monitor).agg(
        F.max_by("result", order).alias("last_result"), F.max(order).alias("last_checked")
    )
    return monitors.join(last, monitor, "left")
