"""Table reader for a folder of parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_KEYS = {"pages": "page_id", "documents": "doc_id"}


class Tables:
    """``tables.pages`` reads ``<folder>/pages.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df, TABLE_KEYS[name]) if name in TABLE_KEYS else df

    def plain(self, name: str) -> DataFrame:
        """The table as stored, for work that does not read its text."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose ``{name}`` markers stand for tables of the folder."""
        heavy = re.search(r"\b(?:html|text)\b", text) is not None
        for name in set(re.findall(r"\{([a-z]+)\}", text)):
            view = f"webstrata_{name}_{abs(hash((self.folder, heavy))) % 10**9}"
            (getattr(self, name) if heavy else self.plain(name)).createOrReplaceTempView(view)
            text = text.replace("{" + name + "}", view)
        return self.spark.sql(text)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give text-heavy tables at least one partition per core.

    A table stored as one small file arrives as one task, yet parsing its text
    is the costly part. Large tables already have more splits than cores and
    are left alone, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _size(df) > cores * 4 * 2**20:
        return df
    return df.repartition(cores, F.col(key))


def _size(df: DataFrame) -> int:
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))
