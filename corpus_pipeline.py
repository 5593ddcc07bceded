"""Training corpus pipeline: quality, language, near-duplicates, mixing, packing.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import langid, mixing, near, packing, quality
from webstrata.llm.shared import ship_package
from webstrata.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 and more)."""
    ship_package(spark)
    return quality.accept(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (not ``und``)."""
    ship_package(spark)
    return langid.accept(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    ship_package(spark)
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each source to its target."""
    ship_package(spark)
    return mixing.mixed(docs, exact=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_language),
    ("simhash near-dedup", keep_distinct),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over everything its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
