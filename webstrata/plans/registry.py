"""Registry of runnable queries and their ANSI counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.session import ship_package
from webstrata.sources.tables import Tables

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a builder; ``{table}`` markers in the SQL become table names."""

    def wrap(build):
        BUILDERS[name] = build
        if oracle is not None:
            ORACLES[name] = plain(oracle)
        return build

    return wrap


def plain(sql: str) -> str:
    for t in (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split():
        sql = sql.replace("{" + t + "}", t)
    return sql


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = BUILDERS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(Tables(spark, folder))

    run.__name__ = name
    return run
