"""Where queries and their SQL are kept, and where their tables are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mergelake.sources.store import scratch_folder
from mergelake.table import Table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of its rows."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return keep


def both(name: str, sql: str) -> None:
    """Registers SQL that Spark and the oracle read alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder for a query's tables."""
    return scratch_folder(spark, "tables")


def table(spark: SparkSession, like: DataFrame, **how) -> Table:
    return Table.create(spark, f"{workspace(spark)}/t", like, **how)
