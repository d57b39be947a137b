"""Registry of the analytics queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def register(fn):
        _QUERIES[name] = fn
        if sql:
            _ORACLES[name] = sql
        return fn

    return register


@query(
    "a03_multi_outlet_share",
    """WITH e AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
    SELECT count(*) AS events, count(*) FILTER (WHERE n >= 2) AS multi,
           round(count(*) FILTER (WHERE n >= 2) / nullif(count(*), 0), 6) AS share FROM e""",
)
def a03_multi_outlet_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level distinct-outlet share."""
    per_event = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.countDistinct("l_suppkey").alias("n"))
    )
    return per_event.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("n") >= 2).alias("multi"),
        F.round(F.try_divide(F.count_if(F.col("n") >= 2), F.count("*")), 6).alias("share"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
