"""Logical tables bound to the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.catalog import table

#: SQL of each view, for ``WITH`` clauses of the oracles.
SQL = {
    "v_assertions": "SELECT l_partkey AS item, l_orderkey AS event, l_suppkey AS outlet, l_shipdate AS created_at FROM lineitem",
    "v_items": "SELECT event_id AS id, ts AS created_at, user_id AS outlet, event_type AS kind, props AS body, value FROM events",
    "v_polls": "SELECT user_id AS source, ts AS polled_at, CASE WHEN event_type = 'error' THEN event_type END AS failure, value AS entries FROM events",
    "v_prices": "SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1, 2",
    "v_sentiment": "SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, round(avg(l_discount), 6) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
}


def sql_with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    if name == "v_assertions":
        return t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("outlet"), F.col("l_shipdate").alias("created_at"))
    if name == "v_items":
        return t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("outlet"), F.col("event_type").alias("kind"), F.col("props").alias("body"), "value")
    if name == "v_polls":
        return t("events").select(F.col("user_id").alias("source"), F.col("ts").alias("polled_at"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("failure"), F.col("value").alias("entries"))
    day = F.to_date("o_orderdate").alias("date")
    if name == "v_prices":
        return t("orders").groupBy(F.col("o_orderpriority").alias("key"), day).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))
    if name == "v_sentiment":
        both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return both.groupBy(F.col("o_orderpriority").alias("key"), day).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    raise KeyError(name)
