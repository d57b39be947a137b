"""Queries on budgets, the triage pass, the writing of a batch and the density sweep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import graph, passes, topk
from tidewater.plans.catalog import query, table

_BUDGET_SQL = """SELECT o_custkey AS key, least(9000.0, balance + 100.0 * greatest(0.0, (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(since)) / 86400e6)) AS balance
  FROM (SELECT o_custkey, min(o_totalprice) - 5000 AS balance, max(o_orderdate) AS since FROM orders GROUP BY 1)"""


@query("t21_open_budget", _BUDGET_SQL)
def t21(spark, d):
    state = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg((F.min("o_totalprice") - 5000).alias("balance"), F.max("o_orderdate").alias("at"))
    got = passes.open_budget(state.withColumn("exhausted_on", F.lit(None).cast("string")), F.lit("1998-01-01").cast("timestamp"), 100.0, 90.0)
    return got.select("key", "balance")


@query("t02_triage_pass", """WITH p AS (SELECT user_id AS key, event_id AS item, CASE WHEN value < 5 THEN 'stale' WHEN event_type = 'view' THEN 'quote_page' WHEN event_type = 'purchase' THEN 'tracked_claim' END AS reason FROM events),
  q AS (SELECT key, item, CAST(floor((row_number() OVER (PARTITION BY key ORDER BY item DESC) - 1) / 3) AS BIGINT) AS batch, item % 11 + 1 AS cost FROM p WHERE reason IS NULL),
  b AS (SELECT key, batch, sum(cost) AS cost, bool_or(item % 31 = 0) AS failed FROM q GROUP BY 1, 2),
  s AS (SELECT key, batch, failed, coalesce(sum(cost) OVER (PARTITION BY key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b)
  SELECT key, item, CASE reason WHEN 'stale' THEN 'stale' WHEN 'quote_page' THEN 'immaterial' ELSE 'material' END AS verdict, reason FROM p WHERE reason IS NOT NULL
  UNION ALL SELECT q.key, item, CASE WHEN failed THEN 'failed' WHEN item % 3 = 0 THEN 'material' ELSE 'immaterial' END, CASE WHEN failed THEN 'error' WHEN item % 3 = 0 THEN 'topical' ELSE 'none' END
  FROM q JOIN s USING (key, batch) WHERE spent < 20 + q.key % 20""")
def t02(spark, d):
    e = table(spark, d, "events").withColumnsRenamed({"user_id": "key", "event_id": "item"})
    pending = e.select("key", "item", (F.col("value") < 5).alias("stale"), (F.col("event_type") == "view").alias("quote"))
    rules = e.filter("event_type = 'purchase'").select("item", F.lit("tracked_claim").alias("reason"))
    replies = e.select("item", (F.col("item") % 3 == 0).alias("material"), (F.col("item") % 31 == 0).alias("failed"), (F.col("item") % 11 + 1).alias("cost"))
    budget = e.select("key").distinct().withColumn("balance", F.col("key") % 20 + 20)
    return passes.triage_pass(pending, rules, replies, budget, 3).select("key", "item", "verdict", "reason")


@query("s49_write_batch")
def s49(spark, d):
    """Orders as requests and their lines as items: known parts, parts told before under a label, and new ones."""
    line = table(spark, d, "lineitem").withColumn("item", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn("item", F.to_json("item")).dropDuplicates(["item"])
    label = F.concat(F.lit("n"), (F.col("l_partkey") % 3).cast("string"))
    items = line.select(F.col("l_orderkey").alias("request"), "item", F.col("l_linenumber").alias("position"), F.col("l_shipdate").cast("timestamp").alias("published_at"))
    events = line.select(
        "item", F.lit(0).alias("position"), F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("candidate_id"), F.when(F.col("l_returnflag") == "R", label).alias("new_ref"),
        F.when(F.col("l_returnflag") == "N", label).alias("new_label"), F.lit("").alias("summary"), F.col("l_linestatus").alias("type"), F.col("l_returnflag").alias("standing"), (F.col("l_quantity") > 1).alias("valid"),
    )
    entities = line.filter("l_discount > 0").select("item", F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("entity"))
    batch = passes.resolved_batch(items, events, entities, items.select("item").limit(0), F.lit("1999-01-01").cast("timestamp"))
    return passes.new_assertions(batch, batch.select("item", F.lit("").alias("event")).limit(0))


@query("a56_density_sweep")
def a56(spark, d):
    """Purchases next to each other in a day are pairs; a request holds five items, by time or by user."""
    e = table(spark, d, "events").select(F.col("event_id").alias("item"), F.to_date("ts").alias("day"), "ts", "user_id", "event_type")
    bought = e.filter("event_type = 'purchase'")
    pairs = bought.select(F.col("item").alias("a"), F.lead("item").over(Window.partitionBy("day").orderBy("ts", "item")).alias("b")).filter("b IS NOT NULL")
    items = e.join(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct().withColumn("paired", F.lit(True)), "item", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))

    def measure(kept):
        live = graph.visible(pairs, topk.chunked(kept, ["day"], ["ts", "item"], 5), "day", "chunk", False).withColumnRenamed("visible", "baseline")
        batch = graph.visible(pairs, topk.chunked(kept, ["day"], ["user_id", "item"], 5), "day", "chunk", True)
        return live.join(batch, ["a", "b"]).select(F.lit("by_user").alias("variant"), "baseline", "visible")

    got = passes.density_sweep(items, F.col("paired"), F.col("day"), [5, 15], ["a", "b"], measure)
    return got.select("rate", "variant", *[F.round(c, 6).alias(c) for c in ("per_hour", "baseline", "baseline_min", "baseline_max", "share", "gap")], "within")
