"""Queries on triage, candidates, duplicate ceilings and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import integration
from tidewater.plans.catalog import query, table


@query("p08_rule_triage", """SELECT l_orderkey, l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) = 1""")
def p08(spark, d):
    return integration.triage_by_rules(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], ["l_linenumber"], ["A", "R"])


@query("p38_picked_entity", """SELECT o_custkey, o_orderkey FROM orders WHERE upper(substr(o_orderpriority, 3)) = 'MEDIUM'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) = 1""")
def p38(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.substring("o_orderpriority", 3, 20).alias("ticker"), F.lit("medium").alias("wanted"), F.when(F.col("o_orderstatus") == "F", "PUBLIC").alias("kind"), F.struct("o_orderdate", "o_orderkey").alias("position")
    )
    return integration.picked_entity(o, "o_custkey", "wanted", "ticker", "kind", "o_orderkey", "position")


def _pool(spark, d):
    """Orders as events with suppliers as entities; customers ask for the suppliers of their parts on one day."""
    day = lambda c: F.col(c).cast("timestamp_ntz")
    o = table(spark, d, "orders")
    events = o.select(F.col("o_orderkey").alias("event"), day("o_orderdate").alias("occurred_at"), day("o_orderdate").alias("created_at"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("entity"))
    asked = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event"), F.col("o_orderkey").alias("request"), day("o_orderdate").alias("at"))
    wanted = asked.join(links, "event").select("request", "entity", "at")
    return events, links, wanted


_POOL_SQL = """WITH w AS (SELECT DISTINCT o_orderkey AS request, l_suppkey AS entity, CAST(o_orderdate AS TIMESTAMP) AS asked FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
  l AS (SELECT DISTINCT l_orderkey AS event, l_suppkey AS entity FROM lineitem),
  e AS (SELECT event, entity, CAST(o_orderdate AS TIMESTAMP) AS occurred_at FROM orders JOIN l ON event = o_orderkey),
  m AS (SELECT request, event, occurred_at, count(*) AS overlap FROM w JOIN e USING (entity) WHERE occurred_at >= asked - INTERVAL 14 DAYS AND occurred_at < asked GROUP BY 1, 2, 3)"""


@query("j13_explicit_pool", _POOL_SQL + " SELECT request, event, (SELECT count(*) FROM l WHERE l.event = m.event) AS n_entities FROM m")
def j13(spark, d):
    return integration.candidate_pool(*_pool(spark, d)).select("request", "event", F.size("entities").cast("long").alias("n_entities"))


@query("k14_batch_overlap", _POOL_SQL + " SELECT request, event, overlap, row_number() OVER (PARTITION BY request ORDER BY overlap DESC, occurred_at DESC, event DESC) AS rank FROM m QUALIFY rank <= 10")
def k14(spark, d):
    events, links, wanted = _pool(spark, d)
    got = integration.batch_overlap(integration.candidate_pool(events, links, wanted), wanted, 10)
    return got.select("request", "event", "overlap", F.col("rank").cast("long").alias("rank"))


@query("j44_candidate_entities", """WITH f AS (SELECT DISTINCT o_custkey AS batch, l_partkey AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT batch, entity, count(*) OVER (PARTITION BY batch) > 40 AS capped FROM f QUALIFY row_number() OVER (PARTITION BY batch ORDER BY entity DESC) <= 40""")
def j44(spark, d):
    hits = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("batch"), F.col("l_partkey").alias("entity"))
    return integration.candidate_entities(hits, "batch", "entity")


@query("l19_outlet_ceiling", """WITH o AS (SELECT o_orderkey AS event, o_custkey, lag(o_orderkey) OVER w AS before, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  c AS (SELECT event, o_custkey, sum(CASE WHEN gap <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY rn) AS island FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY x.o_orderdate, event) AS rn FROM o JOIN orders x USING (o_custkey) WHERE x.o_orderkey = event)),
  i AS (SELECT o_custkey, island, count(DISTINCT event) AS size, count(DISTINCT l_suppkey) AS n FROM c LEFT JOIN lineitem ON l_orderkey = event AND l_linenumber = 1 GROUP BY 1, 2)
  SELECT count(*) FILTER (WHERE n >= 2) / count(*) AS rate, count(*) AS events_after, count(*) FILTER (WHERE n >= 2) AS multi_after FROM i""")
def l19(spark, d):
    """Orders of a customer within 20 days of each other are duplicates; an order's outlet is its first line's supplier."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), "o_custkey", F.to_date("o_orderdate").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "event")
    pairs = o.select(F.lag("event").over(w).alias("a"), F.col("event").alias("b"), F.datediff("day", F.lag("day").over(w)).alias("gap")).filter("gap <= 20")
    outlets = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("outlet"))
    return integration.outlet_ceiling(pairs, outlets, o)


@query("a52_scored_grid", """WITH g AS (SELECT l_returnflag AS symbol, l_linestatus AS field, l_linenumber AS mode, count(*) AS n, round(corr(l_quantity, l_discount), 6) AS ic, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM lineitem GROUP BY 1, 2, 3)
  SELECT symbol, field, mode, 1 AS best_horizon, ic, hit_rate, CASE WHEN ic IS NULL THEN 0 ELSE n END AS n, CASE WHEN field = 'O' AND ic IS NOT NULL THEN CASE WHEN ic > 0.03 THEN 'yes' ELSE 'no' END END AS sign_ok FROM g""")
def a52(spark, d):
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("field"), F.col("l_linenumber").alias("mode")).agg(
        F.count("*").alias("n"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("ic"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("hit_rate")
    )
    return integration.scored_grid(cells.withColumns({"best_horizon": F.lit(1), "expected_sign": F.lit(1)}), ["symbol", "field", "mode"], F.col("field") == "O")


@query("a57_half_split", """SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'before' ELSE 'after' END AS half, count(*) AS windows, round(avg(o_totalprice), 4) AS mean_items, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS yes, count(*) AS asked
  FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' GROUP BY 1""")
def a57(spark, d):
    w = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("start"), F.lit(1).alias("pass"), F.when(F.col("o_orderstatus") != "P", "complete").alias("status"), F.col("o_totalprice").alias("items"),
        F.lit(1).alias("multi"), (F.col("o_orderpriority") == "1-URGENT").cast("long").alias("yes"), F.lit(1).cast("long").alias("asked"),
    )
    return integration.half_split(w, F.lit("1995-06-01").cast("timestamp_ntz")).select("half", "windows", F.round(F.col("mean_items").cast("double"), 4).alias("mean_items"), "yes", "asked")


@query("a58_last_run", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def a58(spark, d):
    return integration.last_run(table(spark, d, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("s68_verification_report", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'contradicted' WHEN 'O' THEN 'supported' ELSE 'unsupported' END AS verdict, o_orderpriority = '5-LOW' AS bare FROM orders)
  SELECT count(DISTINCT date) AS days, count(*) AS n_claims, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported,
  count(*) FILTER (WHERE verdict <> 'supported') AS flagged_total, count(*) FILTER (WHERE verdict <> 'supported' AND bare) AS unreasoned_flags, round(count(*) FILTER (WHERE verdict <> 'supported') / count(*), 6) AS flag_rate FROM c""")
def s68(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "contradicted").when(F.col("o_orderstatus") == "O", "supported").otherwise("unsupported")
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), verdict.alias("verdict"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("reason"))
    counts = F.create_map(*[x for v in integration.VERDICTS for x in (F.lit(v), F.count_if(F.col("verdict") == v))])
    records = rows.groupBy("date").agg(F.count("*").alias("n_claims"), counts.alias("counts"), F.collect_list(F.struct("verdict", "reason")).alias("claims"))
    got = integration.verification_report(records)
    return got.select("days", "n_claims", "contradicted", "unsupported", "flagged_total", "unreasoned_flags", F.round("flag_rate", 6).alias("flag_rate"))


@query("t26_replayed_latest", """SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE r = 1 GROUP BY 1""")
def t26(spark, d):
    latest = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return integration.replayed(latest, table(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
