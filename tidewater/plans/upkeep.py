"""Queries on bars, prices, droughts, logs, queues and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import upkeep
from tidewater.plans.catalog import query, table

ROUND = 6


@query("p20_usable_symbols", "SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' GROUP BY 1 HAVING DATE '1998-01-01' - max(CAST(o_orderdate AS DATE)) <= 5")
def p20(spark, d):
    bars = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"))
    return upkeep.usable_symbols(bars, "o_custkey", "date", F.lit("1998-01-01"))


@query("p21_completed_bars", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1997-06-01'")
def p21(spark, d):
    return upkeep.completed_bars(table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate")), "date", F.lit("1997-06-01 12:00:00").cast("timestamp")).select("o_orderkey")


@query("f38_model_price", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_totalprice > 200000 THEN 6.0 ELSE 3.0 END WHEN 'F' THEN 1.0 ELSE 0.5 END AS price_in,
  CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_totalprice > 200000 THEN 22.5 ELSE 15.0 END WHEN 'F' THEN 5.0 ELSE 2.5 END AS price_out FROM orders""")
def f38(spark, d):
    price = upkeep.price_of(F.col("o_orderstatus"), F.col("o_totalprice"), {"O": (3, 15), "F": (1, 5), "P": (0.5, 2.5)}, {"O": (200_000, (6, 22.5))})
    got = table(spark, d, "orders").select("o_orderkey", price.alias("price"))
    return got.select("o_orderkey", F.col("price.price_in").cast("decimal(3,1)").alias("price_in"), F.col("price.price_out").cast("decimal(3,1)").alias("price_out"))


@query("f45_tool_block", "SELECT event_id, event_type AS id, CAST(user_id AS BIGINT) AS n FROM events")
def f45(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit('Here is the list:\n[{"id": "'), F.col("event_type"), F.lit('",\n "n": '), F.col("user_id").cast("string"), F.lit("}]\nDone."))
    return e.select("event_id", F.explode(upkeep.tool_rows(text, "id string, n bigint")).alias("row")).select("event_id", "row.id", "row.n")


@query("t04_droughts", """WITH r AS (SELECT user_id, event_id, ts, CAST(event_type = 'view' AS INT) AS new, event_type = 'error' AS failed FROM events),
  o AS (SELECT user_id FROM r GROUP BY 1 HAVING min(ts) <= TIMESTAMP '2024-01-24'),
  w AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS later, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS earlier FROM r WHERE ts > TIMESTAMP '2024-01-24'),
  s AS (SELECT user_id, earlier, count(*) AS n, bool_or(later = 0) AS cur, bool_or(failed) AS bad FROM w WHERE new = 0 GROUP BY 1, 2),
  a AS (SELECT user_id, max(n) FILTER (WHERE cur) AS current, coalesce(max(n) FILTER (WHERE NOT cur), 0) AS longest, bool_or(cur AND bad) AS bad FROM s GROUP BY 1)
  SELECT user_id, current, longest FROM a WHERE current > longest AND NOT bad AND user_id IN (SELECT user_id FROM o)""")
def t04(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "view").cast("int").alias("new"), (F.col("event_type") == "error").alias("failed"))
    return upkeep.droughts(e, "user_id", "ts", "event_id", "new", "failed", F.lit("2024-01-31").cast("timestamp_ntz"))


@query("s40_key_lookup", "SELECT DISTINCT l_partkey AS p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def s40(spark, d):
    entries = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return upkeep.looked_up(entries, table(spark, d, "part"), ["p_partkey"], "p_name")


@query("s41_poll_log", "SELECT event_id AS run, user_id AS source, CASE WHEN event_type = 'error' THEN event_type END AS failure FROM events UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders")
def s41(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("run"), F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("failure"))
    return upkeep.appended(log, table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("source")))


@query("s52_ledger_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def s52(spark, d):
    o = table(spark, d, "orders").withColumn("retired", F.col("o_orderstatus") == "F")
    return upkeep.ledger_in_order(o, "o_orderpriority", "o_orderdate", "o_orderkey", "retired", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_orderkey")


@query("a48_spend_average", "SELECT l_returnflag AS stage, count(*) AS calls, round(avg(l_quantity), 6) AS mean_in, round(avg(l_linenumber), 6) AS mean_out FROM lineitem GROUP BY 1")
def a48(spark, d):
    got = upkeep.spend_average(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "stage"), "stage", "l_quantity", "l_linenumber")
    return got.select("stage", "calls", F.round(F.col("mean_in").cast("double"), ROUND).alias("mean_in"), F.round("mean_out", ROUND).alias("mean_out"))


@query("a47_a50_reasons", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def a50(spark, d):
    return upkeep.tallied(table(spark, d, "events").select(F.col("event_type").alias("reason")), "reason")


@query("a35_set_map", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS found FROM events GROUP BY 1")
def a35(spark, d):
    return upkeep.sets_by_key(table(spark, d, "events"), "user_id", "event_type").select("user_id", F.array_join("found", ",").alias("found"))


@query("u06_unanswered_pairs", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'A' AND ((x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey) OR (x.l_partkey = l.l_suppkey AND x.l_suppkey = l.l_partkey)))")
def u06(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    return upkeep.unanswered(li.select("a", "b").distinct(), li.filter("l_returnflag = 'A'"), "a", "b")


@query("u02_tail_row", "SELECT c_name AS name, c_acctbal AS v FROM customer UNION ALL SELECT 'total', round(sum(c_acctbal), 2) FROM customer")
def u02(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    return upkeep.with_tail(c, c.agg(F.round(F.sum("v"), 2).alias("v")).withColumn("name", F.lit("total")), ["name"]).drop("_tail")


@query("k23_queue_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def k23(spark, d):
    return upkeep.queued(table(spark, d, "orders"), "o_orderstatus", "o_orderkey", "P").select("o_orderkey")


@query("l05_bonferroni", "SELECT count(DISTINCT l_shipdate - l_commitdate) AS n, 0.05 / count(DISTINCT l_shipdate - l_commitdate) AS threshold FROM (SELECT CAST(l_shipdate AS DATE) AS l_shipdate, CAST(l_shipdate AS DATE) - l_linenumber AS l_commitdate FROM lineitem)")
def l05(spark, d):
    return upkeep.bonferroni(table(spark, d, "lineitem").select("l_linenumber").distinct())


@query("s11_passages_since", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents WHERE n_chars >= 200 QUALIFY rank <= 20")
def s11(spark, d):
    return upkeep.passages_since(table(spark, d, "documents"), "lang", "n_chars", "doc_id", F.lit(200), 20).select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("j26_window_members", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def j26(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    got = upkeep.window_members(li, table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select("s_suppkey", "s_name"), "p_partkey", "s_suppkey", ["l_orderkey", "l_linenumber"])
    return got.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("j37_shadow_guard", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j37(spark, d):
    known = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return upkeep.shadowed(table(spark, d, "customer"), known, "c_custkey").select("c_custkey")
