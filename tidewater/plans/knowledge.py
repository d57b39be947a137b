"""Queries on the census, rankings, pulses and pair scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.scalars import NOISE_WORDS
from tidewater.operators import aggregates, knowledge, stats
from tidewater.plans.catalog import query, table
from tidewater.plans.relational import GRAMS

ROUND = 6


@query("j07_probable_misses", f"""WITH t AS (SELECT p_partkey AS e, p_brand AS k, p_size AS o, p_name AS x, {GRAMS.format('p_name')} AS g FROM part),
  m AS (SELECT DISTINCT a.e AS a, b.e AS b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM t a JOIN t b ON a.k = b.k AND a.e < b.e AND a.o <> b.o)
  SELECT a, b, round(s, 6) AS similarity FROM m WHERE s >= 0.5""")
def j07(spark, d):
    rows = table(spark, d, "part").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return knowledge.probable_misses(rows, "p_brand", "p_partkey", "p_size", "at", "p_name", 48, 0.5).withColumn("similarity", F.round("similarity", ROUND))


@query("j27_events_until", """WITH g AS (SELECT user_id AS w, min(ts) FILTER (WHERE event_type = 'error') AS gone FROM events GROUP BY 1)
  SELECT e.user_id AS window_id, count(*) AS n FROM events e JOIN g ON g.w = e.user_id WHERE coalesce(CASE WHEN e.user_id % 3 = 0 THEN TIMESTAMP '2024-01-10' END, gone) IS NULL OR e.ts <= coalesce(CASE WHEN e.user_id % 3 = 0 THEN TIMESTAMP '2024-01-10' END, gone) GROUP BY 1""")
def j27(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("window_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "abandon").otherwise("action").alias("kind"))
    w = e.select("window_id").distinct().withColumn("blind_done_at", F.when(F.col("window_id") % 3 == 0, F.lit("2024-01-10").cast("timestamp_ntz")))
    return knowledge.active_until(e, w).groupBy("window_id").agg(F.count("*").alias("n"))


@query("j28_wall_start", """WITH f AS (SELECT user_id AS w, min(ts) FILTER (WHERE event_type = 'purchase') AS a, min(ts) FILTER (WHERE event_type = 'view') AS h FROM events GROUP BY 1)
  SELECT w AS window_id, CAST(max(floor(epoch(ts))) AS BIGINT) AS start FROM events JOIN f ON w = user_id WHERE event_type = 'click' AND ts <= least(a, h) GROUP BY 1""")
def j28(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "action").when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "open").otherwise("x")
    e = table(spark, d, "events").select(F.col("user_id").alias("window_id"), F.col("ts").alias("at"), kind.alias("kind"))
    return knowledge.wall_start(e).select("window_id", F.unix_timestamp("start").alias("start"))


@query("j29_claimed_since", """WITH l AS (SELECT max(t) AS t FROM (SELECT max(ts) AS t FROM events WHERE event_type = 'purchase' AND value > 90 UNION ALL SELECT max(ts) FROM events WHERE event_type = 'view' AND value > 95))
  SELECT DISTINCT user_id AS window_id FROM events, l WHERE event_type = 'click' AND (t IS NULL OR ts > t)""")
def j29(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("window_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", "open").otherwise(F.col("event_type")).alias("kind"), "value")
    return knowledge.claimed_since(e, [e.filter("kind = 'purchase' AND value > 90"), e.filter("kind = 'view' AND value > 95")])


@query("j42_daily_move", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN round((o_totalprice * 1.01 - (o_totalprice - 100000)) / (o_totalprice - 100000) * 100, 2) END AS move FROM orders")
def j42(spark, d):
    q = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("open"), (F.col("o_totalprice") * 1.01).alias("close"))
    return knowledge.daily_move(q).select("o_orderkey", "move")


@query("j43_market_pulse", "SELECT c, i, min(part) AS part FROM (SELECT o_orderpriority AS c, o_custkey AS i, 0 AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderpriority, o_custkey, 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2")
def j43(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("asset_class"), F.col("o_custkey").alias("instrument"), F.lit("l").alias("label"), "o_orderstatus")
    moves = o.select("asset_class", "instrument").distinct().withColumn("move", F.lit(0.0))
    got = knowledge.market_pulse(o.filter("o_orderstatus = 'O'").drop("o_orderstatus"), o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), moves)
    return got.select(F.col("asset_class").alias("c"), F.col("instrument").alias("i"), "part")


@query("a27_yearly_ic", """WITH p AS (SELECT year(l_shipdate) AS y, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT y, rank() OVER (PARTITION BY y ORDER BY a) + (count(*) OVER (PARTITION BY y, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY y ORDER BY b) + (count(*) OVER (PARTITION BY y, b) - 1) / 2.0 AS rb FROM p)
  SELECT CAST(y AS INT) AS year, count(*) AS n, round((avg(ra * rb) - avg(ra) * avg(rb)) / (stddev_pop(ra) * stddev_pop(rb)), 6) AS ic FROM r GROUP BY 1""")
def a27(spark, d):
    return stats.yearly_ic(table(spark, d, "lineitem"), "l_shipdate", "l_quantity", "l_extendedprice").select("year", "n", F.round("ic", ROUND).alias("ic"))


@query("a28_trend", "SELECT user_id, arg_max(value, ts) AS latest, round(avg(value), 8) AS mean, count(*) AS n, round(arg_max(value, ts) - avg(value), 8) AS delta FROM events GROUP BY 1")
def a28(spark, d):
    got = knowledge.trend(table(spark, d, "events"), "user_id", "ts", "value")
    return got.select("user_id", "latest", F.round("mean", 8).alias("mean"), "n", F.round("delta", 8).alias("delta"))


@query("a37_window_census", """WITH l AS (SELECT l_orderkey % 20 AS w, l_partkey AS item, l_suppkey AS outlet, CASE WHEN l_linenumber < 4 THEN l_orderkey END AS g, l_linenumber = 6 AS unsure FROM lineitem),
  c AS (SELECT w, coalesce('g' || g, 's' || item) AS g, count(*) AS k, count(DISTINCT outlet) AS o FROM l WHERE NOT unsure GROUP BY 1, 2), s AS (SELECT w, count(*) FILTER (WHERE k >= 2) AS groups, count(*) FILTER (WHERE k = 1) AS singles, count(*) FILTER (WHERE o >= 2) AS multi_outlet FROM c GROUP BY 1)
  SELECT l.w AS window_id, count(*) AS items, count(*) FILTER (WHERE unsure) AS unsure, any_value(groups) AS groups, any_value(singles) AS singles, any_value(multi_outlet) AS multi_outlet FROM l JOIN s ON s.w = l.w GROUP BY 1""")
def a37(spark, d):
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 20).alias("window_id"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("outlet"),
        F.when(F.col("l_linenumber") < 4, F.col("l_orderkey")).alias("group_id"), (F.col("l_linenumber") == 6).alias("unsure"))
    return knowledge.window_census(rows)


@query("a38_adjudications", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS same, count(*) AS n FROM lineitem")
def a38(spark, d):
    return aggregates.adjudication_counts(table(spark, d, "lineitem"), "l_returnflag", "R")


@query("a46_run_agreement", """WITH r AS (SELECT l_orderkey AS item, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT l_linestatus)) AS b FROM lineitem GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (WHERE a = b) AS same_1 FROM r""")
def a46(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda run, c: li.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_set(c)).alias("decision")).withColumn("run", F.lit(run))
    return knowledge.run_agreement(side("a", "l_returnflag").unionByName(side("b", "l_linestatus")), ["a", "b"])


@query("f36_fitted_intervals", "WITH f AS (SELECT c_custkey, 10 + c_custkey % 50 AS i FROM customer), t AS (SELECT sum(1440.0 / i) AS t FROM f) SELECT c_custkey, CAST(round_even(i * greatest(1.0, t / 1200), 0) AS BIGINT) AS fitted FROM f, t")
def f36(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (10 + F.col("c_custkey") % 50).alias("i"))
    return knowledge.fitted_intervals(rows, "i", 1200).select("c_custkey", "fitted")


@query("g13_decisions", """SELECT a.l_returnflag AS run, a.l_partkey AS item, array_to_string(list_sort(list(DISTINCT b.l_partkey)), ',') AS decision FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag GROUP BY 1, 2""")
def g13(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("label"))
    return knowledge.canonical_decisions(rows).select("run", "item", F.array_join(F.transform("decision", lambda x: x.cast("string")), ",").alias("decision"))


POOL = f"""WITH q AS (SELECT p_partkey AS query, p_name AS x, {GRAMS.format('p_name')} AS g, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda w: w NOT IN {tuple(NOISE_WORDS)}) AS t, p_brand FROM part WHERE p_partkey % 50 = 0),
  c AS (SELECT p_partkey AS candidate, p_size AS recency, {GRAMS.format('p_name')} AS g, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda w: w NOT IN {tuple(NOISE_WORDS)}) AS t, p_brand FROM part),
  s AS (SELECT query, candidate, recency, coalesce(len(list_intersect(q.t, c.t)) / nullif(len(q.t) + len(c.t) - len(list_intersect(q.t, c.t)), 0), 0) AS j, len(list_intersect(q.g, c.g)) / (len(q.g) + len(c.g) - len(list_intersect(q.g, c.g))) AS r FROM q JOIN c ON q.p_brand = c.p_brand)"""


@query("k15_ranking_bakeoff", POOL + """ SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY recency DESC, candidate DESC) AS recency_rank, row_number() OVER (PARTITION BY query ORDER BY j DESC, recency DESC, candidate DESC) AS token_rank,
  row_number() OVER (PARTITION BY query ORDER BY r DESC, recency DESC, candidate DESC) AS trigram_rank FROM s""")
def k15(spark, d):
    part = table(spark, d, "part")
    q = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.col("p_name").alias("text"), "p_brand")
    c = part.select(F.col("p_partkey").alias("candidate"), F.col("p_size").alias("recency"), F.col("p_name").alias("candidate_text"), "p_brand")
    got = knowledge.ranked_pool(q, c, "query", ["p_brand"], ["text"], ["candidate_text"], ["recency", "tokens", "trigrams"])
    return got.select("query", "candidate", *[F.col(f"rank_{a}").cast("long").alias(b) for a, b in (("recency", "recency_rank"), ("tokens", "token_rank"), ("trigrams", "trigram_rank"))])


@query("l20_exactness_control", "SELECT CAST(0 AS BIGINT) AS differ")
def l20(spark, d):
    from tidewater.operators import graph, joins

    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text"))
    forms = part.select(F.explode(F.split(F.lower("text"), " ")).alias("form")).distinct().withColumn("entity", F.col("form"))
    words = part.select("item", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("form"))
    slow = words.join(forms, "form").select("item", "entity").repartition(graph.parts_for(part, joins.ITEMS_OF_A_TASK), "item").distinct()
    return knowledge.differing_hits(joins.dictionary_hits(part, forms), slow)


@query("t20_t23_next_task", "SELECT c_custkey AS window_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_mktsegment DESC, c_nationkey, c_custkey LIMIT 1")
def t23(spark, d):
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "open").when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("complete")
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("window_id"), F.col("c_nationkey").alias("order_no"), status.alias("status"))
    return knowledge.next_task(w).select("window_id")


@query("t25_abandon_cascade", "SELECT CASE WHEN c_custkey = 5 OR (c_custkey % 50 = 5 AND c_mktsegment <> 'BUILDING') THEN 'abandoned' WHEN c_mktsegment = 'BUILDING' THEN 'complete' ELSE 'open' END AS status, count(*) AS n FROM customer GROUP BY 1")
def t25(spark, d):
    w = table(spark, d, "customer").select(
        F.col("c_custkey").alias("window_id"), F.when(F.col("c_custkey") % 50 == 5, 5).alias("repeat_of"), F.when(F.col("c_mktsegment") == "BUILDING", "complete").otherwise("open").alias("status"), F.lit(None).cast("string").alias("abandon_reason"))
    return knowledge.abandoned(w, 5, "late").groupBy("status").agg(F.count("*").alias("n"))


@query("w04_latest_run_per_job", "SELECT event_type AS job, max(event_id) AS id FROM events GROUP BY 1")
def w04(spark, d):
    from tidewater.operators.windows import latest_per_key

    return latest_per_key(table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("id"), "user_id"), ["job"], ["id"]).select("job", "id")


@query("l21_visibility")
def l21(spark, d):
    rows = table(spark, d, "events").select(
        F.floor(F.unix_timestamp("ts") / 7200).alias("window"), F.col("event_id").alias("item"), "user_id", F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return knowledge.key_visibility(rows, "window", "item", "user_id", "hour", "kind", "at")
