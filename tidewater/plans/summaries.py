"""Queries on aggregations, top-k, set operations, graphs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import aggregates, graph, joins, sampling, topk
from tidewater.plans.catalog import query, table
from tidewater.plans.relational import GRAMS, PAIRS
from tidewater.plans.views import view

ROUND = 6


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


HEALTH = """, ok AS (SELECT user_id AS source, max(ts) FILTER (WHERE event_type <> 'error') AS last_ok, arg_max(event_type, ts) FILTER (WHERE event_type = 'error') AS last_failure FROM events GROUP BY 1),
  f AS (SELECT e.user_id AS source, count(*) AS n FROM events e JOIN ok ON ok.source = e.user_id WHERE e.event_type = 'error' AND (last_ok IS NULL OR e.ts > last_ok) GROUP BY 1)"""


@query("a01_feed_health", "WITH x AS (SELECT 1)" + HEALTH + " SELECT source, CAST(floor(epoch(last_ok)) AS BIGINT) AS last_ok, last_failure, coalesce(n, 0) AS failures_since FROM ok LEFT JOIN f USING (source)")
def a01(spark, d):
    return aggregates.feed_health(view(spark, d, "v_polls")).select("source", F.unix_timestamp("last_ok").alias("last_ok"), "last_failure", "failures_since")


@query("a02_failing_feeds", "WITH x AS (SELECT 1)" + HEALTH + " SELECT source FROM ok WHERE last_ok IS NULL OR floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(last_ok)) > (source % 3 + 1) * 720 * 60")
def a02(spark, d):
    limits = table(spark, d, "events").select(F.col("user_id").alias("source")).distinct().withColumn("minutes", (F.col("source") % 3 + 1) * 720)
    return aggregates.failing_feeds(view(spark, d, "v_polls"), _ntz("2024-01-31"), limits).select("source")


@query("a04_windowed_share", """WITH e AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1)
  SELECT count(*) AS events, count(*) FILTER (WHERE n >= 2) AS multi, round(count(*) FILTER (WHERE n >= 2) / nullif(count(*), 0), 6) AS share FROM e""")
def a04(spark, d):
    rows = view(spark, d, "v_assertions").filter((F.col("created_at") >= _ntz("1996-01-01")) & (F.col("created_at") < _ntz("1997-01-01")))
    return aggregates.multi_outlet_share(rows, "event", "outlet").withColumn("share", F.round("share", ROUND))


@query("a05_distribution", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def a05(spark, d):
    return aggregates.distribution(table(spark, d, "events"), ["event_type"]).withColumn("share", F.round("share", ROUND))


@query("a06_enum_rule", "WITH s AS (SELECT count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type) SELECT count(*) FILTER (WHERE share >= 0.1) AS common, round(max(share), 6) AS top, count(*) FILTER (WHERE share >= 0.1) >= 2 AND max(share) <= 0.9 AS passes FROM s")
def a06(spark, d):
    return aggregates.enum_rule(aggregates.distribution(table(spark, d, "events"), ["event_type"])).withColumn("top", F.round("top", ROUND))


@query("a07_per_arm", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def a07(spark, d):
    return aggregates.distribution(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"]).withColumn("share", F.round("share", ROUND))


@query("a08_depth_tiers", "SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 5000 THEN 'medium' ELSE 'long' END AS tier, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def a08(spark, d):
    tier = F.when(F.length("text") < 500, "short").when(F.length("text") < 5000, "medium").otherwise("long")
    return aggregates.tier_histogram(table(spark, d, "documents"), tier, "lang")


@query("a09_having_variance", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS kinds, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 10")
def a09(spark, d):
    return aggregates.groups_of(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", 10)


@query("a10_match_rate", "SELECT round((count(*) - count(DISTINCT l_orderkey)) / nullif(count(*), 0), 6) AS rate FROM lineitem")
def a10(spark, d):
    rows = view(spark, d, "v_assertions").agg(F.count("*").alias("a"), F.countDistinct("event").alias("e"))
    return rows.select(F.round(aggregates.match_rate(F.col("a"), F.col("e")), ROUND).alias("rate"))


@query("a11_cohorts", """WITH c AS (SELECT *, CASE WHEN g >= 0 AND g < 2592000 THEN 'after' WHEN g < 0 AND g >= -2592000 THEN 'before' END AS cohort FROM (SELECT *, epoch(l_shipdate) - epoch(TIMESTAMP '1997-01-01') AS g FROM lineitem)),
  e AS (SELECT cohort, l_orderkey, count(DISTINCT l_suppkey) AS n FROM c WHERE cohort IS NOT NULL GROUP BY 1, 2)
  SELECT cohort, count(*) AS events, count(*) FILTER (WHERE n >= 2) AS multi, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS share FROM e GROUP BY 1""")
def a11(spark, d):
    got = aggregates.cohorts(view(spark, d, "v_assertions"), "event", "outlet", "created_at", _ntz("1997-01-01"), 720)
    return got.withColumn("share", F.round("share", ROUND))


@query("a12_horizon_sweep", """WITH e AS (SELECT h AS horizon, l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem, (VALUES (6), (48), (720)) t(h)
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND epoch(l_shipdate) < epoch(TIMESTAMP '1997-01-01') + h * 3600 GROUP BY 1, 2)
  SELECT horizon, count(*) AS events, count(*) FILTER (WHERE n >= 2) AS multi, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS share FROM e GROUP BY 1""")
def a12(spark, d):
    start = F.unix_timestamp(_ntz("1997-01-01"))
    gap = F.unix_timestamp("created_at") - start
    rows = view(spark, d, "v_assertions").withColumn("horizon", F.explode(F.array(*map(F.lit, (6, 48, 720))))).filter((gap >= 0) & (gap < F.col("horizon") * 3600))
    return aggregates.multi_outlet_share(rows, "event", "outlet", ["horizon"]).withColumn("share", F.round("share", ROUND))


@query("a13_gate", """WITH e AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS events, count(*) FILTER (WHERE n >= 2) / count(*) AS share FROM e)
  SELECT events, CASE WHEN events = 0 THEN 'not_measurable' WHEN share < 0.1 OR share > 0.6 THEN 'fail' ELSE 'pass' END AS verdict FROM s""")
def a13(spark, d):
    share = aggregates.multi_outlet_share(view(spark, d, "v_assertions"), "event", "outlet")
    return aggregates.gate(share, F.lit(0), 6).select("events", "verdict")


@query("a14_surges", """WITH g AS (SELECT event_type AS key, CAST(floor((epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts))) / 86400) AS BIGINT) AS ago FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
  k AS (SELECT DISTINCT key FROM g), s AS (SELECT key, d, (SELECT count(*) FROM g WHERE g.key = k.key AND ago = d) AS n FROM k, (SELECT unnest(range(0, 8)) AS d))
  SELECT key, max(n) FILTER (WHERE d = 0) AS recent, CAST(quantile_disc(n, 0.5) FILTER (WHERE d > 0) AS BIGINT) AS median,
    max(n) FILTER (WHERE d = 0) > 3 * quantile_disc(n, 0.5) FILTER (WHERE d > 0) AND max(n) FILTER (WHERE d = 0) - quantile_disc(n, 0.5) FILTER (WHERE d > 0) >= 200 AS surge FROM s GROUP BY 1""")
def a14(spark, d):
    now = _ntz("2024-01-20")
    rows = table(spark, d, "events").filter(F.col("ts") <= now).select(F.col("event_type").alias("key"), F.floor((F.unix_timestamp(now) - F.unix_timestamp("ts")) / 86400).alias("ago"))
    return aggregates.surges(rows, "key", "ago")


@query("a15_failure_histogram", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
def a15(spark, d):
    return aggregates.failure_histogram(table(spark, d, "events"), "event_type", ["error", "click"])


POSITIONS = "WITH p AS (SELECT o_orderpriority AS class, o_orderstatus AS status, round((o_totalprice - 150000) / 150000, 6) AS r, round((o_totalprice - 140000) / 150000, 6) AS edge FROM orders)"


def _positions(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("status"), F.round((F.col("o_totalprice") - 150000) / 150000, 6).alias("net_return"), F.round((F.col("o_totalprice") - 140000) / 150000, 6).alias("edge"))


@query("a16_net_return_stats", POSITIONS + " SELECT count(*) AS n, round(avg(CASE WHEN r > 0 THEN 100.0 ELSE 0 END), 5) AS hit_rate, round(avg(r), 5) AS mean, round(median(r), 5) AS median, round(avg(edge), 5) AS mean_edge FROM p")
def a16(spark, d):
    got = aggregates.performance(_positions(spark, d), ["class"]).filter("dimension = 'all'")
    return got.select("n", *[F.round(c, 5).alias(c) for c in ("hit_rate", "mean", "median", "mean_edge")])


@query("a17_grouping_sets", POSITIONS + """ SELECT CASE grouping_id(class, status) WHEN 3 THEN 'all' WHEN 1 THEN 'class' ELSE 'status' END AS dimension, coalesce(class, status) AS value, count(*) AS n,
  round(avg(CASE WHEN r > 0 THEN 100.0 ELSE 0 END), 5) AS hit_rate, round(avg(r), 5) AS mean, round(avg(edge), 5) AS mean_edge FROM p GROUP BY GROUPING SETS ((), (class), (status))""")
def a17(spark, d):
    got = aggregates.performance(_positions(spark, d), ["class", "status"])
    return got.select("dimension", "value", "n", *[F.round(c, 5).alias(c) for c in ("hit_rate", "mean", "mean_edge")])


@query("a18_gate_rule", POSITIONS + """, s AS (SELECT class, count(*) AS n, avg(edge) AS e, avg(CASE WHEN r > 0 THEN 100.0 ELSE 0 END) AS h FROM p GROUP BY 1)
  SELECT class, CASE WHEN n < 30 THEN 'too_few' WHEN e <= 0 THEN 'no_edge' WHEN h < 55 THEN 'low_hit_rate' ELSE 'pass' END AS verdict FROM s""")
def a18(spark, d):
    got = aggregates.performance(_positions(spark, d), ["class"]).filter("dimension = 'class'")
    return got.select(F.col("value").alias("class"), aggregates.gate_verdict(F.col("n"), F.col("mean_edge"), F.col("hit_rate"), F.lit(True)).alias("verdict"))


@query("a19_leakage", """WITH l AS (SELECT CAST(ts AS DATE) AS day, event_type AS reason, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT DISTINCT day FROM l ORDER BY day DESC LIMIT 7)
  SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM l WHERE day IN (SELECT day FROM r) GROUP BY 1""")
def a19(spark, d):
    log = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))
    return aggregates.leakage(log, "day", "reason", "n")


@query("a21_daily_signals", """WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_conflict, CAST(sum(event_id % 7) AS BIGINT) AS w, sum(value * (event_id % 7)) AS t FROM events WHERE user_id % 2 = 0 GROUP BY 1)
  SELECT day, n, n_conflict, w AS weight, round(coalesce(t / nullif(w, 0), 0), 5) AS tone FROM s""")
def a21(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("m", F.col("event_id") % 7)
    got = aggregates.daily_signals(e, "day", F.col("user_id") % 2 == 0, F.col("event_type") == "error", "value", "value", "m")
    return got.select("day", "n", "n_conflict", "weight", F.round("tone", 5).alias("tone"))


@query("a24_weekly_weighted", """SELECT l_returnflag AS key, CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS week, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS value FROM lineitem GROUP BY 1, 2""")
def a24(spark, d):
    from tidewater.functions.scalars import iso_week_friday

    rows = table(spark, d, "lineitem")
    got = aggregates.weekly_weighted(rows.withColumnRenamed("l_returnflag", "key"), "key", iso_week_friday(F.to_date("l_shipdate")), "l_quantity", "l_discount")
    return got.select("key", "week", F.round("value", 9).alias("value"))


@query("a26_share_of_total", "WITH t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS part FROM events GROUP BY 1) SELECT day, round(part / total, 6) AS share FROM t")
def a26(spark, d):
    return aggregates.share_by(table(spark, d, "events"), F.to_date("ts"), F.col("event_type") == "purchase").select(F.col("key").alias("day"), F.round("share", ROUND).alias("share"))


@query("a29_confusion", """WITH r AS (SELECT quality = 0 AS t, length(text) < 700 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM r)
  SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + fn) / nullif(tp + fp + fn + tn, 0), 6) AS base_rate FROM c""")
def a29(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    got = aggregates.confusion(rows, F.col("quality") == 0, F.length("text") < 700)
    return got.select("tp", "fp", "fn", "tn", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "base_rate")])


@query("a31_verification_rollup", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS flagged FROM events GROUP BY 1")
def a31(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(kind == "click").alias("click"), F.count_if(kind == "view").alias("view"), F.round(F.count_if(kind == "error") / F.count("*"), ROUND).alias("flagged"))


@query("a32_field_variance", """SELECT field, count(value) AS n, count(DISTINCT value) AS "distinct", count(*) - count(value) AS absent, count(DISTINCT value) <= 1 AS degenerate FROM
  (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1""")
def a32(spark, d):
    return aggregates.field_variance(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a33_hubness", "SELECT l_suppkey AS entity, count(DISTINCT l_orderkey) AS events FROM lineitem GROUP BY 1")
def a33(spark, d):
    return aggregates.hubness(view(spark, d, "v_assertions"), "outlet", "event")


@query("a34_entity_arrays", "SELECT l_orderkey AS event, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS entities FROM lineitem GROUP BY 1")
def a34(spark, d):
    sets = aggregates.entity_sets(view(spark, d, "v_assertions"), "event", "outlet")
    return sets.select("event", F.array_join(F.transform("entities", lambda x: x.cast("string")), ",").alias("entities"))


@query("a36_window_stats", """WITH b AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start, event_type FROM events), l AS (SELECT min(start) AS lo, max(start) AS hi FROM b),
  s AS (SELECT unnest(range(lo, hi + 1, 21600)) AS start FROM l) SELECT s.start, count(b.event_type) AS items, count(*) FILTER (WHERE b.event_type = 'error') AS errors, count(b.event_type) < 40 AS skipped FROM s LEFT JOIN b ON b.start = s.start GROUP BY 1""")
def a36(spark, d):
    from tidewater.functions.scalars import six_hour_start

    rows = table(spark, d, "events").select(six_hour_start(F.col("ts")).alias("start"), "event_type")
    return aggregates.slot_counts(rows, "start", 21600, F.col("event_type") == "error", 40).withColumnRenamed("marked", "errors")


@query("a39_next_id", "SELECT coalesce(max(try_cast(regexp_extract(c_name, '^Customer#(\\d+)$', 1) AS INT)), 0) + 1 AS next FROM customer")
def a39(spark, d):
    return aggregates.next_id(table(spark, d, "customer"), "c_name", "Customer#")


@query("a40_feed_stats", """WITH s AS (SELECT user_id AS source, event_type AS hash, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2), n AS (SELECT user_id AS source, max(ts) AS newest, quantile_cont(value, 0.5) AS entries FROM events WHERE event_type <> 'error' GROUP BY 1),
  g AS (SELECT source, count(*) AS departed, avg((f = l)::INT) AS single FROM s JOIN n USING (source) WHERE l < newest GROUP BY 1)
  SELECT source, round(entries, 5) AS entries, coalesce(departed, 0) AS departed, round(single, 6) AS single_share FROM n LEFT JOIN g USING (source)""")
def a40(spark, d):
    e = table(spark, d, "events")
    spans = e.groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("hash")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    got = aggregates.feed_stats(view(spark, d, "v_polls"), spans)
    return got.select("source", F.round("entries", 5).alias("entries"), "departed", F.round("single_share", ROUND).alias("single_share"))


@query("a44_portfolio_weights", "SELECT o_custkey, round(100 * v / sum(v) OVER (), 6) AS weight FROM (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) QUALIFY 100 * v / sum(v) OVER () >= 0.5 OR o_custkey % 5 = 0")
def a44(spark, d):
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).withColumn("has_thesis", F.col("o_custkey") % 5 == 0)
    return aggregates.portfolio_weights(held, "v").select("o_custkey", F.round("weight", ROUND).alias("weight"))


# ---- top-k and sets

@query("k01_trigram_topk", f"""WITH q AS (SELECT p_partkey AS qid, {GRAMS.format('p_name')} AS g FROM part WHERE p_partkey % 50 = 0), c AS (SELECT p_partkey AS cid, p_size AS recency, {GRAMS.format('p_name')} AS g FROM part),
  s AS (SELECT qid, cid, recency, round(len(list_intersect(q.g, c.g)) / (len(q.g) + len(c.g) - len(list_intersect(q.g, c.g))), 9) AS score FROM q, c),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, recency DESC, cid DESC) AS rank FROM s) SELECT qid, cid, rank FROM r WHERE rank <= 30""")
def k01(spark, d):
    part = table(spark, d, "part")
    q = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text"))
    c = part.select(F.col("p_partkey").alias("cid"), F.col("p_size").alias("recency"), F.col("p_name").alias("text"))
    got = joins.trigram_top_k(q, c, "qid", "cid", 30)
    return got.select("qid", "cid", F.col("rank").cast("long").alias("rank"))


@query("k02_entity_topk", "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 DESC LIMIT 40")
def k02(spark, d):
    return topk.top_k(table(spark, d, "lineitem").select("l_suppkey").distinct(), [F.desc("l_suppkey")], 40)


@query("k03_working_set", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderstatus = 'P' DESC, o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 25")
def k03(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return topk.top_k(o, [F.desc(F.col("o_orderstatus") == "P"), F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")], 25).select("o_orderkey")


@query("k04_capped_sample", "WITH u AS (SELECT count(*) AS n FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-30') SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'view'), u WHERE r <= 2000 - n")
def k04(spark, d):
    e = table(spark, d, "events")
    used = e.filter((F.col("event_type") == "error") & (F.to_date("ts") >= F.lit("2024-01-30").cast("date"))).agg(F.count("*").alias("n"))
    return topk.capped_sample(e.filter("event_type = 'view'"), used, [F.desc("event_id")], 2000).select("event_id")


@query("s04_newest_per_feed", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25")
def s04(spark, d):
    return topk.top_k_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 25).select("user_id", "event_id")


@query("k17_chunks", "SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1) // 5 AS INT) AS chunk, event_id FROM events")
def k17(spark, d):
    return topk.chunked(table(spark, d, "events"), ["user_id"], [F.desc("event_id")], 5).select("user_id", "chunk", "event_id")


@query("k24_best_horizon", """WITH m AS (SELECT l_suppkey AS k, l_linenumber AS h, round(avg(l_discount) - 0.05, 9) AS ic FROM lineitem GROUP BY 1, 2) SELECT k, h AS best FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(ic) DESC, h) = 1""")
def k24(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("h")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("ic"))
    return topk.best_horizon(m, ["k"], "h", "ic")


@query("k25_newest_documents", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 7")
def k25(spark, d):
    return topk.top_k(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 7).orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("u04_retired_keys", "SELECT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def u04(spark, d):
    o = table(spark, d, "orders")
    old, new = o.filter(F.col("o_orderdate") < _ntz("1997-01-01")), o.filter(F.col("o_orderdate") >= _ntz("1997-01-01"))
    return old.select(F.col("o_custkey").alias("k")).distinct().join(new.select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("u07_first_occurrence", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def u07(spark, d):
    return topk.first_occurrences(table(spark, d, "events"), "event_type", "event_id")


@query("u08_universe", "SELECT k, min(s) AS source_no FROM (SELECT o_custkey AS k, 0 AS s FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def u08(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return topk.ordered_union([a, b], "k")


@query("u09_intersection", "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def u09(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'error'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id"))


# ---- graphs and samples

EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey + 100000 AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("a"))
    b = li.filter("l_linenumber = 2").select("l_orderkey", (F.col("l_suppkey") + 100000).alias("b"))
    return a.join(b, "l_orderkey").select("a", "b").distinct()


@query("g03_components", EDGES + """, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
  SELECT id, min(c) AS component FROM r GROUP BY 1""")
def g03(spark, d):
    return graph.connected_components(_edges(spark, d), "a", "b")


@query("g05_merges", EDGES + """, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
  m AS (SELECT id, min(c) AS component FROM r GROUP BY 1) SELECT count(*) - count(DISTINCT component) AS merges FROM m""")
def g05(spark, d):
    return graph.merge_count(_edges(spark, d), "a", "b")


@query("g06_shared_entity_edges", """WITH h AS (SELECT DISTINCT CAST(floor(epoch(ts) / 7200) AS BIGINT) AS w, event_id, user_id FROM events)
  SELECT DISTINCT x.w AS "window", x.event_id AS a, y.event_id AS b, CAST(0 AS DOUBLE) AS weight FROM h x JOIN h y ON x.w = y.w AND x.user_id = y.user_id AND x.event_id < y.event_id""")
def g06(spark, d):
    rows = table(spark, d, "events").select(F.floor(F.unix_timestamp("ts") / 7200).alias("window"), "event_id", "user_id")
    return graph.shared_key_edges(rows, "window", "event_id", "user_id")


def _windowed(spark, d):
    rows = table(spark, d, "events").select(F.floor(F.unix_timestamp("ts") / 7200).alias("window"), "event_id", "user_id")
    return rows.select("window", F.col("event_id").alias("item")), graph.shared_key_edges(rows, "window", "event_id", "user_id")


@query("g01_seed_star")
def g01(spark, d):
    return graph.seed_star(*_windowed(spark, d))


@query("g02_capped_bfs")
def g02(spark, d):
    return graph.capped_bfs(*_windowed(spark, d))


@query("g11_truth_groups", """SELECT coalesce('g' || quality, 's' || d.doc_id) AS "group", count(*) AS n, count(DISTINCT source) AS outlets FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) = 0 GROUP BY 1""")
def g11(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("item"), F.col("quality").alias("group_id"), (F.col("toxic") == 1).alias("unsure"), F.col("source").alias("outlet"))
    return graph.truth_groups(rows).select("group", F.size("items").cast("long").alias("n"), "outlets")


@query("r01_stratified_draw", """WITH d AS (SELECT event_type, event_id, md5('7|' || event_id) AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d, event_id) AS round FROM d)
  SELECT event_type, event_id, CAST(round AS INT) AS round, CAST(row_number() OVER (ORDER BY round, md5('7s|' || round || '|' || event_type), event_type) AS INT) AS order_no FROM r WHERE round <= 4""")
def r01(spark, d):
    got = sampling.stratified(table(spark, d, "events"), ["event_type"], ["event_id"], 4, "7")
    return got.select("event_type", "event_id", "round", "order_no")


@query("r02_precision_sample", PAIRS.replace("SELECT DISTINCT x.item AS a", "SELECT DISTINCT x.event AS g, x.item AS a").replace(", x.created_at AS ta, y.created_at AS tb", "") + """,
  q AS (SELECT *, md5('5|' || g || '|' || a || '|' || b) AS d FROM p), o AS (SELECT g, a, b FROM q QUALIFY row_number() OVER (PARTITION BY g ORDER BY d, a, b) = 1) SELECT g, a, b FROM o ORDER BY md5('5|' || g), g LIMIT 10""")
def r02(spark, d):
    a = view(spark, d, "v_assertions")
    other = a.select("event", F.col("item").alias("b"), F.col("outlet").alias("ob"))
    pairs = a.join(other, "event").filter("item < b AND outlet <> ob").select(F.col("event").alias("g"), F.col("item").alias("a"), "b").distinct()
    return sampling.one_pair_per_group(pairs, "g", "a", "b", 10, "5")


@query("r06_thinned", """WITH e AS (SELECT event_id, event_type = 'error' AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, md5('3|' || event_id) AS d FROM events)
  SELECT event_id FROM e QUALIFY k OR row_number() OVER (PARTITION BY h, k ORDER BY d, event_id) <= 5""")
def r06(spark, d):
    e = table(spark, d, "events")
    return sampling.thinned(e, F.col("event_type") == "error", F.floor(F.unix_timestamp("ts") / 3600), "event_id", 5, "3").select("event_id")
