"""Queries on joins, windows and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import joins, stats, topk, windows
from tidewater.plans.catalog import query, table
from tidewater.plans.views import sql_with, view

ROUND = 6


def _secs(c: str) -> str:
    return f"CAST(floor(epoch({c})) AS BIGINT)"


# ---- windows

@query("w01_latest_per_key", f"SELECT user_id AS outlet, max(event_id) AS id, arg_max(event_type, event_id) AS kind, {_secs('arg_max(ts, event_id)')} AS at FROM events GROUP BY 1")
def w01(spark, d):
    last = windows.latest_per_key(view(spark, d, "v_items"), ["outlet"], ["id"])
    return last.select("outlet", "id", "kind", F.unix_timestamp("created_at").alias("at"))


@query("w02_largest_gap", """WITH g AS (SELECT user_id AS outlet, lag(ts) OVER w AS b, ts AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
  UNION ALL SELECT user_id, max(ts), TIMESTAMP '2024-02-01' FROM events GROUP BY 1)
  SELECT outlet, max(CAST(floor(epoch(e)) - floor(epoch(b)) AS BIGINT)) AS seconds FROM g WHERE b IS NOT NULL GROUP BY 1""")
def w02(spark, d):
    until = F.lit("2024-02-01").cast("timestamp_ntz")
    return windows.largest_gap(view(spark, d, "v_items"), ["outlet"], "created_at", until).select("outlet", "seconds")


@query("w03_close_pairs", """SELECT source, count(*) AS n FROM (SELECT user_id AS source, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
  WHERE floor(epoch(nxt)) - floor(epoch(ts)) <= 1.5 * 30 * 60 GROUP BY 1""")
def w03(spark, d):
    return windows.close_pairs(view(spark, d, "v_polls"), "source", "polled_at", 30).groupBy("source").agg(F.count("*").alias("n"))


@query("w05_active_minutes", """WITH g AS (SELECT user_id AS source, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS BIGINT) AS g FROM events)
  SELECT source, round(coalesce(sum(g) FILTER (WHERE g <= 18000), 0) / 60.0, 4) AS minutes FROM g GROUP BY 1""")
def w05(spark, d):
    return windows.active_minutes(view(spark, d, "v_polls"), "source", "polled_at", 300).select("source", F.round("minutes", 4).alias("minutes"))


@query("w06_zero_runs", """WITH h AS (SELECT event_type AS kind, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hr, count(*) AS n FROM events GROUP BY 1, 2),
  k AS (SELECT DISTINCT kind FROM h), b AS (SELECT min(hr) AS lo, max(hr) AS hi FROM h),
  s AS (SELECT kind, unnest(range(lo, hi + 1)) AS hr FROM k, b),
  r AS (SELECT s.kind, s.hr, coalesce(n, 0) AS n FROM s LEFT JOIN h ON h.kind = s.kind AND h.hr = s.hr),
  i AS (SELECT *, sum(CASE WHEN n <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY hr) AS island FROM r),
  u AS (SELECT kind, island, count(*) FILTER (WHERE n = 0) AS z FROM i GROUP BY 1, 2),
  l AS (SELECT kind, max(island) AS last FROM u GROUP BY 1)
  SELECT u.kind, max(z) FILTER (WHERE island = last) AS current, coalesce(max(z) FILTER (WHERE island < last), 0) AS longest_before FROM u JOIN l USING (kind) GROUP BY 1""")
def w06(spark, d):
    hours = table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), F.floor(F.unix_timestamp("ts") / 3600).alias("hr")).agg(F.count("*").alias("n"))
    span = hours.agg(F.min("hr").alias("lo"), F.max("hr").alias("hi"))
    spine = hours.select("kind").distinct().crossJoin(F.broadcast(span)).select("kind", F.explode(F.sequence("lo", "hi")).alias("hr"))
    runs = spine.join(hours, ["kind", "hr"], "left").fillna(0, ["n"])
    return windows.zero_runs(runs, "kind", "hr", "n").select("kind", "current", F.col("longest_before").cast("long").alias("longest_before"))


@query("w07_sustained", """WITH r AS (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
  SELECT key, count(*) = 2 AND bool_and(value > 20) AS sustained FROM r WHERE r <= 2 GROUP BY 1""")
def w07(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", (F.col("value") - 20).alias("v"))
    return windows.sustained(rows, "key", "event_id", "v", 2)


@query("w08_volume_anomaly", """WITH b AS (SELECT event_id, value, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS baseline FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT event_id, round(baseline, 8) AS baseline, coalesce(baseline > 0 AND value >= 2.5 * baseline, false) AS anomaly FROM b""")
def w08(spark, d):
    rows = windows.volume_anomaly(table(spark, d, "events"), "user_id", "event_id", "value")
    return rows.select("event_id", F.round("baseline", 8).alias("baseline"), "anomaly")


@query("w09_moving_average", sql_with("v_prices") + """ SELECT key, date, round(CASE WHEN count(close) OVER w >= 200 THEN avg(close) OVER w END, 7) AS average
  FROM v_prices WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")
def w09(spark, d):
    return windows.moving_average(view(spark, d, "v_prices"), "key", "date", "close").select("key", "date", F.round("average", 7).alias("average"))


@query("w10_forward_returns", sql_with("v_prices") + """, f AS (SELECT key, date, h AS horizon, close, lead(close, CAST(h AS INT)) OVER (PARTITION BY key, h ORDER BY date) AS nxt FROM v_prices, (VALUES (1), (3), (5), (10)) t(h))
  SELECT key, date, horizon, round(nxt / close - 1, 6) AS forward FROM f WHERE close <> 0 AND nxt IS NOT NULL""")
def w10(spark, d):
    got = windows.forward_returns(view(spark, d, "v_prices"), "key", "date", "close", [1, 3, 5, 10])
    return got.select("key", "date", "horizon", F.round("forward", ROUND).alias("forward"))


@query("w11_deltas", sql_with("v_sentiment") + """, x AS (SELECT key, date, value - lag(value) OVER (PARTITION BY key ORDER BY date) AS d FROM v_sentiment)
  SELECT key, date, round(d, 6) AS delta FROM x WHERE d IS NOT NULL""")
def w11(spark, d):
    return windows.deltas(view(spark, d, "v_sentiment"), "key", "date", "value").select("key", "date", F.round("delta", ROUND).alias("delta"))


@query("w12_zscore", sql_with("v_sentiment") + """ SELECT key, date, round(CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 5) AS z
  FROM v_sentiment WINDOW w AS (PARTITION BY key)""")
def w12(spark, d):
    return windows.zscores(view(spark, d, "v_sentiment"), "key", "value").select("key", "date", F.round("z", 5).alias("z"))


@query("w13_near_event", """WITH f AS (SELECT user_id AS key, event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM events)
  SELECT key, count(*) AS n FROM f WHERE n = 1 GROUP BY 1""")
def w13(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", (F.col("event_type") == "error").alias("hit"))
    return windows.near_flag(rows, "key", "event_id", "hit", 2).groupBy("key").agg(F.count("*").alias("n"))


@query("w14_average_rank", """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events""")
def w14(spark, d):
    return windows.average_ranks(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "rank")


@query("w15_fresh_samples", """WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c WHERE b IS NULL OR b <> event_type)
  SELECT user_id, event_id, event_type FROM k WHERE r <= 20""")
def w15(spark, d):
    return windows.fresh_samples(table(spark, d, "events"), "user_id", "event_id", "event_type", 20).select("user_id", "event_id", "event_type")


@query("w16_quantile_buckets", sql_with("v_sentiment") + """, b AS (SELECT key, value, (row_number() OVER (PARTITION BY key ORDER BY value, date) * 5 - 1) // count(*) OVER (PARTITION BY key) AS bucket FROM v_sentiment)
  SELECT key, CAST(bucket AS INT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY 1, 2""")
def w16(spark, d):
    got = windows.quantile_buckets(view(spark, d, "v_sentiment"), ["key"], ["value", "date"], 5)
    return got.groupBy("key", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("value"), ROUND).alias("mean"))


@query("w17_token_bucket", """WITH s AS (SELECT user_id, event_id, 1.5 AS a, value / 50 AS p, sum(1.5 - value / 50) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
  m AS (SELECT *, min(3 - p - s) OVER (PARTITION BY user_id ORDER BY event_id) AS room FROM s)
  SELECT event_id, round(s + least(1.0, room), 5) AS balance FROM m""")
def w17(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.lit(1.5).alias("a"), (F.col("value") / 50).alias("p"))
    return windows.token_bucket(rows, "user_id", "event_id", "a", "p", 1.0, 3.0).select("event_id", F.round("balance", 5).alias("balance"))


@query("w18_newest_run", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def w18(spark, d):
    return topk.newest_run(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type")


@query("w19_temporal_split", sql_with("v_sentiment") + """, s AS (SELECT key, date, CASE WHEN row_number() OVER (ORDER BY date, key) <= floor(count(*) OVER () * 0.5) THEN 'discovery' ELSE 'holdout' END AS part FROM v_sentiment)
  SELECT key, part, count(*) AS n FROM s GROUP BY 1, 2""")
def w19(spark, d):
    got = windows.temporal_split(view(spark, d, "v_sentiment"), [], ["date", "key"], 0.5)
    return got.groupBy("key", "part").agg(F.count("*").alias("n"))


# ---- joins

@query("j01_window_items", f"SELECT event_id, c_name, {_secs('ts')} AS at FROM events JOIN customer ON user_id = c_custkey WHERE ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-15'")
def j01(spark, d):
    got = joins.windowed_items(table(spark, d, "events"), table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "ts", F.lit("2024-01-15").cast("timestamp_ntz"), 48)
    return got.select("event_id", "c_name", F.unix_timestamp("ts").alias("at"))


@query("j02_day_buckets", "SELECT user_id AS outlet, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS BIGINT) AS ago, count(*) AS n FROM events GROUP BY 1, 2")
def j02(spark, d):
    return joins.day_bucket_counts(table(spark, d, "events"), "user_id", "ts", F.lit("2024-02-01").cast("timestamp_ntz"))


@query("j03_left_join_on_version", "SELECT count(*) AS n, count(l_linenumber) AS done FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 7 WHERE l_linenumber IS NULL OR o_orderstatus = 'F'")
def j03(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") == 7)
    rows = table(spark, d, "orders").join(items, on, "left").filter("l_linenumber IS NULL OR o_orderstatus = 'F'")
    return rows.agg(F.count("*").alias("n"), F.count("l_linenumber").alias("done"))


@query("j04_anti_count", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j04(spark, d):
    return joins.anti_count(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


PAIRS = sql_with("v_assertions") + """, p AS (SELECT DISTINCT x.item AS a, y.item AS b, x.created_at AS ta, y.created_at AS tb FROM v_assertions x JOIN v_assertions y ON x.event = y.event AND x.item < y.item AND x.outlet <> y.outlet)"""


@query("j05_cross_outlet_pairs", PAIRS + " SELECT count(*) AS pairs, sum(a) AS sa, sum(b) AS sb FROM p".replace("sum(a)", "CAST(sum(a) AS BIGINT)").replace("sum(b)", "CAST(sum(b) AS BIGINT)"))
def j05(spark, d):
    pairs = joins.pairs_by_key(view(spark, d, "v_assertions"), "event", "item", "outlet", "created_at")
    return pairs.agg(F.count("*").alias("pairs"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))


@query("j06_pairs_within_hours", PAIRS + " SELECT a, b, count(*) AS n FROM p WHERE abs(epoch(ta) - epoch(tb)) <= 72 * 3600 GROUP BY 1, 2")
def j06(spark, d):
    pairs = joins.pairs_by_key(view(spark, d, "v_assertions"), "event", "item", "outlet", "created_at", 72 * 3600)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("j08_similar_titles", f"""WITH t AS (SELECT p_partkey AS id, {GRAMS.format('p_name')} AS g FROM part),
  x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS k, len(a.g) AS n, len(b.g) AS m FROM t a JOIN t b ON a.id < b.id)
  SELECT a, b, round(k / (n + m - k), 6) AS similarity FROM x WHERE k / (n + m - k) >= 0.8""")
def j08(spark, d):
    return joins.similar_pairs(table(spark, d, "part"), "p_partkey", "p_name", 0.8, ROUND)


@query("j09_rolled_off", "SELECT e.user_id AS source, count(*) AS n FROM events e WHERE EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type <> 'error' AND p.ts > e.ts) GROUP BY 1")
def j09(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), "event_id", "ts")
    polls = view(spark, d, "v_polls").filter("failure IS NULL").select("source", "polled_at")
    return joins.with_later(e, polls, "source", "ts", "polled_at").groupBy("source").agg(F.count("*").alias("n"))


@query("j11_pair_list", """SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name = b.p_name AS same FROM (SELECT DISTINCT l_partkey AS x, l_orderkey % 1000 AS y FROM lineitem)
  JOIN part a ON a.p_partkey = x JOIN part b ON b.p_partkey = y""")
def j11(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_orderkey") % 1000).alias("b")).distinct()
    got = joins.pair_list(pairs, table(spark, d, "part"), "p_partkey", ["p_name"])
    return got.select("a", "b", (F.col("p_name_a") == F.col("p_name_b")).alias("same"))


@query("j12_candidate_pool", """WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2, 3))
  SELECT l_orderkey AS event, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem JOIN f USING (l_orderkey) GROUP BY 1""")
def j12(spark, d):
    a = view(spark, d, "v_assertions")
    pool = a.join(a.filter(F.col("outlet").isin(1, 2, 3)).select("event").distinct(), "event", "left_semi")
    sets = pool.groupBy("event").agg(F.array_sort(F.collect_set("outlet")).alias("s"))
    return sets.select("event", F.size("s").cast("long").alias("n"), F.array_min("s").alias("lo"), F.array_max("s").alias("hi"))


@query("j14_entity_births", """SELECT c_custkey AS entity, least(DATE '1997-01-01', min(CAST(o_orderdate AS DATE))) AS born FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j14(spark, d):
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("first"))
    rows = table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("entity"), F.least(F.lit("1997-01-01").cast("date"), F.col("first")).alias("born"))


@query("j15_interval_containment", """WITH s AS (SELECT user_id AS source, event_type AS hash, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2)
  SELECT e.event_id, count(s.hash) AS live FROM events e JOIN s ON s.source = e.user_id AND e.ts BETWEEN s.f AND s.l GROUP BY 1""")
def j15(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), "event_id", "ts")
    spans = table(spark, d, "events").groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("hash")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return joins.live_at(e, spans, "source", "ts", "first_seen", "last_seen").groupBy("event_id").agg(F.count("hash").alias("live"))


@query("j16_poll_overlap", """WITH s AS (SELECT user_id AS source, event_type AS hash, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2),
  p AS (SELECT user_id AS source, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
  SELECT p.event_id, round(count(s.hash) FILTER (WHERE s.l >= nxt) / nullif(count(s.hash), 0), 6) AS overlap FROM p LEFT JOIN s ON s.source = p.source AND p.ts BETWEEN s.f AND s.l WHERE nxt IS NOT NULL GROUP BY 1""")
def j16(spark, d):
    e = table(spark, d, "events")
    spans = e.groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("hash")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    got = joins.overlap_share(e.select(F.col("user_id").alias("source"), F.col("ts").alias("at")).distinct(), spans)
    ids = e.select(F.col("user_id").alias("source"), F.col("ts").alias("at"), "event_id")
    return got.join(ids, ["source", "at"]).select("event_id", F.round("overlap", ROUND).alias("overlap"))


ASOF = sql_with("v_prices") + """, l AS (SELECT o_orderkey AS id, o_orderpriority AS key, CAST(o_orderdate AS DATE) + 3 AS date FROM orders), r AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""


def _asof_sides(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("key"), F.date_add(F.to_date("o_orderdate"), 3).alias("date"))
    right = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"))
    return left, right


@query("j17_asof_backward", ASOF + " SELECT l.id, r.date AS value_at, r.close AS value FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.date >= r.date")
def j17(spark, d):
    left, right = _asof_sides(spark, d)
    return joins.asof_backward(left, right, ["key"], "date", "date", "close").select("id", "value_at", "value")


@query("j18_asof_tolerance", ASOF + " SELECT l.id, CASE WHEN l.date - r.date <= 3 THEN r.close END AS value FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.date >= r.date")
def j18(spark, d):
    left, right = _asof_sides(spark, d)
    return joins.asof_backward(left, right, ["key"], "date", "date", "close", tolerance=3).select("id", "value")


@query("j19_snap_forward", ASOF + " SELECT l.key, r.date AS snapped, count(*) AS n FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.date <= r.date WHERE r.date - l.date <= 4 GROUP BY 1, 2")
def j19(spark, d):
    left, right = _asof_sides(spark, d)
    got = joins.asof_forward(left, right, ["key"], "date", "date", 4).filter("snapped IS NOT NULL")
    return got.groupBy("key", "snapped").agg(F.count("*").alias("n"))


@query("j20_asof_calendar", ASOF + " SELECT r.key, r.date AS day, count(*) AS n FROM l ASOF JOIN r ON l.key = r.key AND l.date >= r.date GROUP BY 1, 2")
def j20(spark, d):
    left, right = _asof_sides(spark, d)
    got = joins.asof_backward(left, right, ["key"], "date", "date", "close").filter("value_at IS NOT NULL")
    return got.groupBy("key", F.col("value_at").alias("day")).agg(F.count("*").alias("n"))


@query("j21_aligned_series", sql_with("v_prices", "v_sentiment") + """, f AS (SELECT key, date, lead(close, 5) OVER (PARTITION BY key ORDER BY date) / close - 1 AS fwd FROM v_prices)
  SELECT s.key, s.date, s.value, round(f.fwd, 6) AS forward FROM v_sentiment s JOIN f USING (key, date) WHERE f.fwd IS NOT NULL""")
def j21(spark, d):
    fwd = windows.forward_returns(view(spark, d, "v_prices"), "key", "date", "close", [5])
    return joins.aligned(view(spark, d, "v_sentiment"), fwd, "key", "date").select("key", "date", "value", F.round("forward", ROUND).alias("forward"))


@query("j22_lookup_default", "SELECT coalesce(n_name, 'unknown') AS nation, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3 GROUP BY 1")
def j22(spark, d):
    nations = table(spark, d, "nation").select((F.col("n_nationkey") - 3).alias("c_nationkey"), "n_name")
    return joins.lookup_with_default(table(spark, d, "customer"), nations, "c_nationkey", "n_name", "unknown", "nation").groupBy("nation").agg(F.count("*").alias("n"))


@query("j25_latest_with_default", """SELECT c_custkey, coalesce(arg_max(o_orderstatus, o_orderkey), 'none') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j25(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return joins.latest_with_default(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderkey"], "status", "none")


@query("j30_in_top_runs", """SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 5) GROUP BY 1""")
def j30(spark, d):
    return joins.of_top_keys(table(spark, d, "events"), "user_id", 5).groupBy("event_type").agg(F.count("*").alias("n"))


@query("j33_dictionary_hits", """WITH f AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS form FROM part),
  t AS (SELECT p_partkey AS item, unnest(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'))) AS w FROM part)
  SELECT item, form AS entity FROM t JOIN f ON w = form""")
def j33(spark, d):
    part = table(spark, d, "part")
    forms = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("form")).distinct().withColumn("entity", F.col("form"))
    return joins.dictionary_hits(part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text")), forms)


@query("j35_state_changes", """WITH n AS (SELECT user_id AS key, max(event_id) AS d, count(*) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1),
  b AS (SELECT user_id AS key, max(event_id) AS bd, count(*) AS bs FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
  SELECT key, CASE WHEN d IS NULL THEN 'stale' WHEN d IS DISTINCT FROM bd OR s > coalesce(bs, -1) THEN 'alert' ELSE 'same' END AS action FROM n FULL JOIN b USING (key)""")
def j35(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "key")
    side = lambda rows: rows.groupBy("key").agg(F.max("event_id").alias("d"), F.count("*").alias("s"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return joins.state_changes(side(e.filter(F.col("ts") >= at("2024-01-10"))), side(e.filter(F.col("ts") < at("2024-01-20"))), "key", "d", "s").select("key", "action")


# ---- statistics

@query("l01_rank_ic", sql_with("v_prices", "v_sentiment") + """, f AS (SELECT key, date, lead(close, 5) OVER (PARTITION BY key ORDER BY date) / close - 1 AS fwd FROM v_prices),
  p AS (SELECT s.key, s.value AS x, f.fwd AS y FROM v_sentiment s JOIN f USING (key, date) WHERE fwd IS NOT NULL),
  r AS (SELECT key, rank() OVER (PARTITION BY key ORDER BY x) + (count(*) OVER (PARTITION BY key, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY key ORDER BY y) + (count(*) OVER (PARTITION BY key, y) - 1) / 2.0 AS ry FROM p)
  SELECT key, count(*) AS n, round((avg(rx * ry) - avg(rx) * avg(ry)) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS ic FROM r GROUP BY 1""")
def l01(spark, d):
    pairs = j21_pairs(spark, d)
    return stats.rank_ic(pairs, ["key"], "value", "forward").select("key", "n", F.round("ic", ROUND).alias("ic"))


def j21_pairs(spark, d):
    fwd = windows.forward_returns(view(spark, d, "v_prices"), "key", "date", "close", [5])
    return view(spark, d, "v_sentiment").join(fwd, ["key", "date"])


@query("l02_pearson", "SELECT l_returnflag AS key, count(*) AS n, round((avg(l_quantity * l_extendedprice) - avg(l_quantity) * avg(l_extendedprice)) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 6) AS r FROM lineitem GROUP BY 1")
def l02(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "key")
    return stats.pearson(rows, ["key"], "l_quantity", "l_extendedprice").select("key", "n", F.round("r", ROUND).alias("r"))


@query("l03_hit_rate", sql_with("v_prices", "v_sentiment") + """, f AS (SELECT key, date, lead(close, 5) OVER (PARTITION BY key ORDER BY date) / close - 1 AS fwd FROM v_prices)
  SELECT key, round(avg(CASE WHEN sign(value - 0.05) = sign(fwd) THEN 1.0 ELSE 0 END) FILTER (WHERE value - 0.05 <> 0 AND fwd <> 0), 6) AS hit_rate,
  count(*) FILTER (WHERE value - 0.05 <> 0 AND fwd <> 0) AS n FROM v_sentiment JOIN f USING (key, date) WHERE fwd IS NOT NULL GROUP BY 1""")
def l03(spark, d):
    pairs = j21_pairs(spark, d).withColumn("x", F.col("value") - 0.05)
    return stats.hit_rate(pairs, ["key"], "x", "forward").select("key", F.round("hit_rate", ROUND).alias("hit_rate"), "n")


@query("l04_backtest", sql_with("v_prices", "v_sentiment") + """, z AS (SELECT key, date, coalesce((value - avg(value) OVER (PARTITION BY key)) / nullif(CASE WHEN stddev_pop(value) OVER (PARTITION BY key) > 1e-12 THEN stddev_pop(value) OVER (PARTITION BY key) END, 0), 0) AS z FROM v_sentiment),
  f AS (SELECT key, date, h AS horizon, lead(close, h) OVER (PARTITION BY key, h ORDER BY date) / close - 1 AS fwd FROM v_prices, (VALUES (1), (3), (5), (10)) t(h) WHERE close <> 0),
  p AS (SELECT horizon, z, fwd, CASE WHEN row_number() OVER (PARTITION BY horizon ORDER BY date, key) <= floor(count(*) OVER (PARTITION BY horizon) * 0.5) THEN 'discovery' ELSE 'holdout' END AS part FROM z JOIN f USING (key, date) WHERE fwd IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY horizon, part ORDER BY z) + (count(*) OVER (PARTITION BY horizon, part, z) - 1) / 2.0 AS rz, rank() OVER (PARTITION BY horizon, part ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, part, fwd) - 1) / 2.0 AS rf FROM p)
  SELECT horizon, part, count(*) AS n, round((avg(rz * rf) - avg(rz) * avg(rf)) / (stddev_pop(rz) * stddev_pop(rf)), 5) AS ic, round(avg((sign(z) = sign(fwd))::INT) FILTER (WHERE z <> 0 AND fwd <> 0), 5) AS hit_rate FROM r GROUP BY 1, 2""")
def l04(spark, d):
    got = stats.backtest(view(spark, d, "v_sentiment"), view(spark, d, "v_prices"), "key", "date", "value", "close", [1, 3, 5, 10])
    return got.select("horizon", "part", "n", F.round("ic", 5).alias("ic"), F.round("hit_rate", 5).alias("hit_rate"))


@query("l06_pooled_share", sql_with("v_assertions") + """, g AS (SELECT event // 8 AS grp, item, outlet, event FROM v_assertions), m AS (SELECT grp FROM g GROUP BY 1 HAVING count(DISTINCT outlet) >= 2),
  s AS (SELECT grp, event, count(DISTINCT outlet) >= 2 AND count(DISTINCT item) >= 2 AS c FROM g GROUP BY 1, 2), c AS (SELECT grp, bool_or(c) AS c FROM s GROUP BY 1)
  SELECT count(*) AS groups, count(*) FILTER (WHERE c) AS confirmed, round(avg(c::INT), 6) AS share FROM m JOIN c USING (grp)""")
def l06(spark, d):
    rows = view(spark, d, "v_assertions").withColumn("grp", F.floor(F.col("event") / 8))
    return stats.pooled_share(rows, "grp", "item", "outlet", "event").select("groups", "confirmed", F.round("share", ROUND).alias("share"))


GROUPED = sql_with("v_assertions") + """, o AS (SELECT DISTINCT event // 4 AS grp, item, outlet FROM v_assertions),
  li AS (SELECT DISTINCT item, event FROM v_assertions)"""


@query("l08_pair_recall", GROUPED + """, p AS (SELECT a.grp, a.item AS i, a.outlet AS oa, b.item AS j, b.outlet AS ob FROM o a JOIN o b ON a.grp = b.grp AND a.item < b.item AND a.outlet <> b.outlet),
  l AS (SELECT DISTINCT p.grp, p.i, p.j FROM p JOIN li x ON x.item = p.i JOIN li y ON y.item = p.j AND x.event = y.event)
  SELECT (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM l) AS linked, round((SELECT count(*) FROM l) / (SELECT count(*) FROM p), 6) AS recall""")
def l08(spark, d):
    a = view(spark, d, "v_assertions")
    got = stats.pair_recall(a.withColumn("grp", F.floor(F.col("event") / 4)), a.select("item", "event"), "grp", "item", "outlet")
    return got.select("pairs", "linked", F.round("recall", ROUND).alias("recall"))


@query("l09_bcubed_recall", GROUPED + """, m AS (SELECT DISTINCT grp, item FROM o), s AS (SELECT grp, count(*) AS size FROM m GROUP BY 1),
  l AS (SELECT DISTINCT a.grp, a.item, b.item AS j FROM m a JOIN m b ON a.grp = b.grp AND a.item <> b.item JOIN li x ON x.item = a.item JOIN li y ON y.item = b.item AND x.event = y.event),
  k AS (SELECT grp, item, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT count(*) AS items, round(avg((1 + coalesce(n, 0)) / size), 6) AS recall FROM m JOIN s USING (grp) LEFT JOIN k USING (grp, item)""")
def l09(spark, d):
    a = view(spark, d, "v_assertions")
    got = stats.bcubed_recall(a.withColumn("grp", F.floor(F.col("event") / 4)), a.select("item", "event"), "grp", "item")
    return got.select("items", F.round("recall", ROUND).alias("recall"))


CELLS = """WITH c AS (SELECT coalesce('g' || quality, 's' || d.doc_id) AS a, coalesce('g' || toxic, 's' || d.doc_id) AS b, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2),
  t AS (SELECT sum(n * (n - 1) / 2) AS sab, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))"""


@query("l10_pairwise_agreement", CELLS + " SELECT round(sab / sb, 6) AS precision, round(sab / sa, 6) AS recall, round(2 * sab / (sa + sb), 6) AS f1 FROM t, x, y")
def l10(spark, d):
    return _labels_agreement(spark, d).select(F.round("precision", ROUND).alias("precision"), F.round("recall", ROUND).alias("recall"), F.round("f1", ROUND).alias("f1"))


@query("l11_adjusted_rand", CELLS + " SELECT round((sab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM t, x, y")
def l11(spark, d):
    return _labels_agreement(spark, d).select(F.round("ari", ROUND).alias("ari"))


def _labels_agreement(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return stats.agreement(rows, "quality", "toxic", "doc_id")


_POISSON = " + ".join(f"(u >= {sum(0.36787944117144233 / d for d in (1, 1, 2, 6, 24, 120, 720, 5040)[:k])!r})::INT" for k in range(1, 9))


@query("l12_bootstrap_interval", f"""WITH d AS (SELECT quality AS v, rep, ('0x' || substr(md5('20260928|' || doc_id || '|' || rep), 1, 8))::BIGINT / 4294967296.0 AS u FROM labels, range(1, 201) t(rep) WHERE quality IS NOT NULL),
  m AS (SELECT rep, sum(v * ({_POISSON})) / nullif(sum({_POISSON}), 0) AS m, count(*) AS n FROM d GROUP BY 1) SELECT CASE WHEN max(n) >= 100 THEN round(quantile_cont(m, 0.025), 9) END AS low, CASE WHEN max(n) >= 100 THEN round(quantile_cont(m, 0.975), 9) END AS high FROM m""")
def l12(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return stats.bootstrap_interval(rows, "doc_id", "quality", reps=200).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("l13_mde", """WITH m AS (SELECT count(*) AS m FROM lineitem GROUP BY l_orderkey), e AS (SELECT 1 + (avg(m) * (1 + var_pop(m) / (avg(m) * avg(m))) - 1) * 0.1 AS effect, sum(m) AS s FROM m)
  SELECT round(effect, 6) AS effect, round(2.8 * sqrt(0.5 * effect / s), 6) AS mde FROM e""")
def l13(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"))
    return stats.design_effect_mde(sizes, "m", 0.1).select(F.round("effect", ROUND).alias("effect"), F.round("mde", ROUND).alias("mde"))


@query("l14_clustered_interval", """WITH c AS (SELECT l_orderkey, CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS y, count(*) AS m FROM lineitem GROUP BY 1),
  s AS (SELECT sum(y) AS sy, sum(m) AS sm, count(*) AS k, sum(y * y) AS yy, sum(y * m) AS ym, sum(m * m) AS mm FROM c),
  e AS (SELECT sy / sm AS p, sqrt(k * (yy - 2 * (sy / sm) * ym + (sy / sm) * (sy / sm) * mm) / (k - 1)) / sm AS se FROM s)
  SELECT round(p, 6) AS share, round(p - 2 * se, 6) AS low, round(p + 2 * se, 6) AS high FROM e""")
def l14(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("hit"))
    got = stats.clustered_interval(rows, "l_orderkey", "hit")
    return got.select(*[F.round(c, ROUND).alias(c) for c in ("share", "low", "high")])


@query("l15_go_no_go", "WITH g AS (SELECT user_id, count(DISTINCT event_type) AS k, count(*) AS m FROM events GROUP BY 1) SELECT round(avg(k), 6) AS mean_groups, median(m) AS median_minutes, avg(k) >= 8 AND median(m) <= 80 AS go FROM g")
def l15(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("k"), F.count("*").alias("m"))
    return stats.go_no_go(g, "k", "m").withColumn("mean_groups", F.round("mean_groups", ROUND))


@query("l16_paired_interval", "SELECT round(avg(l_tax - l_discount), 6) AS mean, round(avg(l_tax - l_discount) - 1.96 * stddev_samp(l_tax - l_discount) / sqrt(count(*)), 6) AS low, round(avg(l_tax - l_discount) + 1.96 * stddev_samp(l_tax - l_discount) / sqrt(count(*)), 6) AS high FROM lineitem")
def l16(spark, d):
    got = stats.paired_interval(table(spark, d, "lineitem"), "l_tax", "l_discount")
    return got.select(*[F.round(c, ROUND).alias(c) for c in ("mean", "low", "high")])


@query("l17_simplest_variant", """WITH v AS (SELECT l_linenumber AS o, avg((l_returnflag = 'N')::INT) AS share FROM lineitem GROUP BY 1)
  SELECT o, round(share, 6) AS share FROM v WHERE share >= (SELECT max(share) FROM v) - 0.05 ORDER BY o LIMIT 1""")
def l17(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("o")).agg(F.avg((F.col("l_returnflag") == "N").cast("int")).alias("share"))
    return stats.simplest_within(v, "o", "share").withColumn("share", F.round("share", ROUND))
