"""Queries on scalars, predicates, state tables, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.operators import aggregates, state, topk
from tidewater.plans.catalog import query, table
from tidewater.plans.relational import GRAMS
from tidewater.plans.views import view
from tidewater.sources import readers
from tidewater.streaming import monitors

ROUND = 6


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---- scalars

@query("f01_normalized_url", r"""WITH u AS (SELECT page_id, split_part(url, '#', 1) AS p FROM pages), q AS (SELECT page_id, split_part(p, '?', 1) AS b, list_filter(string_split(CASE WHEN p LIKE '%?%' THEN substr(p, length(split_part(p, '?', 1)) + 2) ELSE '' END, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')) AS k FROM u)
  SELECT page_id, CASE WHEN len(k) > 0 THEN b || '?' || array_to_string(k, '&') ELSE b END AS url FROM q""")
def f01(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.normalize_url(F.col("url")).alias("url"))


@query("f02_content_hash", r"""WITH u AS (SELECT page_id, split_part(url, '#', 1) AS p FROM pages), q AS (SELECT page_id, split_part(p, '?', 1) AS b, list_filter(string_split(CASE WHEN p LIKE '%?%' THEN substr(p, length(split_part(p, '?', 1)) + 2) ELSE '' END, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')) AS k FROM u)
  SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN 'g' || page_id WHEN len(k) > 0 THEN b || '?' || array_to_string(k, '&') ELSE b END) AS hash FROM q""")
def f02(spark, d):
    guid = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("g"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", scalars.content_hash(guid, F.col("url")).alias("hash"))


@query("f04_tokens", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'and', 'as', 'at', 'but', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 's', 'the', 'to', 'with', 'after', 'over', 'says', 'said', 'new', 'up', 'down', 'amid', 'its', 'his', 'her', 'their', 'that', 'this')))), ' ') AS tokens FROM benchmark")
def f04(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(scalars.tokens(F.col("text"))), " ").alias("tokens"))


@query("f05_fingerprint", r"SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(props, '\d[\d.,]*'), lambda n: rtrim(n, '.,')))), ' ') AS numbers, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(props || event_type), '[a-z0-9]+'), lambda w: NOT regexp_matches(w, '^[0-9]') AND w NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'by', 'for', 'from', 'had', 'has', 'have', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'will', 'with')))), ' ') AS words FROM events")
def f05(spark, d):
    text = F.concat("props", "event_type")
    return table(spark, d, "events").select("event_id", F.array_join(scalars.fingerprint_numbers(F.col("props")), " ").alias("numbers"), F.array_join(scalars.fingerprint_words(text), " ").alias("words"))


@query("f07_token_jaccard", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def f07(spark, d):
    t = table(spark, d, "benchmark").select("item_id", scalars.tokens(F.col("text"), []).alias("t"))
    b = t.select(F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return t.join(b, F.col("b") == F.col("item_id") + 1).select(F.col("item_id").alias("a"), "b", F.round(scalars.jaccard(F.col("t"), F.col("tb")), ROUND).alias("jaccard"))


@query("f08_trigram_similarity", f"WITH t AS (SELECT p_partkey AS k, {GRAMS.format('p_name')} AS g FROM part) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity FROM t a JOIN t b ON b.k = a.k + 1")
def f08(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("na"))
    b = t.select(F.col("a").alias("b"), F.col("na").alias("nb"))
    return t.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(scalars.trigram_similarity(F.col("na"), F.col("nb")), ROUND).alias("similarity"))


@query("f11_f12_f14_percentiles", """WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1)
  SELECT user_id, v[CAST(round_even(0.3 * (len(v) - 1), 0) AS INT) + 1] AS nearest, round(list_aggregate(v, 'quantile_cont', 0.3), 6) AS linear, list_aggregate(v, 'quantile_disc', 0.3) AS disc FROM v""")
def f11(spark, d):
    e = table(spark, d, "events")
    nearest = e.groupBy("user_id").agg(scalars.nearest_rank(F.collect_list("value"), 0.3).alias("nearest"))
    linear = aggregates.percentiles(e, ["user_id"], "value", [0.3]).select("user_id", F.round(F.col("cuts")[0], ROUND).alias("linear"))
    return nearest.join(linear, "user_id").join(aggregates.discrete_percentile(e, ["user_id"], "value", 0.3).withColumnRenamed("cut", "disc"), "user_id")


@query("f13_deciles", "SELECT event_type, array_to_string(list_transform(quantile_cont(value, [0.1, 0.5, 0.9]), lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ' ') AS deciles FROM events GROUP BY 1")
def f13(spark, d):
    got = aggregates.percentiles(table(spark, d, "events"), ["event_type"], "value", [0.1, 0.5, 0.9])
    return got.select("event_type", F.array_join(F.transform("cuts", lambda x: F.round(x * 1000).cast("long").cast("string")), " ").alias("deciles"))


@query("f15_f16_buckets", "SELECT event_id, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS bucket, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS six FROM events")
def f15(spark, d):
    return table(spark, d, "events").select("event_id", scalars.epoch_bucket(F.col("ts"), 2).alias("bucket"), scalars.six_hour_start(F.col("ts")).alias("six"))


@query("f17_f18_f19_durations", """SELECT o_orderkey, CASE WHEN o_orderkey >= 60 THEN (o_orderkey // 60) || 'h' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 'm' ELSE o_orderkey || 'm' END AS text,
  datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate AS DATE) + 30 AS resolution FROM orders""")
def f17(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", scalars.duration_text(F.col("o_orderkey") * 60).alias("text"),
        scalars.days_between(F.lit("1995-01-01"), F.date_format("o_orderdate", "yyyy-MM-dd")).cast("long").alias("days"), scalars.resolution_date(F.to_date("o_orderdate"), F.lit(30)).alias("resolution"))


@query("f20_f21_f22_dates", """SELECT o_orderkey, CAST(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) + 50 AS DATE) AS anchor, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS friday, CAST(o_orderdate AS DATE) AS compact FROM orders""")
def f20(spark, d):
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", scalars.quarter_anchor(quarter).alias("anchor"), scalars.iso_week_friday(F.to_date("o_orderdate")).alias("friday"), scalars.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("compact"))


@query("f23_f25_returns", """SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END * (o_totalprice / 150000 - 1), 6) AS r, CASE WHEN o_orderpriority = '1-URGENT' THEN 26 ELSE 10 END / 10000 AS haircut, round(CASE WHEN abs(o_totalprice / 50000) <= 3 THEN o_totalprice / 50000 END, 6) AS benchmark FROM orders""")
def f23(spark, d):
    direction, kind = F.when(F.col("o_orderstatus") == "O", "bullish").otherwise("bearish"), F.when(F.col("o_orderpriority") == "1-URGENT", "crypto").otherwise("equity")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(scalars.signal_return(direction, F.lit(150000.0), F.col("o_totalprice")), ROUND).alias("r"), scalars.haircut_fraction(kind).alias("haircut"),
        F.round(scalars.benchmark_or_null(F.col("o_totalprice") / 50000), ROUND).alias("benchmark"))


@query("f32_f36_turnovers", """WITH e AS (SELECT event_id, value, event_id % 5 AS k FROM events) SELECT event_id, round(30 / (1 - nullif(k / 4.0, 1)), 6) AS full_turnover, round(value * 60 / nullif(k, 0), 6) AS rate_turnover, round(value / nullif(k, 0), 6) AS flicker,
  CAST(floor(greatest(10, least(1440, value / 4))) AS INT) AS interval FROM e""")
def f32(spark, d):
    k = F.col("event_id") % 5
    return table(spark, d, "events").select(
        "event_id", F.round(scalars.full_turnover_minutes(k / 4, F.lit(30.0)), ROUND).alias("full_turnover"), F.round(scalars.turnover_from_rate(F.col("value"), k, F.lit(60)), ROUND).alias("rate_turnover"),
        F.round(scalars.flicker_ratio(F.col("value"), k), ROUND).alias("flicker"), scalars.proposed_interval(F.col("value")).alias("interval"))


@query("f41_f43_identities", r"SELECT page_id, left(sha256(url), 16) AS trigger, left(sha1(url), 10) AS short, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages")
def f41(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", scalars.trigger_hash(u).alias("trigger"), scalars.short_id(u).alias("short"), scalars.host(u).alias("host"))


@query("f31_f40_f49_numbers", """SELECT o_orderkey, CASE WHEN x >= 1e6 THEN printf('%.1f', x / 1e6) || 'M' WHEN x >= 1e3 THEN printf('%.1f', x / 1e3) || 'k' ELSE CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) END AS volume,
  round((o_orderkey * 3.0 + 100 * 15.0 + 50 * 3.0 * 0.1) / 1e6 / 2, 9) AS cost, CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS severity FROM (SELECT *, floor(o_totalprice / 100) * 100 AS x FROM orders)""")
def f31(spark, d):
    word = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("none"), F.lit("none")), F.left("o_orderpriority", F.lit(1)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", scalars.format_volume(F.floor(F.col("o_totalprice") / 100) * 100.0).alias("volume"), F.round(scalars.call_cost(F.col("o_orderkey"), F.lit(100), F.lit(50), 3.0, 15.0, batch=True), 9).alias("cost"), scalars.severity_rank(word).alias("severity"))


@query("s06_page_text", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))) AS n FROM pages")
def s06(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(readers.page_text(F.col("html"))).cast("long").alias("n"))


@query("x03_html_unescape")
def x03(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(scalars.clean(F.col("html"))).alias("n"))


# ---- predicates

@query("p02_exclusion_reason", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'empty_title' WHEN o_orderpriority = '5-LOW' THEN 'quote_page' WHEN o_totalprice > 200000 THEN 'backlog' END AS reason FROM orders")
def p02(spark, d):
    published = F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate") - F.expr("INTERVAL 25 HOURS")).otherwise(F.col("o_orderdate"))
    title = F.when(F.col("o_orderstatus") == "P", " ").otherwise("t")
    return table(spark, d, "orders").select("o_orderkey", predicates.exclusion_reason(title, F.col("o_orderpriority") == "5-LOW", published, F.col("o_orderdate")).alias("reason"))


@query("p13_due_feeds", "WITH l AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT user_id FROM l WHERE (epoch(TIMESTAMP '2024-01-30') - floor(epoch(t))) / 60 + 15 >= 600")
def p13(spark, d):
    last = table(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("t"))
    return last.filter(predicates.is_due(F.col("t"), _ntz("2024-01-30"), F.lit(600))).select("user_id")


@query("p19_p25_bands", """SELECT o_orderkey, o_totalprice / 150000 BETWEEN 0.1 AND 10 AS plausible, CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN 'low' WHEN o_totalprice >= 100000 AND o_totalprice < 300000 THEN 'mid' END AS band,
  CASE WHEN o_totalprice / 500000 < 0.4 THEN 'proceed' WHEN o_totalprice / 500000 <= 0.5 THEN 'within_6h_only' ELSE 'stop' END AS gap FROM orders""")
def p19(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", predicates.plausible_mark(F.lit(150000.0), v).alias("plausible"), predicates.band(v, [0, 100000, 300000], ["low", "mid"]).alias("band"), predicates.gap_band(v / 500000).alias("gap"))


@query("p28_p33_coercions", r"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS member, CASE WHEN try_cast(regexp_extract(props, '\d+') AS INT) BETWEEN 1 AND 3650 THEN try_cast(regexp_extract(props, '\d+') AS INT) END AS horizon,
  CASE WHEN try_cast(regexp_extract(props, '\d+') AS INT) >= 0 THEN try_cast(regexp_extract(props, '\d+') AS INT) END AS sources, coalesce(try_cast(event_type AS INT), 7) AS knob FROM events""")
def p28(spark, d):
    n = F.nullif(F.regexp_extract("props", r"\d+", 0), F.lit(""))
    return table(spark, d, "events").select(
        "event_id", predicates.enum_or_null(F.upper("event_type"), ["click", "view"]).alias("member"), predicates.horizon_days(n).alias("horizon"), predicates.source_count(n).alias("sources"), predicates.knob(F.col("event_type"), "int", 7).alias("knob"))


@query("p41_corroboration_cue", "SELECT l_orderkey, CASE WHEN count(*) >= 4 THEN 'widely reported' WHEN count(*) >= 2 THEN 'corroborated' ELSE 'single source' END AS cue FROM lineitem GROUP BY 1")
def p41(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(predicates.corroboration_cue(F.count("*")).alias("cue"))


# ---- state

def _halves(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("hash"), "event_id", F.unix_timestamp("ts").alias("at"))
    cut = F.unix_timestamp(_ntz("2024-01-15"))
    return rows.filter(F.col("at") < cut), rows.filter(F.col("at") >= cut)


@query("s39_insert_if_absent", "WITH n AS (SELECT user_id AS source, event_type AS hash, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2) SELECT source, hash, event_id FROM n WHERE (source, hash) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-15')")
def s39(spark, d):
    old, new = _halves(spark, d)
    return state.insert_if_absent(old, new, ["source", "hash"], ["event_id"]).select("source", "hash", "event_id")


@query("s42_upsert_seen", "SELECT user_id AS source, event_type AS hash, CAST(min(floor(epoch(ts))) AS BIGINT) AS first_seen, CAST(max(floor(epoch(ts))) AS BIGINT) AS last_seen, max(event_id) AS position FROM events GROUP BY 1, 2")
def s42(spark, d):
    old, new = (h.select("source", "hash", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"), F.col("event_id").alias("position")) for h in _halves(spark, d))
    start = old.groupBy("source", "hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("position").alias("position"))
    return state.upsert_seen(start, new, ["source", "hash"])


@query("s45_verdict_upsert", "SELECT user_id AS source, arg_max(event_type, event_id) AS hash, max(event_id) AS event_id, count(*) AS attempts FROM events GROUP BY 1")
def s45(spark, d):
    old, new = _halves(spark, d)
    start = old.groupBy("source").agg(F.max_by("hash", "event_id").alias("hash"), F.max("event_id").alias("event_id"), F.count("*").cast("int").alias("attempts"))
    return state.upsert_verdicts(start, new, "source", "hash", "event_id")


@query("s46_defer_or_charge", "SELECT o_orderkey, CAST(o_orderkey % 12 + CASE WHEN o_orderstatus = 'F' AND o_orderkey % 12 < 10 THEN 1 ELSE 0 END AS INT) AS defers, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 12 >= 10 THEN 1 ELSE 0 END AS attempts FROM orders")
def s46(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 12).cast("int").alias("defers"), F.lit(0).alias("attempts"))
    return state.defer_or_charge(rows, F.col("o_orderstatus") == "F", "defers", "attempts", 10).drop("o_orderstatus")


@query("s50_ledger_diff", """WITH b AS (SELECT user_id AS k, max(event_type) AS v FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1), a AS (SELECT user_id AS k, max(event_type) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1)
  SELECT k, CASE WHEN a.v IS NULL THEN 'retire' WHEN a.v IS DISTINCT FROM b.v THEN 'write' ELSE 'keep' END AS action, coalesce(a.v, b.v) AS v FROM b FULL JOIN a USING (k)""")
def s50(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "k")
    side = lambda rows: rows.groupBy("k").agg(F.max("event_type").alias("v"))
    return state.ledger_diff(side(e.filter(F.col("ts") < _ntz("2024-01-03"))), side(e.filter(F.col("ts") >= _ntz("2024-01-28"))), "k", ["v"])


@query("s51_sparse_upsert", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END, c_mktsegment) AS c_mktsegment, c_nationkey FROM customer")
def s51(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"))
    return state.upsert_sparse(c, new, "c_custkey", {})


@query("s54_state_upsert", "SELECT user_id AS source, arg_max(event_type, event_id) AS hash, max(event_id) AS event_id FROM events GROUP BY 1")
def s54(spark, d):
    old, new = _halves(spark, d)
    return state.upsert_latest(old.drop("at"), new.drop("at"), ["source"], "event_id")


@query("s56_replace_for_owner", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def s56(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return state.replace_for_owner(o.filter(F.col("o_orderdate") < _ntz("1997-01-01")), o.filter(F.col("o_orderdate") >= _ntz("1997-01-01")), "o_custkey").select("o_custkey", "o_orderkey")


@query("s61_pruned_by_age", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 90")
def s61(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return state.pruned_by_age(rows, "day", F.lit("1998-01-01").cast("date"), 90).select("o_orderkey")


@query("s10_nearest_vectors", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q ORDER BY round(list_cosine_similarity(v, q), 9) DESC, vec_id LIMIT 20""")
def s10(spark, d):
    e = table(spark, d, "embeddings")
    return readers.passages(e, e.filter("vec_id = 0").select("embedding"), 20).withColumn("score", F.round("score", ROUND))


@query("s18_pending_units", "SELECT CAST(n_nationkey AS VARCHAR) AS ticker, q AS quarter FROM nation, (VALUES ('2020Q1'), ('2020Q2'), (NULL)) t(q) WHERE NOT (n_nationkey % 5 = 0 AND q IS NULL) AND NOT (n_nationkey % 3 = 0 AND q IS NOT DISTINCT FROM '2020Q1')")
def s18(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("ticker"), "n_nationkey")
    quarters = spark.createDataFrame([("2020Q1",), ("2020Q2",)], "quarter string")
    done = t.filter("n_nationkey % 5 = 0").select("ticker", F.lit(None).cast("string").alias("quarter")).unionByName(t.filter("n_nationkey % 3 = 0").select("ticker", F.lit("2020Q1").alias("quarter")))
    return readers.pending_units(t, quarters, done)


@query("t03_liveness", "SELECT floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts))) > 5400 AS stale, count(*) FILTER (WHERE event_type = 'error') - CASE WHEN arg_max(event_type, ts) = 'error' THEN 1 ELSE 0 END > 0 AS crashed FROM events")
def t03(spark, d):
    runs = table(spark, d, "events").select(F.col("ts").alias("started_at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("finished_at"))
    return state.pass_liveness(runs, _ntz("2024-02-01"), 30)


@query("t06_volume_alerts", """WITH RECURSIVE e AS (SELECT user_id, ts, value, coalesce(value <> lag(value) OVER (PARTITION BY user_id ORDER BY ts), true) AS new FROM events),
  c AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM e), f AS (SELECT user_id, seen + 1 AS k, value FROM c WHERE new),
  m AS (SELECT c.user_id, c.ts, c.value, avg(f.value) AS mean, count(*) AS n FROM c JOIN f ON f.user_id = c.user_id AND f.k <= c.seen AND f.k > c.seen - 20 GROUP BY 1, 2, 3),
  h AS (SELECT * FROM m WHERE n >= 5 AND mean > 0 AND value >= 2.5 * mean),
  a AS (SELECT user_id, min(ts) AS ts FROM h GROUP BY 1 UNION ALL SELECT h.user_id, min(h.ts) FROM a JOIN h ON h.user_id = a.user_id AND h.ts >= a.ts + INTERVAL 12 HOUR GROUP BY 1)
  SELECT h.user_id, CAST(epoch_us(h.ts) AS BIGINT) AS at, h.value, round(h.value / h.mean, 6) AS ratio FROM a JOIN h ON h.user_id = a.user_id AND h.ts = a.ts""")
def t06(spark, d):
    got = monitors.volume_alerts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value")
    return got.select("user_id", F.unix_micros("at").alias("at"), "value", F.round("ratio", ROUND).alias("ratio"))


@query("t07_alert_once", "WITH r AS (SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS e FROM events), l AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM r) SELECT user_id, event_id, e FROM l WHERE e IS NOT NULL AND e IS DISTINCT FROM b")
def t07(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("error", "click"), F.col("event_type")).alias("e"))
    return state.alert_once(rows, "user_id", "event_id", "e")


@query("t09_headline_collapse", "SELECT lower(p_name) AS title, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1")
def t09(spark, d):
    return topk.collapsed_headlines(table(spark, d, "part"), F.lower("p_name"), "p_partkey")


@query("t10_mark_to_market", """WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS key, o_totalprice AS entry, CAST(o_orderdate AS DATE) AS d FROM orders),
  v AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1, 2),
  m AS (SELECT p.id, v.date, v.close, p.d FROM p JOIN v USING (key) WHERE v.date >= p.d AND v.date <= DATE '1998-01-01' AND v.close / p.entry BETWEEN 0.1 AND 10),
  l AS (SELECT id, arg_max(close, date) AS c, arg_max(close, date) FILTER (WHERE date - d <= 7) AS c7 FROM m GROUP BY 1)
  SELECT p.id, round(c / entry - 1, 6) AS last_return, round(CASE WHEN DATE '1998-01-01' - d >= 7 THEN c7 / entry - 1 END, 6) AS return_7, CASE WHEN DATE '1998-01-01' - d >= 28 THEN 'closed' ELSE 'open' END AS status FROM p LEFT JOIN l ON l.id = p.id""")
def t10(spark, d):
    p = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("instrument"), F.lit("bullish").alias("direction"), F.col("o_totalprice").alias("entry_price"), F.to_date("o_orderdate").alias("entry_date"))
    got = state.mark_to_market(p, view(spark, d, "v_prices").withColumnRenamed("key", "instrument"), F.lit("1998-01-01").cast("date"))
    return got.select("id", F.round("last_return", ROUND).alias("last_return"), F.round("return_7", ROUND).alias("return_7"), "status")


@query("t11_admitted", """WITH s AS (SELECT o_orderkey AS pos, o_orderpriority AS k, o_custkey AS t, o_orderstatus AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'), h AS (SELECT o_orderpriority AS k, o_custkey AS t, max(o_orderstatus) AS held FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2)
  SELECT pos, CASE WHEN held = d THEN 'held' WHEN held IS NOT NULL THEN 'opposite_held' WHEN row_number() OVER (PARTITION BY s.k, s.t ORDER BY pos) > 1 THEN 'repeat' ELSE 'open' END AS reason FROM s LEFT JOIN h ON s.k = h.k AND s.t = h.t""")
def t11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("asset_class"), F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("direction"), "o_orderdate")
    book = o.filter(F.col("o_orderdate") < _ntz("1997-01-01")).withColumn("status", F.lit("open"))
    return state.admitted(o.filter(F.col("o_orderdate") >= _ntz("1997-01-01")), book).select("pos", "reason")


@query("t13_merged_claims")
def t13(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") % 20).cast("string").alias("ledger"), "conv_id", "turn", "role", F.col("text").alias("claim"))
    number = F.format_string("c-%04d", F.dense_rank().over(Window.partitionBy("ledger").orderBy("conv_id", "turn")))  # over 9999 it grows longer
    prior = c.filter("role = 'user'").withColumn("id", number).select("ledger", "id", "claim")
    reply = c.filter("role = 'assistant' OR turn = 0").select("ledger", (F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("pos"), F.lit(None).cast("string").alias("id"), "claim", F.lit("fact").alias("kind"))
    return state.merge_claims(prior, reply)


@query("t17_t19_schedule", """SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS previous, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 + 3600 AS following,
  CASE WHEN event_type = 'view' THEN 'skip' WHEN CAST(floor(epoch(ts)) AS BIGINT) % 3600 <= 600 THEN 'run' ELSE 'missed' END AS decision FROM events""")
def t17(spark, d):
    due = state.previous_fire(F.col("ts"), every_minutes=60)
    last = F.when(F.col("event_type") == "view", due)
    return table(spark, d, "events").select("event_id", due.alias("previous"), state.next_fire(F.col("ts"), every_minutes=60).alias("following"), state.fire_decision(F.col("ts"), due, last, 10).alias("decision"))
