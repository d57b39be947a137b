"""Queries of predicates, coercions and scalar rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.functions.scalars import CLAIM_NOISE, NOISE_WORDS
from tidewater.operators import knowledge
from tidewater.plans.catalog import query, table

NOISE, CLAIM = tuple(NOISE_WORDS), tuple(CLAIM_NOISE)


@query("p01_quote_pages", """WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || ' Stock Price &amp; Latest News' WHEN 1 THEN 'About ' || p_name || ' (AB.N) - Reuters' WHEN 2 THEN 'VOD.L  - Reuters' WHEN 3 THEN p_name || ' says - Reuters' END AS x FROM part)
  SELECT p_partkey, p_size % 5 AS kind, coalesce(x LIKE '%Stock Price%' OR x LIKE 'About %' OR x LIKE 'VOD%', false) AS quote FROM t JOIN part USING (p_partkey)""")
def p01(spark, d):
    kind = F.col("p_size") % 5
    title = F.when(kind == 0, F.concat("p_name", F.lit(" Stock Price &amp; Latest News"))).when(kind == 1, F.concat(F.lit("About "), "p_name", F.lit(" (AB.N) - Reuters"))).when(kind == 2, "VOD.L  - Reuters").when(kind == 3, F.concat("p_name", F.lit(" says - Reuters")))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), predicates.is_quote_page(title).alias("quote"))


@query("p03_f10_syndication", f"""WITH t AS (SELECT p_partkey, lower(p_name) AS a, CASE p_size % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(p_name) || ' today' ELSE 'other words' END AS b FROM part),
  w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(a, '[a-z0-9]+')), lambda x: x NOT IN {NOISE}) AS x, list_filter(list_distinct(regexp_extract_all(b, '[a-z0-9]+')), lambda x: x NOT IN {NOISE}) AS y FROM t)
  SELECT p_partkey, b AS plain, a = b OR coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0) >= 0.85 AS same FROM w""")
def p03(spark, d):
    kind = F.col("p_size") % 3
    a = F.concat(F.upper("p_name"), F.lit(" - The Daily"))
    b = F.concat(F.when(kind == 0, F.concat(F.lit("“"), "p_name", F.lit("”"))).when(kind == 1, F.concat("p_name", F.lit(" today"))).otherwise(F.lit("other words!")), F.lit(" | Wire.com"))
    return table(spark, d, "part").select("p_partkey", scalars.normalise_title(b).alias("plain"), predicates.is_syndication(a, b).alias("same"))


@query("p07_form_matches", """SELECT p_partkey, p_size % 4 < 2 AND length(w) >= 4 OR p_size % 4 = 0 AS hit FROM (SELECT *, split_part(p_name, ' ', 1) AS w FROM part)""")
def p07(spark, d):
    word, kind = F.substring_index("p_name", " ", 1), F.col("p_size") % 4
    text = F.when(kind == 0, F.concat(F.lit("the ("), word, F.lit(") rose"))).when(kind == 1, F.concat(F.lit("the "), F.upper(word), F.lit(", rose"))).when(kind == 2, F.concat(word, F.lit("s rose"))).otherwise(F.concat(F.lit("un"), word))
    return table(spark, d, "part").select("p_partkey", predicates.form_matches(word, text).alias("hit"))


@query("p14_p15_p17_p18_rules", """SELECT c_custkey, c_custkey % 3 < 2 AS proxy, CASE WHEN c_mktsegment = 'BUILDING' THEN 'crypto' WHEN c_custkey % 4 = 0 THEN 'index' ELSE 'equity' END AS class,
  CASE WHEN c_nationkey % 5 > 1 THEN c_mktsegment ELSE '-' END AS word FROM customer""")
def p14(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, "https://News.Google.com/rss").when(k % 3 == 1, "http://www.bing.com/news/x").otherwise("http://x.org/news.google")
    ticker = F.when(k % 4 == 0, "SPX").otherwise("ABC")
    declared = F.when(F.col("c_mktsegment") == "BUILDING", "crypto").when(F.col("c_mktsegment") == "MACHINERY", "equity").otherwise("share")
    word = F.when(F.col("c_nationkey") % 5 == 0, " N/A ").when(F.col("c_nationkey") % 5 == 1, "None").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", predicates.is_proxy(url).alias("proxy"), predicates.asset_class(ticker, declared, ["SPX", "NDX"]).alias("class"), F.coalesce(predicates.null_words(word), F.lit("-")).alias("word"))


@query("p16_signals", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'bullish' WHEN 'R' THEN 'bearish' END AS direction, CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n
  FROM lineitem WHERE l_returnflag <> 'N' AND l_discount > 0.02 GROUP BY 1, 2, 3, 4, 5""")
def p16(spark, d):
    q = F.col("l_quantity")
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", " Long ").when(F.col("l_returnflag") == "R", "SHORT").otherwise("flat").alias("direction"),
        F.when(q > 30, "Strong").when(q > 10, " moderate").otherwise("weak").alias("confidence"), F.when(F.col("l_discount") > 0.02, "topic").otherwise("null").alias("topic"))
    return readers_signals(raw).groupBy("l_orderkey", "l_linenumber", "l_partkey", "direction", "confidence").agg(F.count("*").alias("n"))


def readers_signals(raw):
    from tidewater.sources import readers

    return readers.normalised_signals(raw)


@query("p22_price_verdicts", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS last, CASE WHEN l_linenumber = 7 OR l_discount > 0.05 THEN 'unknown' WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity < 25 THEN 'fired' ELSE 'not' END WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_quantity > 25 THEN 'fired' ELSE 'not' END
  WHEN l_linenumber >= 5 THEN CASE WHEN l_quantity > 20 THEN 'fired' ELSE 'not' END ELSE 'unknown' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5""")
def p22(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    condition = F.when(n % 3 == 0, "below").when(n % 3 == 1, "above").otherwise("above_ma200")
    verdict = predicates.price_verdict(condition, q, F.lit(25), F.lit(20), F.when(n == 7, 0).otherwise(n * 40), F.when(F.col("l_discount") > 0.05, 6).otherwise(5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("last"), verdict.alias("verdict")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "last", "verdict").agg(F.count("*").alias("n"))


@query("p23_p24_crossings", """SELECT event_id, CASE WHEN value >= 28 THEN event_type <> 'view' WHEN value >= 14 THEN event_type NOT IN ('view', 'click') WHEN value >= 7 THEN event_type = 'error' ELSE false END AS crossed, event_type <> 'error' AND epoch(ts) > epoch(TIMESTAMP '2024-01-15') AS cooling FROM events""")
def p23(spark, d):
    kind = F.col("event_type")
    recorded = F.when(kind == "view", F.array(F.lit(7), F.lit(14), F.lit(28))).when(kind == "click", F.array(F.lit(7), F.lit(14))).when(kind == "error", F.array().cast("array<int>")).otherwise(F.array(F.lit(7)))
    alert = F.when(kind == "error", "at noon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return table(spark, d, "events").select("event_id", predicates.has_new_crossing(F.col("value"), recorded).alias("crossed"), predicates.in_cooldown(alert, F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("cooling"))


@query("p26_p27_bands", """SELECT l_suppkey, CASE WHEN n < 100 THEN 'low' WHEN n < 200 THEN 'mid' WHEN n < 100000 THEN 'hub' END AS hub, CASE WHEN s < 0.4 THEN 'proceed' WHEN s <= 0.5 THEN 'within_6h_only' ELSE 'stop' END AS gap FROM (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN l_linenumber > 4 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM lineitem GROUP BY 1)""")
def p26(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg((F.col("l_linenumber") > 4).cast("double")).alias("s"))
    return rows.select("l_suppkey", predicates.band(F.col("n"), [0, 100, 200, 100000], ["low", "mid", "hub"]).alias("hub"), predicates.gap_band(F.col("s")).alias("gap"))


@query("p29_p30_p31_coercions", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN l_orderkey END AS horizon, CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber - 3 AS INT) END AS sources, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'triggered' END AS verdict, count(*) AS n
  FROM lineitem WHERE l_orderkey BETWEEN 1 AND 3650 GROUP BY 1, 2, 3, 4, 5""")
def p29(spark, d):
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem").filter("l_orderkey BETWEEN 1 AND 3650")
    days = F.when(n == 1, "true").when(n <= 4, F.col("l_orderkey").cast("string")).when(n == 5, "0").when(n == 6, "3651").otherwise("1.5")
    verdict = F.when(F.col("l_returnflag") == "N", "maybe").otherwise(" Triggered")
    rows = li.select("l_orderkey", "l_linenumber", predicates.horizon_days(days).cast("long").alias("horizon"), predicates.source_count(n - 3).alias("sources"), F.coalesce(predicates.enum_or_null(verdict, ["triggered", "unclear"]), F.lit("")).alias("verdict"))
    return rows.groupBy("l_orderkey", "l_linenumber", "horizon", "sources", "verdict").agg(F.count("*").alias("n"))


@query("p32_p37_p40_p42_p43_rules", """SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END ELSE 0 END AS strength,
  CASE WHEN s_nationkey % 4 = 3 THEN 'invalid' WHEN s_nationkey % 3 = 0 AND s_nationkey % 4 = 0 THEN 'unclear' WHEN s_nationkey % 3 = 0 THEN 'triggered' WHEN s_nationkey % 3 = 1 THEN 'unclear' ELSE 'not' END AS verdict,
  CASE WHEN s_nationkey % 2 = 0 AND s_suppkey > 30 THEN least(s_suppkey, 120) ELSE 30 END::BIGINT AS minutes, sign(s_acctbal) = 1 AND abs(s_acctbal / 10000) > 0.03 AS signed, s_nationkey < 5 OR s_acctbal < 0 AS throttled FROM supplier""")
def p32(spark, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    verdict = F.when(n % 3 == 0, "triggered").when(n % 3 == 1, "unclear").otherwise("not")
    evidence = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 3, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a")))
    return table(spark, d, "supplier").select(
        "s_suppkey", predicates.strength(verdict, F.col("s_acctbal") > 0).alias("strength"), predicates.evidence_verdict(verdict, evidence, F.array(F.lit("a"), F.lit("b"))).alias("verdict"),
        predicates.poll_interval(F.lit(30), k, n % 2 == 1).cast("long").alias("minutes"), predicates.sign_ok(F.col("s_acctbal") / 10000, F.lit(1)).alias("signed"),
        predicates.is_throttled(F.when(n < 5, "429"), F.when(F.col("s_acctbal") < 0, "slow")).alias("throttled"))


@query("p39_sections", """SELECT doc_id, CAST(doc_id % 3 AS INT) AS lines FROM documents WHERE doc_id % 3 > 0""")
def p39(spark, d):
    body = F.concat(F.lit("# First\nx\n## Second part\n"), F.repeat(F.lit("line\n"), (F.col("doc_id") % 3).cast("int")), F.lit("### Second part two\ny"))
    text = F.regexp_replace(body, "line\n###", "line\n###")
    rows = knowledge.section(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text", "Second part")
    return rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("lines"))


@query("p09_p10_p11_pending", """WITH v AS (SELECT l_orderkey AS item, max(l_linenumber) AS version, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS f, count(*) AS attempts FROM lineitem GROUP BY 1),
  p AS (SELECT o.o_orderkey AS item, o_orderdate FROM orders o LEFT JOIN v ON v.item = o.o_orderkey AND v.version = 6 WHERE v.item IS NULL OR (f = 'R' AND attempts < 3))
  SELECT item, epoch(TIMESTAMP '1997-06-01') - epoch(coalesce(CASE WHEN item % 4 > 0 THEN o_orderdate END, TIMESTAMP '1997-05-25')) > 14 * 86400 AS stale FROM p""")
def p09(spark, d):
    li = table(spark, d, "lineitem")
    verdicts = li.groupBy(F.col("l_orderkey").alias("item")).agg(F.max("l_linenumber").alias("version"), F.when(F.max_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")) == "R", "failed").otherwise("material").alias("verdict"), F.count("*").alias("attempts"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("timestamp")).alias("published_at"), F.lit("1997-05-25").cast("timestamp").alias("created_at"))
    return knowledge.pending(items, verdicts, 6, F.lit("1997-06-01").cast("timestamp")).select("item", "stale")


@query("p12_a49_at_risk", "WITH v AS (SELECT l_orderkey, count(*) AS attempts FROM lineitem GROUP BY 1) SELECT count(*) FILTER (WHERE attempts >= 3) AS gave_up, count(*) FILTER (WHERE attempts = 2) AS at_risk FROM v")
def p12(spark, d):
    return knowledge.at_risk(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts")))


@query("p35_triage_replies", """WITH r AS (SELECT l_suppkey AS request, l_partkey AS id, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS pos FROM lineitem)
  SELECT request, id AS item_id, arg_min(l_returnflag = 'A', pos) AS material FROM r WHERE l_returnflag <> 'N' AND id % 3 > 0 GROUP BY 1, 2""")
def p35(spark, d):
    li = table(spark, d, "lineitem")
    material = F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "R", "false").otherwise('"so"')
    one = F.concat(F.lit('{"id":'), F.col("l_partkey").cast("string"), F.lit(',"material":'), F.when(F.col("l_returnflag") != "N", material).otherwise("null"), F.lit("}"))
    rows = li.groupBy(F.col("l_suppkey").alias("request")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", one.alias("j")))).alias("a"))
    replies = rows.select("request", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]")).alias("json"))
    offered = li.filter("l_partkey % 3 > 0").select(F.col("l_suppkey").alias("request"), F.col("l_partkey").alias("item_id")).distinct()
    return knowledge.parsed_triage(replies, offered)


@query("p36_verdict_rows", """WITH r AS (SELECT l_partkey AS id, arg_min(l_linenumber, (l_orderkey, l_linenumber, l_suppkey)) AS n FROM lineitem GROUP BY 1) SELECT p_partkey AS id, CASE WHEN n IS NULL OR n = 1 OR n = 7 THEN 'invalid' WHEN n IN (2, 3) THEN 'unclear' WHEN n = 4 THEN 'triggered' ELSE 'not_triggered' END AS verdict FROM part LEFT JOIN r ON r.id = p_partkey""")
def p36(spark, d):
    n = F.col("l_linenumber")
    verdict = F.when(n == 1, "perhaps").when(n == 2, "Unclear").when(n <= 4, "triggered").otherwise("NOT_TRIGGERED")
    evidence = F.when(n == 3, F.array().cast("array<string>")).when(n == 7, F.array(F.lit("q"))).otherwise(F.array(F.lit("e1")))
    replies = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"), verdict.alias("verdict"), evidence.alias("evidence"))
    return knowledge.validated_verdicts(table(spark, d, "part").select(F.col("p_partkey").alias("id")), replies, F.array(F.lit("e1"), F.lit("e2"))).select("id", "verdict")


@query("p34_p45_extractions", """SELECT o_orderkey AS item_id, CASE o_orderkey % 7 WHEN 0 THEN 'not_offered' WHEN 1 THEN 'bad_entity' WHEN 2 THEN 'bad_event' WHEN 3 THEN 'orphan' WHEN 4 THEN 'bad_type' ELSE '' END AS reason FROM orders""")
def p34(spark, d):
    k = F.col("o_orderkey") % 7
    entity = F.when(k == 1, '{"candidate_id":"E9"}').otherwise('{"name":"x","type":"topic"}')
    event = F.when(k == 2, '{"candidate_id":"V9"}').when(k == 3, '{"new_ref":"N1"}').when(k == 4, '{"summary":"s","type":"rumour"}').when(k == 5, '{"candidate_id":"V1"}').otherwise('{"summary":"s","type":"Action","new_label":"N1"}')
    json = F.concat(F.lit('[{"item_id":'), F.col("o_orderkey").cast("string"), F.lit(',"entities":['), entity, F.lit('],"events":['), event, F.lit("]}]"))
    o = table(spark, d, "orders")
    responses = o.select(F.col("o_orderkey").alias("request"), json.alias("json"))
    offered = o.filter(k != 0).select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("item_id"))
    got = knowledge.validated_extractions(responses, offered, F.array(F.lit("E1")), F.array(F.lit("V1")))
    return got.select("item_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("p44_f46_labels", """SELECT l_orderkey AS request, l_linenumber AS n, l_partkey AS part, CASE WHEN l_linenumber <= 3 THEN l_orderkey * 10 + l_linenumber END AS resolved, l_linenumber > 3 AND l_linenumber < 7 AS unknown, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3, 4, 5""")
def p44(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"))
    ids = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.col("request") * 10 + n)
    offered = o.select("request", F.explode(scalars.labels("E", ids)).alias("label", "id"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("E"), F.col("l_linenumber").cast("string"))).alias("label"))
    return knowledge.resolved_labels(rows, offered).groupBy("request", "n", "part", "resolved", "unknown").agg(F.count("*").alias("rows"))


@query("f03_x03_clean", "SELECT doc_id, length(trim(regexp_replace(left(text, 400) || ' & <é> end', '[\\s\\x0b]+', ' ', 'g'))) AS n, md5(trim(regexp_replace(left(text, 400) || ' & <é> end', '[\\s\\x0b]+', ' ', 'g'))) AS digest FROM documents WHERE text NOT LIKE '%&%'")
def f03(spark, d):
    rows = table(spark, d, "documents").filter(~F.col("text").contains("&"))
    text = scalars.clean(F.concat(F.left("text", F.lit(400)), F.lit(" \n&amp;  &lt;&eacute;&gt;\tend ")))
    return rows.select("doc_id", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query("f06_f09_claims", f"""WITH t AS (SELECT p_partkey, p_size AS n, list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda w: w NOT IN {CLAIM} AND NOT regexp_matches(w, '^[0-9]'))) AS w FROM part)
  SELECT p_partkey, p_partkey % 3 < 2 AND len(w) > 0 AS same, CASE WHEN p_partkey % 4 = 0 AND n <> 12 THEN n::VARCHAR ELSE '' END AS dropped FROM t""")
def f06(spark, d):
    size = F.col("p_size").cast("string")
    a = F.concat(F.lit("The "), "p_name", F.lit(" sold "), size, F.lit("."))
    b = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("the "), F.upper("p_name"), F.lit(" Sold, "), size)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("sold "), size, F.lit(" was "), "p_name")).otherwise(F.concat("p_name", F.lit(" sold 1,234.5")))
    c = F.when(F.col("p_partkey") % 4 == 0, F.lit("it sold 12")).otherwise(a)
    return table(spark, d, "part").select("p_partkey", scalars.is_duplicate_claim(a, b).alias("same"), F.array_join(scalars.dropped_numbers(a, c), ",").alias("dropped"))


@query("f24_f26_f27_f28_f29_f30_symbols", """SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 0.0026::DOUBLE ELSE 0.001 END AS haircut, CASE WHEN s_nationkey % 3 < 2 THEN 'S' || s_suppkey ELSE '' END AS base, CASE s_nationkey % 3 WHEN 0 THEN 'UK' WHEN 1 THEN 'US' ELSE '' END AS market,
  'BRK-' || s_suppkey AS ticker, 'BRK-' || s_suppkey || ',BRK' AS keys, CASE s_nationkey % 3 WHEN 0 THEN '.L' WHEN 1 THEN '' ELSE '-' END AS suffix FROM supplier""")
def f24(spark, d):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    market = F.when(n % 3 == 0, "UK").when(n % 3 == 1, "US").otherwise("ZZ")
    parsed = scalars.parse_symbol(F.concat(F.lit("S"), k, F.lit("."), market))
    ticker = scalars.normalize_ticker(F.concat(F.lit(" nyse:brk-"), k, F.when(n % 2 == 0, ".US").otherwise("")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "supplier").select(
        "s_suppkey", scalars.haircut_fraction(F.when(n % 2 == 0, "crypto").otherwise("equity")).alias("haircut"), empty(parsed["base"]).alias("base"), empty(parsed["market"]).alias("market"),
        ticker.alias("ticker"), F.array_join(scalars.base_keys(ticker), ",").alias("keys"), scalars.lookup(market, {"UK": ".L", "US": ""}, "-").alias("suffix"))


@query("f33_f34_f35_rates", """SELECT user_id, CASE WHEN e > 0 THEN round(n * 60.0::DOUBLE / e, 6) END AS turnover, CASE WHEN c > 0 THEN round(n / c, 6) END AS flicker, CASE WHEN e > 0 THEN CAST(trunc(greatest(10, least(1440, n * 60.0::DOUBLE / e / 4))) AS INT) END AS proposed
  FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1)""")
def f33(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "click").alias("c"))
    turnover = scalars.turnover_from_rate(F.col("n"), F.col("e"), F.lit(60.0))
    return rows.select("user_id", F.round(turnover, 6).alias("turnover"), F.round(scalars.flicker_ratio(F.col("n"), F.col("c")), 6).alias("flicker"), scalars.proposed_interval(turnover).alias("proposed"))


@query("f37_split_share", "SELECT event_type, round(avg(least(value / 6, 1.0::DOUBLE)), 6) AS share FROM events GROUP BY 1")
def f37(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(scalars.split_share(F.col("value")), 6).alias("share"))


@query("f39_f42_identities", "SELECT event_id, left(sha256(event_type || '|below|' || user_id), 16) AS row_hash, left(sha1(event_type || event_id), 10) AS short FROM events")
def f39(spark, d):
    return table(spark, d, "events").select("event_id", scalars.price_hash(F.col("event_type"), F.lit("below"), F.col("user_id")).alias("row_hash"), scalars.short_id(F.concat("event_type", F.col("event_id").cast("string"))).alias("short"))


@query("f44_checkpoints", """SELECT o_orderkey, h AS label, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) // 86400 + n AS day, o_totalprice + n AS price, round((o_totalprice + n) / o_totalprice - 1, 9) AS "return" FROM orders, (VALUES ('1w', 7), ('1m', 28)) t(h, n)""")
def f44(spark, d):
    o = table(spark, d, "orders").withColumn("opened", F.to_date("o_orderdate"))
    price_at = lambda day: F.col("o_totalprice") + F.datediff(day, "opened")
    maps = o.select("o_orderkey", scalars.checkpoint_map([("1w", 7), ("1m", 28)], F.col("opened"), F.col("o_totalprice"), price_at).alias("m"))
    return maps.select("o_orderkey", F.explode("m").alias("label", "v")).select("o_orderkey", "label", F.unix_date("v.date").cast("long").alias("day"), F.col("v.price").alias("price"), F.round("v.return", 9).alias("return"))


@query("f47_f48_markup", """SELECT s_suppkey, '<b>' || s_name || '</b> &amp; &lt;script x&gt;<a href="u">' || s_nationkey || '</a>' AS html, 'https://news.google.com/rss/search?q=site%3A' || s_suppkey || '.org%2Fx' AS url FROM supplier""")
def f47(spark, d):
    n = F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("<b>"), "s_name", F.lit('</b> & <script x><a href="u">'), n, F.lit("</a>"))
    return table(spark, d, "supplier").select("s_suppkey", scalars.sanitise(text).alias("html"), scalars.news_query_url(F.concat(F.col("s_suppkey").cast("string"), F.lit(".org/x"))).alias("url"))


@query("f50_f51_marks", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CASE WHEN r BETWEEN 50 AND 200 THEN l_extendedprice / 100 ELSE l_extendedprice END, 6) AS mark, greatest(l_discount - l_tax * 20, -1.0::DOUBLE) AS score, count(*) AS n FROM (SELECT *, l_extendedprice / (l_quantity * 20) AS r FROM lineitem) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6"))
def f50(spark, d):
    mark = scalars.repair_minor_unit(F.col("l_quantity") * 20, F.col("l_extendedprice"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(mark, 6).alias("mark"), scalars.retire_score(F.col("l_discount"), F.col("l_tax") * 20).alias("score"))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "mark", "score").agg(F.count("*").alias("n"))


@query("f52_f53_f54_calendar", """WITH s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)
  SELECT o_custkey, date_diff('day', a, b) + 1 AS days, (SELECT count(*) FROM range(1992, 2030) y(y), range(1, 5) q(q) WHERE y < year(b) OR (y = year(b) AND q <= quarter(b))) AS quarters, CASE WHEN date_diff('day', greatest(b - 17, a + 14), b - 3) >= 10 THEN date_diff('day', DATE '1970-01-01', greatest(b - 17, a + 14)) END AS block FROM s""")
def f52(spark, d):
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    days = spans.select("o_custkey", scalars.day_range(F.col("a"), F.col("b")).alias("day")).groupBy("o_custkey").agg(F.count("*").alias("days"))
    names = F.array(*[F.lit(q) for q in scalars.quarters(1992, 2029, 4)])
    last = F.concat(F.year("b").cast("string"), F.lit("Q"), F.quarter("b").cast("string"))
    block = scalars.census_block(F.col("b"), F.col("a"))
    return spans.join(days, "o_custkey").select("o_custkey", "days", F.array_position(names, last).alias("quarters"), F.unix_date(block["start"]).cast("long").alias("block"))
