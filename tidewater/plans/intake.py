"""Queries of sources and sinks: entries, embedded data, event lines, charts, routes, watch rows, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.operators import aggregates, knowledge, state, topk
from tidewater.plans.catalog import query, table
from tidewater.sources import readers
from tidewater.sources.tableset import fresh_root

ENTRY_SQL = """WITH e AS (SELECT doc_id, source AS feed, CASE WHEN doc_id % 3 <> 0 THEN 'g' || doc_id END AS guid, CASE WHEN doc_id % 2 = 0 THEN ' Title ' || doc_id || ' ' END AS title,
    left(text, 300) AS body, 'http://x/a?utm_a=1&id=' || doc_id || '#top' AS link, 1 + doc_id % 28 AS day, lang <> 'fr' AS ok FROM documents),
  s AS (SELECT *, trim(regexp_replace(body || ' end', '[\\s\\x0b]+', ' ', 'g')) AS summary FROM e WHERE ok)"""


def _entries(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id").cast("string")
    day = (1 + F.col("doc_id") % 28).cast("string")
    iso = F.concat(F.lit("2024-01-"), F.lpad(day, 2, "0"), F.lit("T06:00:00Z"))
    return docs.select(
        F.col("source").alias("feed"), F.col("doc_id").cast("int").alias("position"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("g"), i)).alias("guid"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Title "), i, F.lit(" "))).alias("title"),
        F.concat(F.lit("<p class='x'>"), F.left("text", F.lit(300)), F.lit("</p><br/>end")).alias("summary"), F.concat(F.lit("http://x/a?utm_a=1&id="), i, F.lit("#top")).alias("link"),
        F.when(F.col("doc_id") % 5 == 0, iso).otherwise(F.concat(F.lit("Mon, "), day, F.lit(" Jan 2024 07:00:00 +0100"))).alias("published"), F.when(F.col("lang") == "fr", "timeout").alias("failure"),
    )


@query("s02_s03_entries", ENTRY_SQL + """ SELECT doc_id AS position, coalesce(nullif(trim(title), ''), CASE WHEN length(summary) > 160 THEN regexp_replace(left(summary, 160), '[\\s\\x0b]\\S*$', '') ELSE summary END) AS title, length(summary) AS n,
  1704067200 + (day - 1) * 86400 + 21600 AS published, sha256(coalesce(guid, 'http://x/a?id=' || doc_id)) AS hash FROM s""")
def s02(spark, d):
    got = readers.normalised_entries(_entries(spark, d))
    return got.select(F.col("position").cast("long").alias("position"), "title", F.length("summary").cast("long").alias("n"), F.unix_timestamp("published_at").alias("published"), "hash")


@query("s01_s05_feed_rows", "SELECT source AS feed, count(*) AS entries, count(*) FILTER (WHERE lang = 'fr') AS failures, count(DISTINCT lang) AS kinds FROM documents GROUP BY 1")
def s01(spark, d):
    """What a scan of several feeds gives: entries and, as rows of their own, failures."""
    rows = _entries(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("position"), "lang"), "position")
    return rows.groupBy("feed").agg(F.count("*").alias("entries"), F.count("failure").alias("failures"), F.countDistinct("lang").alias("kinds"))


@query("s07_embedded_articles", """SELECT doc_id, k AS position, 't' || doc_id || '-' || k AS title, 'u' || k AS url FROM documents, (VALUES (1), (2), (3)) t(k) WHERE k <= doc_id % 4""")
def s07(spark, d):
    i = F.col("doc_id").cast("string")
    item = lambda k: F.concat(F.lit('{"title":"t'), i, F.lit(f'-{k}","url":"u{k}","published":null}}'))
    items = F.slice(F.array(item(1), item(2), item(3)), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    html = F.concat(F.lit("<p>x</p><script>window.__DATA__ = {\"articles\":["), F.array_join(items, ","), F.lit("]};</script>"))
    pages = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, html).otherwise("<p>none</p>").alias("html"))
    got = readers.embedded_articles(pages, "doc_id", F.col("html"))
    return got.select("doc_id", F.substring_index("title", "-", -1).cast("int").alias("position"), "title", "url")


@query("s08_s09_sources", """SELECT id, CASE WHEN capture IS NOT NULL THEN capture ELSE url END AS url FROM (SELECT s_name AS id, 'http://' || s_suppkey AS url, CASE WHEN s_acctbal < 0 THEN 'file:' || s_suppkey END AS capture FROM supplier
  UNION ALL SELECT c_name, 'http://c' || c_custkey, NULL FROM customer WHERE c_mktsegment = 'BUILDING')""")
def s08(spark, d):
    k, c = F.col("s_suppkey").cast("string"), F.col("c_custkey").cast("string")
    builtin = table(spark, d, "supplier").select(F.col("s_name").alias("id"), F.concat(F.lit("http://"), k).alias("url"), F.when(F.col("s_acctbal") < 0, F.concat(F.lit("file:"), k)).alias("capture_url"))
    own = table(spark, d, "customer").select(F.col("c_name").alias("id"), F.concat(F.lit("http://c"), c).alias("url"), F.when(F.col("c_mktsegment") == "BUILDING", "feed").otherwise("page").alias("source_type"))
    return readers.all_sources(builtin, own).select("id", "url")


@query("s12_topic_context", """SELECT lang AS topic, doc_id AS passage_id, length(left(text, 500)) AS n FROM documents WHERE lang <> 'fr' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= CASE WHEN lang = 'en' THEN 3 ELSE 2 END""")
def s12(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("doc_id").alias("passage_id"), F.col("n_chars").alias("score"), "text")
    topics = rows.select("topic").distinct()
    got = knowledge.topic_context(rows, topics.filter("topic = 'fr'"), topics.filter("topic = 'en'"))
    return got.select("topic", "passage_id", F.length("text").cast("long").alias("n"))


LINES_SQL = """WITH l AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber + 14 AS VARCHAR) AS root, CAST(l_linenumber % 5 AS VARCHAR) AS quad, l_discount AS g, CAST(l_quantity AS INT) AS m, l_tax AS t, l_returnflag AS geo FROM lineitem
    WHERE l_linenumber <> 6 AND l_linestatus = 'O' AND l_quantity <> 7)"""


@query("s13_s14_event_lines", LINES_SQL + " SELECT geo, root, quad, count(*) AS n, CAST(sum(m) AS BIGINT) AS mentions, round(sum(g * m), 4) AS goldstein, round(sum(t), 4) AS tone, CAST(epoch(min(date)) AS BIGINT) // 86400 AS first FROM l GROUP BY 1, 2, 3")
def s13(spark, d):
    got = _event_rows(spark, d).groupBy("geo", "root", "quad").agg(
        F.count("*").alias("n"), F.sum("mentions").alias("mentions"), F.round(F.sum(F.col("goldstein") * F.col("mentions")), 4).alias("goldstein"), F.round(F.sum("tone"), 4).alias("tone"), F.unix_date(F.min("date")).cast("long").alias("first"))
    return got


def _event_rows(spark, d):
    """Event lines made of the orders' lines: a bad date, too few fields or a bad number each drop some."""
    at = {1: F.when(F.col("l_linenumber") == 6, "soon").otherwise(F.date_format("l_shipdate", "yyyyMMdd")), 28: (F.col("l_linenumber") + 14).cast("string"), 29: (F.col("l_linenumber") % 5).cast("string"), 30: F.col("l_discount").cast("string"),
          31: F.when(F.col("l_quantity") == 7, "many").otherwise(F.col("l_quantity").cast("int").cast("string")), 34: F.col("l_tax").cast("string"), 51: F.col("l_returnflag")}
    fields = F.array(*[at.get(k, F.lit("")) for k in range(58)])
    line = F.array_join(F.when(F.col("l_linestatus") == "O", fields).otherwise(F.slice(fields, 1, 40)), "\t")
    return readers.typed_event_rows(table(spark, d, "lineitem").select(line.alias("value")))


@query("p04_p05_a20_a22_a23_a51_event_days", LINES_SQL + """, r AS (SELECT *, quad IN ('3', '4') OR root IN ('18', '19', '20') AS c FROM l WHERE geo IN ('A', 'R'))
  SELECT CAST(epoch(date) AS BIGINT) // 86400 AS day, count(*) AS n, count(*) FILTER (WHERE c) AS n_conflict, CAST(sum(m) AS BIGINT) AS weight, round(sum(t * m) / sum(m), 11) AS tone, round(sum(g * m) / sum(m), 11) AS goldstein FROM r GROUP BY 1""")
def p04(spark, d):
    got = aggregates.daily_signals(_event_rows(spark, d), "date", predicates.in_region(F.col("geo"), ["A", "R"]), predicates.is_conflict(F.col("quad"), F.col("root")), "tone", "goldstein", "mentions")
    return got.select(F.unix_date("date").cast("long").alias("day"), "n", "n_conflict", "weight", F.round("tone", 11).alias("tone"), F.round("goldstein", 11).alias("goldstein"))


@query("s20_s21_chart_closes", """WITH e AS (SELECT user_id AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN event_type = 'view' THEN value / 2 WHEN event_type <> 'error' THEN value END AS v, event_id FROM events),
  r AS (SELECT *, sec // 86400 AS day FROM e WHERE v IS NOT NULL) SELECT symbol, day, CASE WHEN symbol % 2 = 0 THEN v / 100 ELSE v END AS close FROM r QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY sec DESC, v DESC) = 1""")
def s20(spark, d):
    e = table(spark, d, "events")
    close, adjusted = F.when(F.col("event_type") != "error", F.col("value")), F.when(F.col("event_type") == "view", F.col("value") / 2)
    bar = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.coalesce(adjusted, close).alias("v"), close.alias("close"), adjusted.alias("adjclose"))
    bars = e.groupBy(F.col("user_id").alias("symbol")).agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    charts = bars.select("symbol", F.lit("UTC").alias("zone"), *[F.col(f"bars.{c}").alias(c) for c in ("ts", "close", "adjclose")])
    got = readers.chart_closes(charts, F.col("symbol") % 2 == 0)
    return got.select("symbol", F.unix_date("date").cast("long").alias("day"), "close")


@query("s23_s24_s25_watched_closes", """SELECT c_custkey AS symbol, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 0.5 END)
  WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 0.5 END END::DOUBLE AS close FROM customer""")
def s23(spark, d):
    c = table(spark, d, "customer")
    market = scalars.lookup(F.col("c_mktsegment"), {"BUILDING": "US", "MACHINERY": "UK", "HOUSEHOLD": "DE"}, "other")
    a, b = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").alias("close")), c.filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("symbol"), (F.col("c_nationkey") + F.lit(0.5).cast("double")).alias("close"))
    return readers.watched_closes(a, b, c.select(F.col("c_custkey").alias("symbol"), market.alias("market"))).select("symbol", "close")


@query("s31_price_rows", "SELECT o_custkey AS key, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) // 86400 AS day, max(o_totalprice) AS close FROM orders GROUP BY 1, 2")
def s31(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.max("o_totalprice").alias("close"))
    maps = best.groupBy(F.col("o_custkey").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("day", "close"))).alias("prices"))
    return readers.price_map_rows(maps, "key", "prices").select("key", F.unix_date("date").cast("long").alias("day"), "close")


@query("s32_s33_watch_rows", """SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'event' ELSE 'price' END AS kind, CASE WHEN s_suppkey % 10 = 9 THEN 'version' WHEN s_nationkey = 5 THEN 'id' WHEN s_nationkey % 3 = 0 AND s_acctbal < 0 THEN 'trigger'
  WHEN s_nationkey % 3 = 2 AND s_nationkey % 2 = 0 THEN 'condition' WHEN s_nationkey % 3 = 1 AND s_acctbal < 0 THEN 'level' ELSE '' END AS error, count(*) AS n FROM supplier GROUP BY 1, 2""")
def s32(spark, d):
    s = table(spark, d, "supplier")
    condition = F.when(F.col("s_nationkey") % 3 == 0, None).when(F.col("s_nationkey") % 3 == 1, "below").when(F.col("s_nationkey") % 2 == 0, "beside").otherwise("above_ma200")
    good = F.col("s_acctbal") >= 0
    row = F.struct(F.when(F.col("s_nationkey") != 5, F.col("s_name")).alias("id"), F.when(good, F.lit("x")).alias("trigger"), F.lit("S").alias("symbol"), condition.alias("condition"), F.when(good, F.col("s_acctbal")).alias("level"))
    files = s.groupBy((F.col("s_suppkey") % 10).alias("file")).agg(F.collect_list(row).alias("rows"))
    text = files.select(F.to_json(F.struct(F.when(F.col("file") == 9, 2).otherwise(1).alias("version"), "rows")).alias("value"))
    return readers.watch_rows(text).groupBy("kind", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


@query("s35_signal_snapshots", "SELECT CAST(ts AS DATE)::VARCHAR AS date, count(*) AS n, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-10' THEN 'old' ELSE 'new' END AS run FROM events GROUP BY 1, 3")
def s35(spark, d):
    """A second run replaces the snapshots of its own days and leaves the others."""
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_id", "value")
    where = fresh_root(spark, "signals")
    readers.write_signals(rows.filter("date < '2024-01-20'").withColumn("run", F.lit("old")), where)
    readers.write_signals(rows.filter("date >= '2024-01-10'").withColumn("run", F.lit("new")), where)
    back = spark.read.schema("date string, event_id long, value double, run string").json(where)
    return back.groupBy("date", "run").agg(F.count("*").alias("n"))


@query("s43_dimension_rows", "SELECT p_name AS name, min(p_partkey) AS first, min(p_partkey) FILTER (WHERE p_size > 2) AS made FROM part GROUP BY 1 HAVING min(p_partkey) FILTER (WHERE p_size <= 2) IS NULL")
def s43(spark, d):
    part = table(spark, d, "part")
    old, new = part.filter("p_size <= 2").select(F.col("p_name").alias("name")), part.filter("p_size > 2").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("made"))
    return state.insert_if_absent(old, new, ["name"], ["made"]).select("name", F.col("made").alias("first"), "made")


@query("s44_s58_latest_rows", """SELECT l_suppkey AS id, max(l_shipdate)::DATE::VARCHAR AS at, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS status FROM lineitem GROUP BY 1""")
def s44(spark, d):
    """Runs opened and closed, sources written again: the row with the newest version stands."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("version"), F.col("l_returnflag").alias("status"))
    got = state.upsert_latest(rows.filter("status = 'A'"), rows.filter("status <> 'A'"), ["id"], "version")
    return got.select("id", F.date_format("version.l_shipdate", "yyyy-MM-dd").alias("at"), "status")


@query("s55_state_map", "SELECT count(DISTINCT s_name) AS keys, CAST(sum(hash) AS BIGINT) AS total FROM (SELECT s_name, s_suppkey + length(s_name) AS hash FROM supplier)")
def s55(spark, d):
    got = state.key_values(table(spark, d, "supplier"), "s_name", "s_suppkey")
    pairs = got.select(F.explode("state").alias("k", "v"))
    return pairs.agg(F.countDistinct("k").alias("keys"), F.sum(F.col("v") + F.length("k")).cast("long").alias("total"))


@query("s57_s60_s62_pruned", """SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_totalprice > 200000) AS removed, count(*) FILTER (WHERE o_totalprice <= 200000) AS kept, count(*) FILTER (WHERE o_orderdate >= DATE '1997-01-01') AS young FROM orders GROUP BY 1""")
def s57(spark, d):
    o = table(spark, d, "orders")
    kept, removed = state.split_deleted(o, F.col("o_totalprice") > 200000)
    young = state.pruned_by_age(o, "o_orderdate", F.lit("1997-01-31").cast("date"), 30)
    sums = lambda rows, name: rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias(name))
    out = o.select(F.col("o_orderstatus").alias("status")).distinct()
    for rows, name in ((removed, "removed"), (kept, "kept"), (young, "young")):
        out = out.join(sums(rows, name), "status", "left")
    return out.fillna(0)


@query("u11_s08_watched_union", "SELECT k, min(s) AS source_no FROM (SELECT l_partkey AS k, 0 AS s FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size > 40 UNION ALL SELECT l_partkey, 2 FROM lineitem) GROUP BY 1")
def u11(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    parts = [li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct(), part.filter("p_size > 40").select(F.col("p_partkey").alias("k")), li.select(F.col("l_partkey").alias("k")).distinct()]
    return topk.ordered_union(parts, "k").select("k", "source_no")


@query("s29_s30_points", "SELECT 'u' || user_id AS ticker, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) // 86400 AS day, count(*) AS n, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def s29(spark, d):
    day = F.when(F.col("event_type") == "error", "some day").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    series = table(spark, d, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ticker")).agg(F.collect_list(F.struct(day.alias("date"), "value")).alias("points"))
    text = series.select(F.to_json(F.struct("ticker", "points")).alias("value"))
    got = readers.point_rows(text.select(F.from_json("value", readers.POINTS).alias("s")).select("s.*"))
    return got.groupBy("ticker", F.unix_date("date").cast("long").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("value"))


@query("s26_s28_bundles", "SELECT c_name AS ticker, CASE WHEN c_nationkey < 10 THEN c_acctbal END AS sentiment, c_nationkey < 10 AND c_acctbal < 0 AS failed FROM customer")
def s26(spark, d):
    c = table(spark, d, "customer")
    bundle = F.struct(F.col("c_name").alias("ticker"), F.struct(F.col("c_acctbal").alias("daily_sentiment")).alias("sentiment"), F.when(F.col("c_acctbal") < 0, "late").alias("error"))
    text = c.filter("c_nationkey < 10").select(F.to_json(bundle).alias("value"))
    got = readers.bundles_for(c.select(F.col("c_name").alias("ticker")), text.select(F.from_json("value", readers.BUNDLE).alias("b")).select("b.*"))
    return got.select("ticker", F.col("sentiment.daily_sentiment").alias("sentiment"), F.col("error").isNotNull().alias("failed"))


@query("s34_gold_items", "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS label FROM labels")
def s34(spark, d):
    rows = table(spark, d, "labels").groupBy((F.col("doc_id") % 10).alias("file")).agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "true").otherwise("false").alias("label"))).alias("items"))
    text = rows.select(F.to_json(F.struct("items")).alias("value"))
    return readers.gold_items(text.select(F.from_json("value", "items array<struct<id: bigint, label: string>>").alias("f")).select("f.*"))


@query("s36_s38_positions", """SELECT 'read' AS part, s_name AS instrument, s_acctbal AS entry FROM supplier UNION ALL SELECT 'default', n_name, NULL FROM nation""")
def s36(spark, d):
    """A book that can be read stands; one that is broken gives the default."""
    one = F.struct(F.col("s_name").alias("instrument"), F.col("s_acctbal").alias("entry"))
    books = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 5).alias("book")).agg(F.to_json(F.collect_list(one)).alias("value"))
    default = table(spark, d, "nation").select(F.col("n_name").alias("instrument"), F.lit(None).cast("double").alias("entry"))
    schema = "array<struct<instrument: string, entry: double>>"
    good = readers.rows_or_default(books.select("value"), schema, default)
    bad = readers.rows_or_default(books.select(F.substring("value", 1, 7).alias("value")), schema, default)
    return good.withColumn("part", F.lit("read")).unionByName(bad.withColumn("part", F.lit("default")))
