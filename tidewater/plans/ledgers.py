"""Queries of writes with rules, the census, the day cache, batch rankings and injected rankers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import census, knowledge, ledgers
from tidewater.plans.catalog import query, table
from tidewater.plans.knowledge import POOL
from tidewater.sources import daily
from tidewater.sources.tableset import TableSet, fresh_root

CENSUS_SQL = """WITH i AS (SELECT event_id AS item, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start, event_type = 'error' AS empty,
    CASE WHEN event_type <> 'view' THEN value END AS late FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-28'),
  s AS (SELECT unnest(range(1705190400, 1706400000, 21600)) AS start),
  c AS (SELECT s.start, count(i.item) FILTER (WHERE NOT empty AND coalesce(floor(late) <= 24, true)) AS eligible, count(i.item) FILTER (WHERE NOT empty AND floor(late) > 24) AS backlog,
    count(i.item) FILTER (WHERE NOT empty AND late IS NULL) AS nulls, min(item) FILTER (WHERE NOT empty AND coalesce(floor(late) <= 24, true)) AS lo, max(item) FILTER (WHERE NOT empty AND coalesce(floor(late) <= 24, true)) AS hi FROM s LEFT JOIN i ON i.start = s.start GROUP BY 1),
  d AS (SELECT *, CAST((start // 21600) % 4 AS INT) AS stratum FROM c WHERE eligible >= 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || start), start) AS round FROM d),
  o AS (SELECT *, row_number() OVER (ORDER BY round, md5('7s|' || round || '|' || stratum), stratum) AS order_no FROM r WHERE round <= 4),
  w AS (SELECT order_no AS "window", order_no, 1 AS pass, NULL AS repeat_of, * EXCLUDE (order_no) FROM o UNION ALL SELECT (SELECT max(order_no) FROM o) + 1, order_no, 2, order_no, * EXCLUDE (order_no) FROM o WHERE order_no = 3)"""


def _census_items(spark, d):
    e = table(spark, d, "events")
    published = F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp") - F.make_dt_interval(hours=F.floor("value").cast("int")))
    return e.select(F.col("event_id").alias("item"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("title"), F.lit(False).alias("quote"), published.alias("published"), F.col("ts").cast("timestamp").alias("created"))


@query("s65_census", CENSUS_SQL + """ SELECT "window", CAST(order_no AS INT) AS order_no, CAST(pass AS INT) AS pass, repeat_of, start, stratum, backlog AS backlog_excluded, nulls AS null_published, eligible AS members, lo AS first_item, hi AS last_item,
  (SELECT count(*) FROM c WHERE eligible < 3) AS skipped, 1 AS version FROM w""")
def s65(spark, d):
    """What a reader sees of a frozen census; a second call changes nothing, a commit that lost a race neither."""
    tables = TableSet(spark, fresh_root(spark, "census"))
    items = _census_items(spark, d)
    span = dt.date(2024, 1, 14), dt.date(2024, 1, 28)
    census.prepare(tables, items, *span, least=3)
    census.prepare(tables, items, *span, least=3)
    seen = census.frozen_windows(tables)
    skipped = tables.read("skipped").agg(F.count("*").alias("skipped"))
    rows = seen.crossJoin(skipped).withColumn("version", F.lit(tables.version()))  # one row
    return rows.select("window", "order_no", "pass", "repeat_of", "start", "stratum", "backlog_excluded", "null_published", "members", "first_item", "last_item", "skipped", "version")


ENTITY_SQL = """WITH t AS (SELECT p_partkey AS spec, CASE WHEN p_size > 45 THEN p_partkey END AS candidate, CASE WHEN p_size = 44 THEN ' ' WHEN p_partkey % 2 = 1 THEN upper(p_name) ELSE p_name END AS name,
    CASE WHEN p_type = 'ECONOMY' THEN 'company' WHEN p_type = 'PROMO' THEN 'instrument' ELSE 'topic' END AS type, p_size FROM part),
  e AS (SELECT min(spec) AS entity, lower(name) AS key, type FROM t WHERE p_size <= 3 GROUP BY 2, 3),
  r AS (SELECT spec, CASE WHEN trim(name) = '' THEN 'no_name' WHEN type = 'instrument' AND lower(name) IN (SELECT key FROM e WHERE type = 'company') THEN 'company_symbol' END AS reason FROM t WHERE candidate IS NULL),
  a AS (SELECT t.spec, lower(name) AS key, type, name FROM t JOIN r ON r.spec = t.spec AND reason IS NULL),
  f AS (SELECT key, type, min(spec) AS first FROM a WHERE (key, type) NOT IN (SELECT (key, type) FROM e) GROUP BY 1, 2),
  m AS (SELECT key, type, first, (SELECT coalesce(max(entity), 0) FROM e) + row_number() OVER (ORDER BY first) AS made FROM f)"""


@query("s47_resolved_entities", ENTITY_SQL + """ SELECT spec, candidate AS entity, 'candidate' AS outcome, '' AS name FROM t WHERE candidate IS NOT NULL
  UNION ALL SELECT a.spec, coalesce(e.entity, m.made), CASE WHEN m.first = a.spec THEN 'created' ELSE 'known' END, CASE WHEN m.first = a.spec THEN a.name ELSE '' END FROM a LEFT JOIN e ON e.key = a.key AND e.type = a.type LEFT JOIN m ON m.key = a.key AND m.type = a.type
  UNION ALL SELECT spec, NULL, reason, '' FROM r WHERE reason IS NOT NULL""")
def s47(spark, d):
    part = table(spark, d, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "company").when(F.col("p_type") == "PROMO", "instrument").otherwise("topic")
    name = F.when(F.col("p_size") == 44, " ").when(F.col("p_partkey") % 2 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    specs = part.select(F.col("p_partkey").alias("spec"), F.when(F.col("p_size") > 45, F.col("p_partkey")).alias("candidate"), name.alias("name"), kind.alias("type"), F.array().cast("array<string>").alias("aliases"))
    known = part.filter("p_size <= 3").select(F.col("p_partkey").alias("entity"), name.alias("name"), kind.alias("type"))
    symbols = known.filter("type = 'company'").select("entity", F.col("name").alias("symbol"))
    got = ledgers.resolve_entities(specs, known, symbols)
    rows = got.resolved.join(got.created.select("entity", F.col("name").alias("_n")), "entity", "left").select("spec", "entity", "outcome", F.when(F.col("outcome") == "created", F.col("_n")).otherwise("").alias("name"))
    return rows.unionByName(got.refused.select("spec", F.lit(None).cast("long").alias("entity"), F.col("reason").alias("outcome"), F.lit("").alias("name")))


LOG_SQL = """WITH l AS (SELECT l_suppkey AS w, l_returnflag AS tab, l_orderkey AS seq, l_shipdate AS tm, l_partkey AS item, CASE WHEN l_linenumber > 1 THEN l_suppkey * 10 + l_linenumber END AS g, l_linestatus = 'O' AS unsure, l_tax, l_discount FROM lineitem),
  s AS (SELECT s_suppkey AS w, s_nationkey % 3 < 2 AND s_acctbal >= 0 AS ok FROM supplier),
  m AS (SELECT DISTINCT w, item FROM l WHERE l_tax <= 0.06), x AS (SELECT DISTINCT w, g FROM l WHERE g % 10 < 6),
  r AS (SELECT l.*, coalesce(ok, false) AS ok, (l.w, l.item) IN (SELECT (w, item) FROM m) AS member, l.g IS NULL OR (l.w, l.g) IN (SELECT (w, g) FROM x) AS own, count(*) OVER (PARTITION BY l.w, tab, seq, tm, item) AS n FROM l LEFT JOIN s ON s.w = l.w),
  a AS (SELECT w, tab, seq, tm, CASE WHEN NOT bool_and(ok) THEN 'closed' WHEN max(n) > 1 THEN 'repeated_item' WHEN NOT bool_and(member) THEN 'foreign_item' WHEN NOT bool_and(own) THEN 'foreign_group' END AS reason FROM r GROUP BY 1, 2, 3, 4),
  f AS (SELECT l.w, l.tab, l.seq, l.item, min(l.tm) AS tm FROM l JOIN a ON a.w = l.w AND a.tab = l.tab AND a.seq = l.seq AND a.tm = l.tm AND a.reason IS NULL WHERE (l.w, l.tab, l.seq, l.item) NOT IN (SELECT (w, tab, seq, item) FROM l WHERE l_discount = 0) GROUP BY 1, 2, 3, 4)"""


@query("s66_assignment_log", LOG_SQL + """ SELECT w AS "window", 'appended' AS outcome, count(*) AS n, CAST(epoch(min(tm)) AS BIGINT) AS "at" FROM f GROUP BY 1
  UNION ALL SELECT w, reason, count(*), CAST(epoch(min(tm)) AS BIGINT) FROM a WHERE reason IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT w, 'opened', 1, CAST(epoch(min(tm)) AS BIGINT) FROM a WHERE reason IS NULL GROUP BY 1""")
def s66(spark, d):
    li = table(spark, d, "lineitem")
    group = F.when(F.col("l_linenumber") > 1, F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    rows = li.select(F.col("l_suppkey").alias("window"), F.col("l_returnflag").alias("tab"), F.col("l_orderkey").alias("seq"), F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("item"), group.alias("group"), (F.col("l_linestatus") == "O").alias("unsure"), "l_tax", "l_discount")
    opened = table(spark, d, "supplier").select(F.col("s_suppkey").alias("window"), F.when(F.col("s_nationkey") % 3 == 2, "complete").otherwise("prepared").alias("status"), (F.col("s_acctbal") < 0).alias("blind_done"), F.lit(None).cast("timestamp_ntz").alias("opened_at"))
    got = ledgers.append_assignments(rows.filter("l_discount = 0"), rows.drop("l_tax", "l_discount"), opened, rows.filter("l_tax <= 0.06").select("window", "item"), rows.filter("group % 10 < 6").select("window", "group"))
    at = F.unix_seconds(F.col("at").cast("timestamp"))
    appended = got.rows.groupBy("window").agg(F.lit("appended").alias("outcome"), F.count("*").alias("n"), F.min(at).alias("at"))
    refused = got.refused.groupBy("window", F.col("reason").alias("outcome")).agg(F.count("*").alias("n"), F.min(at).alias("at"))
    moved = got.windows.select("window", F.lit("opened").alias("outcome"), F.lit(1).cast("long").alias("n"), F.unix_seconds(F.col("opened_at").cast("timestamp")).alias("at"))
    return appended.unionByName(refused).unionByName(moved)


IMPORT_SQL = """WITH r AS (SELECT CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey = 3 THEN 3 ELSE c_custkey + 100 END AS id, c_mktsegment AS status, c_acctbal AS balance, c_custkey AS pos FROM customer),
  j AS (SELECT *, CASE WHEN id IS NULL THEN 'no_key' WHEN balance < -500 THEN 'balance' WHEN status = 'MACHINERY' THEN 'status' END AS reason FROM r),
  g AS (SELECT id, count(*) AS n, min(pos) AS first FROM j WHERE reason IS NULL GROUP BY 1)"""


@query("s53_import_once", IMPORT_SQL + """ SELECT 'landed' AS part, '' AS reason, count(*) AS n, CAST(sum(first) AS BIGINT) AS total FROM g
  UNION ALL SELECT 'rejected', reason, count(*), NULL FROM j WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'rejected', 'repeated', CAST(sum(n - 1) AS BIGINT), NULL FROM g
  UNION ALL SELECT 'record', 'customers', (SELECT count(*) FROM r) - (SELECT count(*) FROM g), (SELECT count(*) FROM r) UNION ALL SELECT 'again', '', 0, 0""")
def s53(spark, d):
    c = table(spark, d, "customer")
    key = F.when(F.col("c_nationkey") == 7, None).when(F.col("c_nationkey") == 3, 3).otherwise(F.col("c_custkey") + 100)
    rows = c.select(F.col("c_custkey").alias("pos"), key.cast("long").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("balance"), F.lit(None).cast("string").alias("broke_on"))
    none = spark.createDataFrame([], "load string, expected long, landed long, rejected long")
    checks = {"balance": F.col("balance") >= -500, "status": F.col("status") != "MACHINERY", "broke_on": F.col("broke_on").isNotNull()}
    load = lambda done: ledgers.import_once(rows.limit(0), rows, done, "customers", "id", checks, {"broke_on": F.coalesce("broke_on", F.lit("unknown"))})
    got = load(none)
    again = load(got.record).landed
    sums = lambda df, part: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("total")).select(F.lit(part).alias("part"), F.lit("").alias("reason"), "n", "total")
    rejected = got.rejected.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("rejected").alias("part"), "reason", "n", F.lit(None).cast("long").alias("total"))
    record = got.record.select(F.lit("record").alias("part"), F.col("load").alias("reason"), F.col("rejected").alias("n"), F.col("expected").alias("total"))
    return sums(got.landed, "landed").unionByName(rejected).unionByName(record).unionByName(sums(again, "again"))


PAIR_SQL = """WITH e AS (SELECT user_id AS w, event_id, ts, event_type, value, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
  o AS (SELECT w, p AS a, event_id AS b FROM e WHERE p IS NOT NULL AND value < 40), z AS (SELECT w, p AS a, event_id AS b FROM e WHERE p IS NOT NULL AND value < 2),
  x AS (SELECT w, p AS a, event_id AS b, CASE event_type WHEN 'click' THEN 'same' WHEN 'view' THEN 'different' WHEN 'purchase' THEN 'unsure' ELSE event_type END AS k, ts FROM e WHERE p IS NOT NULL),
  y AS (SELECT x.w, x.a, x.b, k, x.ts, value FROM x JOIN e ON e.event_id = x.b UNION ALL SELECT x.w, x.a, x.b, 'unsure', x.ts + INTERVAL 1 DAY, value FROM x JOIN e ON e.event_id = x.b WHERE value > 30),
  j AS (SELECT *, CASE WHEN k NOT IN ('same', 'different', 'unsure') THEN 'unknown_decision' WHEN value >= 40 THEN 'not_offered' WHEN value < 2 THEN 'answered' END AS reason FROM y),
  f AS (SELECT w, a, b, arg_min(k, (ts, k)) AS k, min(ts) AS ts, count(*) AS n FROM j WHERE reason IS NULL GROUP BY 1, 2, 3),
  t AS (SELECT w FROM o WHERE (w, a, b) NOT IN (SELECT (w, a, b) FROM f) AND (w, a, b) NOT IN (SELECT (w, a, b) FROM z))"""


@query("s67_adjudications", PAIR_SQL + """ SELECT w AS "window", k AS outcome, count(*) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT w, reason, sum(n)::BIGINT FROM (SELECT w, reason, 1 AS n FROM j WHERE reason IS NOT NULL UNION ALL SELECT w, 'answered', n - 1 FROM f WHERE n > 1) GROUP BY 1, 2
  UNION ALL SELECT DISTINCT w, 'complete', 1 FROM f WHERE w NOT IN (SELECT w FROM t)""")
def s67(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("p", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).filter("p IS NOT NULL")
    pairs = e.select(F.col("user_id").alias("window"), F.col("p").alias("a"), F.col("event_id").alias("b"), "value")
    word = F.when(F.col("event_type") == "click", "same").when(F.col("event_type") == "view", "different").when(F.col("event_type") == "purchase", "unsure").otherwise(F.col("event_type"))
    told = e.select(F.col("user_id").alias("window"), F.col("event_id").alias("item_a"), F.col("p").alias("item_b"), word.alias("decision"), F.col("ts").alias("at"), "value")
    late = told.filter("value > 30").withColumn("decision", F.lit("unsure")).withColumn("at", F.col("at") + F.expr("INTERVAL 1 DAY"))
    states = e.select(F.col("user_id").alias("window"), F.lit("open").alias("status"), F.lit(None).cast(e.schema["ts"].dataType).alias("completed_at")).distinct()
    got = ledgers.adjudicate(pairs.filter("value < 2"), told.unionByName(late), pairs.filter("value < 40"), states)
    rows = got.rows.groupBy("window", F.col("decision").alias("outcome")).agg(F.count("*").alias("n"))
    refused = got.refused.groupBy("window", F.col("reason").alias("outcome")).agg(F.sum("n").alias("n"))
    return rows.unionByName(refused).unionByName(got.windows.select("window", F.lit("complete").alias("outcome"), F.lit(1).cast("long").alias("n")))


@query("s15_cached_days", "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS asked FROM events GROUP BY 1, 5")
def s15(spark, d):
    """The first call fetches half a month, the second only the days that are missing."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    cache, asked = f"{fresh_root(spark, 'days')}", []

    def load(days):
        asked.append(days)
        return e.filter(F.col("day").isin(days)).withColumn("asked", F.lit(len(asked)))

    daily.cached_scan(spark, cache, daily.days_between(dt.date(2024, 1, 1), dt.date(2024, 1, 14)), load)
    rows = daily.cached_scan(spark, cache, daily.days_between(dt.date(2023, 12, 25), dt.date(2024, 3, 31)), load)
    return rows.groupBy("day", "asked").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


BATCH_SQL = POOL.replace("FROM q JOIN c ON q.p_brand = c.p_brand", "FROM q, c")


@query("k11_batch_similarity", BATCH_SQL + ", b AS (SELECT candidate, recency, round(max(j), 9) AS score FROM s GROUP BY 1, 2) SELECT candidate, score, row_number() OVER (ORDER BY score DESC, recency DESC, candidate DESC) AS rank FROM b")
def k11(spark, d):
    part = table(spark, d, "part")
    pool = part.select(F.col("p_partkey").alias("candidate"), F.col("p_size").alias("recency"), F.col("p_name").alias("text"))
    return knowledge.batch_scores(pool, part.filter("p_partkey % 50 = 0").select(F.col("p_name").alias("text")), scalars.tokens).select("candidate", "score", "rank")


@query("k12_batch_trigrams", BATCH_SQL + ", b AS (SELECT candidate, recency, round(max(r), 9) AS score FROM s GROUP BY 1, 2) SELECT candidate, score, row_number() OVER (ORDER BY score DESC, recency DESC, candidate DESC) AS rank FROM b")
def k12(spark, d):
    part = table(spark, d, "part")
    pool = part.select(F.col("p_partkey").alias("candidate"), F.col("p_size").alias("recency"), F.col("p_name").alias("text"))
    return knowledge.batch_scores(pool, part.filter("p_partkey % 50 = 0").select(F.col("p_name").alias("text")), scalars.trigrams).select("candidate", "score", "rank")


@query("x09_bake_off", POOL + """, k AS (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY recency DESC, candidate DESC) AS recency, row_number() OVER (PARTITION BY query ORDER BY j DESC, recency DESC, candidate DESC) AS tokens,
    row_number() OVER (PARTITION BY query ORDER BY r DESC, recency DESC, candidate DESC) AS trigrams FROM s),
  h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(1.0::DOUBLE / (60 + recency) + 1.0::DOUBLE / (60 + tokens), 12) DESC, candidate DESC) AS hybrid FROM k),
  u AS (SELECT 'recency' AS ranker, query, candidate, recency AS rank FROM h UNION ALL SELECT 'tokens', query, candidate, tokens FROM h UNION ALL SELECT 'trigrams', query, candidate, trigrams FROM h UNION ALL SELECT 'hybrid', query, candidate, hybrid FROM h)
  SELECT ranker, query, candidate, rank FROM u WHERE rank <= 5""")
def x09(spark, d):
    part = table(spark, d, "part")
    q = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.col("p_name").alias("text"), "p_brand")
    c = part.select(F.col("p_partkey").alias("candidate"), F.col("p_size").alias("recency"), F.col("p_name").alias("candidate_text"), "p_brand")
    rankers = ["recency", "tokens", "trigrams", "hybrid"]
    return knowledge.best_of(knowledge.ranked_pool(q, c, "query", ["p_brand"], ["text"], ["candidate_text"], rankers, most=5), "query", rankers, 5)
