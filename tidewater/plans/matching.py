"""Queries of routing and matching joins, rankings, packing, clusters, samples and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import aggregates, graph, joins, knowledge, sampling, state, stats, topk
from tidewater.plans.catalog import query, table
from tidewater.streaming import monitors


@query("j23_j24_annotations", """SELECT o_orderkey, c_mktsegment AS sentiment, CASE WHEN o_custkey % 3 = 0 THEN 'wire' ELSE 'unknown' END AS kind, CASE WHEN o_custkey % 3 = 0 THEN n_name ELSE 'unknown' END AS perspective
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey > 4 LEFT JOIN nation ON n_nationkey = o_custkey % 25""")
def j23(spark, d):
    ticker = lambda k: F.concat(F.lit("T"), k.cast("string"))
    signals = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("lse:"), F.lower(ticker(F.col("o_custkey"))), F.lit(".l")).alias("ticker"), F.col("o_custkey").alias("source_id"))
    bundles = table(spark, d, "customer").filter("c_nationkey > 4").select(ticker(F.col("c_custkey")).alias("ticker"), F.col("c_mktsegment").alias("sentiment"))
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    sources = signals.select("source_id").distinct().filter("source_id % 3 = 0").join(names, F.col("source_id") % 25 == F.col("n_nationkey")).select("source_id", F.lit("wire").alias("kind"), F.col("n_name").alias("perspective"))
    return knowledge.annotated(signals, bundles, sources).select("o_orderkey", "sentiment", "kind", "perspective")


@query("j31_best_match", """WITH k AS (SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 1]) AS k, unnest([0, 1]) AS p FROM supplier)
  SELECT s_suppkey, n_nationkey AS matched FROM k JOIN nation ON n_nationkey = k AND n_regionkey <> 2 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY k, n_name) = 1""")
def j31(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey <> 2")
    got = joins.best_match_by_keys(table(spark, d, "supplier"), F.array(F.col("s_nationkey"), F.col("s_nationkey") + 1), n, F.array("n_nationkey"), [F.col("n_nationkey"), F.col("n_name")], "s_suppkey")
    return got.select("s_suppkey", F.col("n_nationkey").alias("matched"))


@query("j32_j45_j46_tiers", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_partkey % 10 = 0 THEN 'override' END, CASE WHEN p_size > 25 THEN p_brand END, s_name) AS found, count(*) AS n
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1, 2, 3, 4, 5""")
def j32(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    over = part.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("l_partkey"), F.lit("override").alias("v"))
    exact = part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("v"))
    base = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("v"))
    got = joins.tiered(li, [(over, "l_partkey", "v"), (exact, "l_partkey", "v"), (base, "l_suppkey", "v")], "found")
    return got.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "found").agg(F.count("*").alias("n"))


@query("j34_prefiltered_hits", """WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS form FROM part WHERE p_size > 10) SELECT p_partkey AS item, form AS entity FROM part JOIN f ON list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lower(form)) WHERE form <> ''""")
def j34(spark, d):
    part = table(spark, d, "part")
    forms = part.filter("p_size > 10").select(F.element_at(F.split("p_name", " "), 2).alias("form")).distinct()
    return joins.dictionary_hits(part, forms.withColumn("entity", F.col("form")), "p_partkey", "p_name")


@query("j36_armed", """SELECT user_id, CASE WHEN max(event_id) % 3 = 0 AND user_id % 4 <> 1 THEN 'fire' WHEN max(event_id) % 3 = 1 AND user_id % 4 = 1 THEN 'rearm' ELSE 'keep' END AS action FROM events GROUP BY 1""")
def j36(spark, d):
    last = F.max("event_id") % 3
    now = table(spark, d, "events").groupBy("user_id").agg(F.when(last == 0, "fired").when(last == 1, "not").otherwise("unknown").alias("verdict"))
    armed = now.select("user_id", (F.col("user_id") % 4 != 1).alias("is_armed")).filter("user_id % 2 = 1")
    return joins.arm_changes(now, armed, "user_id", "verdict").select("user_id", "action")


@query("j39_nearest", """SELECT a.event_id AS anchor, e.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(floor(epoch(a.ts)) - floor(epoch(e.ts))), e.event_id) AS rank FROM events a JOIN events e ON e.user_id = a.user_id WHERE a.event_type = 'error' QUALIFY rank <= 3""")
def j39(spark, d):
    e = table(spark, d, "events")
    anchors = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("anchor"), F.col("ts").alias("at"))
    got = joins.nearest_in_time(anchors, e.select("user_id", "event_id", "ts"), "user_id", "at", "ts", "event_id", 3)
    return got.select("anchor", "event_id", F.col("rank").cast("long").alias("rank"))


@query("j40_g09_g10_births", """WITH b AS (SELECT p_partkey AS entity, least(TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * p_size, min(l_shipdate)) AS born FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, p_size)
  SELECT l_suppkey AS item, count(*) AS hits FROM lineitem JOIN b ON entity = l_partkey WHERE born < TIMESTAMP '1996-02-01' GROUP BY 1""")
def j40(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    items = li.select(F.monotonically_increasing_id().alias("item"), F.col("l_partkey").alias("entity"), F.col("l_shipdate").alias("at"), "l_suppkey")
    made = part.select(F.col("p_partkey").alias("entity"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("p_size")).cast("timestamp_ntz").alias("created"))
    births = knowledge.naming_births(items.select("item", "entity"), items.select("item", "at"), made)
    got = graph.prior_hits(items.withColumn("start", F.lit("1996-02-01").cast("timestamp_ntz")), births, "start")
    return got.groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("hits"))


@query("j41_lookup_map", "SELECT c_custkey, coalesce(n_name, 'nowhere') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def j41(spark, d):
    names = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup_with_default(table(spark, d, "customer"), names, "c_nationkey", "n_name", "nowhere", "nation").select("c_custkey", "nation")


@query("j47_source_titles", "SELECT s_suppkey, 'wire ' || s_nationkey AS source, k || ' of ' || s_name AS title FROM supplier, (VALUES ('first'), ('second')) t(k)")
def j47(spark, d):
    text = F.concat(F.lit("lost line\nSOURCE: wire "), F.col("s_nationkey").cast("string"), F.lit("\n- first of "), "s_name", F.lit(" [2024-01-01]\n\n  \nsecond of "), "s_name")
    return knowledge.source_titles(table(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@query("a25_p06_transcript_means", """SELECT o_custkey AS ticker, CAST(epoch(CAST(date_trunc('quarter', min(o_orderdate)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS BIGINT) // 86400 + 50 AS day, avg(round(o_totalprice * 100)) FILTER (WHERE o_orderstatus = 'O') AS value FROM orders GROUP BY 1""")
def a25(spark, d):
    status = F.col("o_orderstatus")
    segment = F.struct(F.when(status == "F", "Operator").otherwise("A. Person").alias("speaker"), F.when(status == "P", "Head of Investor Relations").otherwise("CEO").alias("title"), F.round(F.col("o_totalprice") * 100).alias("sentiment"))
    first = F.min("o_orderdate")
    quarter = F.concat(F.year(first).cast("string"), F.lit("Q"), F.quarter(first).cast("string"))
    calls = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(quarter.alias("quarter"), F.collect_list(segment).alias("segments"))
    return knowledge.transcript_means(calls).select("ticker", F.unix_date("date").cast("long").alias("day"), "value")


@query("a30_admission_confusion", """WITH r AS (SELECT l.toxic = 1 AS t, d.n_chars < 900 AS p FROM labels l JOIN documents d USING (doc_id)) SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM r""")
def a30(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return aggregates.confusion(rows, F.col("toxic") == 1, F.col("n_chars") < 900).select("tp", "fp", "fn", "tn")


@query("a53_inversions", "SELECT l_linenumber, round(v, 9) AS value, round(below, 9) AS below FROM (SELECT l_linenumber, v, lag(v) OVER (ORDER BY l_linenumber) AS below FROM (SELECT l_linenumber, avg(l_quantity) AS v FROM lineitem GROUP BY 1)) WHERE v < below")
def a53(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").alias("v"))
    return aggregates.inversions(rows, "l_linenumber", "v").select("l_linenumber", F.round("v", 9).alias("value"), F.round("below", 9).alias("below"))


PERFORMANCE = "SELECT 'asset_class' AS dimension, o_orderpriority AS value, count(*) AS n, round(avg(o_totalprice), 4) AS mean_edge FROM orders GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'status', o_orderstatus, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY 2"


def _performance(spark, d):
    o = table(spark, d, "orders")
    of = lambda name, value: o.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_edge")).withColumn("dimension", F.lit(name))
    return of("asset_class", F.col("o_orderpriority")).unionByName(of("all", F.lit("all"))).unionByName(of("status", F.col("o_orderstatus")))


@query("a54_qualified", f"SELECT dimension, value, n FROM ({PERFORMANCE}) WHERE dimension <> 'all' AND n >= 300")
def a54(spark, d):
    return knowledge.qualified(_performance(spark, d), 300).select("dimension", "value", "n")


@query("t12_gate_history", f"SELECT w AS week, value AS asset_class, CASE WHEN w = '2024-W2' THEN mean_edge ELSE 0 END AS mean_edge FROM ({PERFORMANCE}), (VALUES ('2024-W1'), ('2024-W2')) t(w) WHERE dimension = 'asset_class'")
def t12(spark, d):
    """Week 2 is written twice; its second rows stand."""
    now = _performance(spark, d)
    old = now.filter("dimension = 'asset_class'").select(F.explode(F.array(F.lit("2024-W1"), F.lit("2024-W2"))).alias("week"), F.col("value").alias("asset_class"), F.lit(0.0).alias("mean_edge"))
    return knowledge.gate_history(old, now, F.lit("2024-W2"))


@query("a55_daily_digest", "SELECT o_orderpriority AS asset_class, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-04') AS opened, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def a55(spark, d):
    book = table(spark, d, "orders").select(F.col("o_orderpriority").alias("asset_class"), F.to_date("o_orderdate").alias("entry_date"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return knowledge.daily_digest(book, F.lit("1997-03-04").cast("date"))


@query("k05_k06_k07_k08_rankings", """WITH q AS (SELECT p_partkey AS query, p_brand, p_size AS qs FROM part WHERE p_partkey % 50 = 0), s AS (SELECT query, p_partkey AS candidate, p_size AS recency, (qs % 3 = p_size % 3)::INT + (qs % 5 = p_size % 5)::INT AS o FROM q JOIN part USING (p_brand))
  SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY recency DESC, candidate DESC) AS rank_recency, row_number() OVER (PARTITION BY query ORDER BY o DESC, recency DESC, candidate DESC) AS rank_overlap FROM s""")
def k05(spark, d):
    part = table(spark, d, "part")
    marks = F.array(F.concat(F.lit("a"), (F.col("p_size") % 3).cast("string")), F.concat(F.lit("b"), (F.col("p_size") % 5).cast("string")))
    q = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), "p_brand", marks.alias("entities"))
    c = part.select(F.col("p_partkey").alias("candidate"), F.col("p_size").alias("recency"), "p_brand", marks.alias("candidate_entities"))
    got = knowledge.ranked_pool(q, c, "query", ["p_brand"], ["entities"], ["candidate_entities"], ["recency", "overlap"])
    return got.select("query", "candidate", F.col("rank_recency").cast("long").alias("rank_recency"), F.col("rank_overlap").cast("long").alias("rank_overlap"))


@query("k16_j38_recall_at", """WITH r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b, event_type FROM events) SELECT count(*) AS targets, count(*) FILTER (WHERE a <= 30) AS a, count(*) FILTER (WHERE b <= 30) AS b FROM r WHERE event_type = 'error'""")
def k16(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    by = lambda *o: F.row_number().over(Window.partitionBy("user_id").orderBy(*o))
    ranked = e.select("event_type", by(F.desc("ts"), "event_id").alias("a"), by(F.desc("value"), "event_id").alias("b")).filter("event_type = 'error'")
    return topk.recall_at(ranked, ["a", "b"], 30)


@query("k09_k13_reserved_slots", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b FROM events),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b) AS k FROM r WHERE a > 3)
  SELECT user_id, event_id, CAST(a AS INT) AS slot FROM r WHERE a <= 3 UNION ALL SELECT user_id, event_id, CAST(k + least(3, (SELECT count(*) FROM r x WHERE x.user_id = s.user_id)) AS INT) FROM s WHERE k <= 2""")
def k09(spark, d):
    from pyspark.sql import Window

    by = lambda *o: F.row_number().over(Window.partitionBy("user_id").orderBy(*o))
    e = table(spark, d, "events").select("user_id", "event_id", by(F.desc("ts"), "event_id").alias("a"), by(F.desc("value"), "event_id").alias("b"))
    return topk.reserved_slots(e, "user_id", ["a", "b"], [3, 2], "event_id")


@query("k18_k19_requests", """WITH c AS (SELECT l_suppkey AS w, l_orderkey AS cluster, l_partkey AS item, l_linenumber FROM lineitem), d AS (SELECT DISTINCT w, cluster, item FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY w, cluster) AS n FROM d)
  SELECT w, cluster, item, 'c' || cluster AS request FROM n WHERE n > 1 UNION ALL SELECT w, cluster, item, 's' || (row_number() OVER (PARTITION BY w ORDER BY item DESC, cluster) - 1) // 10 FROM n WHERE n = 1""")
def k18(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("w"), F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("item")).distinct()
    return topk.pack_requests(rows, "w", "cluster", "item", 10)


@query("k20_interleaved", "SELECT source AS host, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round, count(*) OVER (PARTITION BY source) AS \"of\" FROM documents")
def k20(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("host"), "doc_id")
    got = topk.interleave_hosts(rows, "host", "doc_id")
    return got.select("host", "doc_id", F.col("round").cast("long").alias("round"), "of")


@query("k21_evidence", """WITH o AS (SELECT l_suppkey AS key, l_partkey AS url, min((l_linenumber, l_returnflag)) AS m FROM lineitem GROUP BY 1, 2) SELECT key, url, row_number() OVER (PARTITION BY key ORDER BY m, url) AS rank FROM o QUALIFY rank <= 3""")
def k21(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("depth"), F.col("l_partkey").alias("url"))
    return topk.pick_evidence(rows, "key", "grp", "depth", "url").select("key", "url", F.col("rank").cast("long").alias("rank"))


@query("k10_k22_batches", """SELECT a.event_id AS anchor, e.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY e.ts DESC, e.event_id DESC) AS rank FROM events a JOIN events e ON e.user_id = a.user_id AND e.ts <= a.ts AND floor(epoch(a.ts)) - floor(epoch(e.ts)) <= 48 * 3600 WHERE a.event_type = 'purchase' QUALIFY rank <= 4""")
def k22(spark, d):
    e = table(spark, d, "events")
    got = topk.batch_around(e.select("user_id", "event_id", "ts"), e.filter("event_type = 'purchase'"), "user_id", "ts", "event_id", 48, 4)
    return got.select("anchor", "event_id", F.col("rank").cast("long").alias("rank"))


@query("u01_claimed_since", "SELECT DISTINCT user_id AS window_id FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM (SELECT ts FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-20' UNION ALL SELECT ts FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-25'))")
def u01(spark, d):
    e = table(spark, d, "events")
    opened = e.filter("event_type = 'click'").select(F.col("user_id").alias("window_id"), F.lit("open").alias("kind"), F.col("ts").alias("at"))
    ends = [e.filter("event_type = 'purchase' AND user_id % 2 = 0 AND ts < TIMESTAMP_NTZ '2024-01-20'"), e.filter("event_type = 'error' AND ts < TIMESTAMP_NTZ '2024-01-25'")]
    return knowledge.claimed_since(opened, [x.select(F.col("ts").alias("at")) for x in ends])


@query("u10_overlaid_edges", """SELECT a, b, max(w) AS weight FROM (SELECT l_orderkey AS a, l_partkey AS b, 0.0::DOUBLE AS w FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE l_quantity > 25) GROUP BY 1, 2""")
def u10(spark, d):
    li = table(spark, d, "lineitem")
    edge = lambda rows, w: rows.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), w.alias("weight"))
    return graph_edges(edge(li, F.lit(0.0)), edge(li.filter("l_quantity > 25"), F.col("l_discount")))


def graph_edges(weak, strong):
    return topk.overlaid_edges(weak, strong)


@query("l07_g12_confirmed", """SELECT grp AS "group", max(n) >= 2 AS confirms FROM (SELECT l_orderkey // 4 AS grp, l_partkey % 50 AS event, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_partkey) AS items FROM lineitem GROUP BY 1, 2) GROUP BY 1""".replace("max(n) >= 2", "bool_or(n >= 2 AND items >= 2)"))
def l07(spark, d):
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("group"), "l_partkey", "l_suppkey", (F.col("l_partkey") % 50).alias("event"))
    return stats.confirmed_groups(rows, "group", "l_partkey", "l_suppkey", "event")


@query("l18_replay_decisions", """SELECT o_custkey, CASE WHEN count(*) < 8 THEN 'too_few' WHEN avg((o_orderstatus = 'F')::INT) - avg((o_orderstatus = 'O')::INT) <= 0.05 AND avg((o_totalprice > 250000)::INT) - 0.5 <= 0.05 THEN 'accept' ELSE 'reject' END AS decision FROM orders GROUP BY 1""")
def l18(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(share(F.col("o_orderstatus") == "F").alias("a"), share(F.col("o_orderstatus") == "O").alias("b"), share(F.col("o_totalprice") > 250000).alias("c"), F.count("*").alias("n"))
    return rows.select("o_custkey", stats.replay_decision(F.col("a"), F.col("b"), F.lit(0.5), F.col("c"), F.col("n"), least=8).alias("decision"))


@query("g04_component_sizes", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey + 1000000 + l_linenumber AS b FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
  m AS (SELECT id, min(c) AS c FROM r GROUP BY 1), v AS (SELECT s_suppkey AS id FROM supplier UNION SELECT b FROM e) SELECT coalesce(m.c, v.id) AS component, count(*) AS size FROM v LEFT JOIN m ON m.id = v.id GROUP BY 1""")
def g04(spark, d):
    edges = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + 1000000 + F.col("l_linenumber")).alias("dst")).distinct()
    vertices = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).union(edges.select("dst")).distinct()
    return graph.component_sizes(vertices, edges)


@query("g07_g08_visible", """WITH p AS (SELECT l_partkey AS item, min(l_suppkey) AS w, min(l_linenumber) AS r FROM lineitem GROUP BY 1), q AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)
  SELECT count(*) AS pairs, count(*) FILTER (WHERE pa.w <> pb.w OR pa.r = pb.r) AS batch, count(*) FILTER (WHERE pa.w <> pb.w OR pa.r <> pb.r) AS real_time FROM q JOIN p pa ON pa.item = a JOIN p pb ON pb.item = b""")
def g07(spark, d):
    li = table(spark, d, "lineitem")
    placed = li.groupBy(F.col("l_partkey").alias("item")).agg(F.min("l_suppkey").alias("w"), F.min("l_linenumber").alias("r"))
    n = graph.parts_for(li, 250_000)
    own = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ps")).select(F.posexplode("ps").alias("at", "a"), "ps")
    pairs = own.select("a", F.explode(F.slice("ps", F.col("at") + 2, F.size("ps"))).alias("b")).repartition(n, "a", "b").distinct()
    both = graph.visible_both(pairs, placed.repartition(n, "item"), "w", "r")
    return both.agg(F.count("*").alias("pairs"), F.count_if("batch").alias("batch"), F.count_if("real_time").alias("real_time"))


@query("r03_r07_draws", """WITH d AS (SELECT lang, source, doc_id, md5('9|' || doc_id) AS d FROM documents) SELECT lang, source, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY d, doc_id) <= 2""")
def r03(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"], 2, "9").select("lang", "source", "doc_id")


@query("r05_far_pairs", """SELECT a.l_partkey AS k, a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey
  WHERE abs(epoch(a.l_shipdate) - epoch(b.l_shipdate)) >= 30 * 86400 GROUP BY 1, 2, 3""")
def r05(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda n: li.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias(n), F.col("l_shipdate").alias(f"t{n}"), F.col("l_returnflag").alias(f"x{n}"))
    pairs = side("a").join(side("b"), ["l_partkey", "l_suppkey"]).filter("a < b")
    return knowledge.negative_pairs(pairs, 30, "xa", "xb").groupBy(F.col("l_partkey").alias("k"), "a", "b").agg(F.count("*").alias("n"))


@query("t01_captured", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def t01(spark, d):
    """Two passes over the same rows; the second appends nothing."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    first = state.insert_if_absent(rows.limit(0), rows, ["user_id", "event_type"], ["event_id"])
    return first.unionByName(state.insert_if_absent(first, rows, ["user_id", "event_type"], ["event_id"])).select("user_id", "event_type", "event_id")


@query("t05_t08_sliding_counts", """WITH w AS (SELECT event_type, unnest([0, 1, 2, 3]) AS k, CAST(floor(epoch(ts) / 43200) AS BIGINT) * 43200 AS s FROM events) SELECT s - k * 43200 AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def t05(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = monitors.window_counts(rows, "ts", "event_type", "48 hours", "12 hours")
    return got.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("t14_t16_reaffirmed", """SELECT o_orderkey, 1 + o_custkey % 3 AS restate_count, greatest(2, o_custkey % 5) AS source_count, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'challenged' WHEN o_orderstatus = 'F' THEN 'standing' ELSE 'broken' END AS status,
  CASE WHEN o_custkey % 3 = 0 THEN 30 ELSE o_custkey % 40 END AS horizon, CASE WHEN o_custkey % 3 > 0 AND o_custkey % 40 > 0 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) // 86400 + o_custkey % 40 END AS due FROM orders""".replace("ELSE o_custkey % 40 END AS horizon", "WHEN o_custkey % 40 > 0 THEN o_custkey % 40 END AS horizon"))
def t14(spark, d):
    k = F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.lit("grew 5% in 2024").alias("claim"), F.when(k % 2 == 0, "grew 5%").otherwise("it grew 5 in 2024.").alias("new_claim"), (k % 3).alias("restate_count"), F.lit(2).cast("long").alias("source_count"), (k % 5).alias("new_source_count"),
        F.when(F.col("o_orderstatus") == "F", "standing").otherwise("broken").alias("status"), F.when(k % 3 == 0, 30).alias("horizon_days"), (k % 40).alias("new_horizon_days"), F.to_date("o_orderdate").alias("first_seen"), F.lit(None).cast("date").alias("resolution_date"))
    got = state.reaffirmed(rows, F.lit("2024-01-01").cast("date"))
    return got.select("o_orderkey", "restate_count", F.col("source_count").cast("long").alias("source_count"), "status", F.col("horizon_days").cast("long").alias("horizon"), F.unix_date("resolution_date").cast("long").alias("due"))


@query("t15_transitions", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'standing' WHEN 'R' THEN 'resolved' ELSE 'challenged' END AS o, l_linenumber AS n, l_discount > 0.04 AS e FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o = 'resolved' THEN o WHEN n = 1 THEN 'standing' WHEN n = 2 AND e THEN 'broken' WHEN n = 2 THEN 'challenged' WHEN n = 3 THEN 'expired' ELSE o END AS status, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""")
def t15(spark, d):
    n = F.col("l_linenumber")
    old = F.when(F.col("l_returnflag") == "A", "standing").when(F.col("l_returnflag") == "R", "resolved").otherwise("challenged")
    proposed = F.when(n == 1, " Standing").when(n == 2, "broken").when(n == 3, "EXPIRED").otherwise("forgotten")
    evidence = F.when(F.col("l_discount") > 0.04, "seen").otherwise(" ")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", state.transition(old, proposed, evidence).alias("status"))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", "status").agg(F.count("*").alias("n"))


@query("t18_next_fire", "SELECT event_id, CAST((floor(epoch(ts) / 2700) + 1) * 2700 AS BIGINT) AS every_45, CAST(CASE WHEN floor(epoch(ts)) % 86400 < 21600 THEN 0 ELSE 1 END * 86400 + floor(epoch(ts) / 86400) * 86400 + 21600 AS BIGINT) AS at_six FROM events")
def t18(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", state.next_fire(ts, every_minutes=45).alias("every_45"), state.next_fire(ts, at_minutes=360).alias("at_six"))


@query("t24_finished", "SELECT s_suppkey AS window_id, CASE WHEN s_nationkey % 2 = 1 THEN 'pending' WHEN s_suppkey = 4 AND (SELECT count(*) FROM lineitem WHERE l_suppkey = 4) = 0 THEN 'complete' WHEN s_suppkey = 4 THEN 'blind_done' ELSE 'open' END AS status FROM supplier")
def t24(spark, d):
    windows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("window_id"), F.when(F.col("s_nationkey") % 2 == 1, "pending").otherwise("open").alias("status"), F.lit(None).cast("timestamp").alias("blind_done_at"))
    several = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("window_id"))
    return knowledge.finished(windows, several, 4, F.lit("2024-01-01").cast("timestamp")).select("window_id", "status")


@query("j10_event_candidates", """WITH g AS (SELECT p_partkey AS id, p_size, p_brand, list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM part),
  s AS (SELECT q.id AS qid, c.id AS cid, c.p_size AS recency, round(len(list_intersect(q.g, c.g)) / (len(q.g) + len(c.g) - len(list_intersect(q.g, c.g))), 9) AS score FROM g q, g c WHERE q.id % 50 = 0 AND c.p_brand IN (SELECT p_brand FROM part WHERE p_size > 45))
  SELECT qid, cid, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, recency DESC, cid DESC) = 1""")
def j10(spark, d):
    """Of the events that share an entity (a brand) with the working set, the one most like each title."""
    part = table(spark, d, "part")
    pool = part.join(part.filter("p_size > 45").select("p_brand").distinct(), "p_brand", "left_semi")
    titles = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text"))
    got = joins.trigram_top_k(titles, pool.select(F.col("p_partkey").alias("cid"), F.col("p_size").alias("recency"), F.col("p_name").alias("text")), "qid", "cid", 1)
    return got.select("qid", "cid", "score")


@query("a41_a42_a43_kinds", """WITH s AS (SELECT event_type AS source, user_id AS hash, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2), n AS (SELECT event_type AS source, max(ts) AS newest, quantile_cont(value, 0.5) AS entries FROM events GROUP BY 1)
  SELECT n.source AS kind, round(any_value(entries), 5) AS entries, count(*) FILTER (WHERE l < newest) AS departed, round(avg((f = l)::INT) FILTER (WHERE l < newest), 6) AS single_share FROM n JOIN s USING (source) GROUP BY 1""")
def a41(spark, d):
    e = table(spark, d, "events")
    polls = e.select(F.col("event_type").alias("source"), F.col("ts").alias("polled_at"), F.lit(None).cast("string").alias("failure"), F.col("value").alias("entries"))
    spans = e.groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("hash")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    got = aggregates.feed_stats(polls, spans)
    return got.select(F.col("source").alias("kind"), F.round("entries", 5).alias("entries"), "departed", F.round("single_share", 6).alias("single_share"))


@query("a45_replay_agreement", """WITH r AS (SELECT l_partkey AS item, min(l_suppkey) % 3 AS a, max(l_suppkey) % 3 AS b, min(l_orderkey) % 3 AS c, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (WHERE a = b) AS same_1, count(*) FILTER (WHERE a = c) AS same_2 FROM r WHERE n % 4 > 0""")
def a45(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg((F.min("l_suppkey") % 3).alias("a"), (F.max("l_suppkey") % 3).alias("b"), (F.min("l_orderkey") % 3).alias("c"), F.count("*").alias("n"))
    runs = rows.select("item", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(r).alias("decision")) for r in "abc"])).alias("x")).select("item", "n", "x.run", "x.decision")
    # An item that a run didn't decide counts in none.
    return knowledge.run_agreement(runs.filter("run <> 'b' OR n % 4 > 0"), ["a", "b", "c"])


@query("u05_stale_keys", "SELECT user_id AS key FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1 HAVING user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-30')")
def u05(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "key")
    side = lambda rows: rows.groupBy("key").agg(F.max("event_id").alias("d"), F.count("*").alias("s"))
    now, before = side(e.filter("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '2024-01-30'")), side(e.filter("event_type = 'click' AND ts < TIMESTAMP_NTZ '2024-01-15'"))
    return joins.state_changes(now, before, "key", "d", "s").filter("action = 'stale'").select("key")


@query("x04_x07_text", """SELECT p_partkey, 'Caf' || 'e' || chr(769) || ' fi ' || p_name AS plain, CASE WHEN p_size % 4 = 0 THEN -0.25 WHEN p_size % 4 = 1 THEN 1.0 WHEN p_size % 4 = 2 THEN p_size / 100.0 END::DOUBLE AS tone FROM part""")
def x04(spark, d):
    n = F.col("p_size")
    reply = F.when(n % 4 == 0, "score: -0.25 of 1").when(n % 4 == 1, F.concat(F.lit("tone "), (n + 1).cast("string"))).when(n % 4 == 2, (n / 100).cast("string")).otherwise("no idea")
    return table(spark, d, "part").select("p_partkey", scalars.nfkd(F.concat(F.lit("Café ﬁ "), "p_name")).alias("plain"), knowledge.tone_score(reply).alias("tone"))


@query("s59_spend_log", "SELECT event_id AS call, value AS cost, 'triage' AS kind FROM events UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders")
def s59(spark, d):
    from tidewater.operators import upkeep

    log = table(spark, d, "events").select(F.col("event_id").alias("call"), F.col("value").alias("cost"), F.lit("triage").alias("kind"))
    return upkeep.appended(log, table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_totalprice").alias("cost")))


@query("s48_written_items", """WITH w AS (SELECT o_orderkey AS item, o_custkey, o_orderstatus AS type, o_orderdate AS at, CASE WHEN o_custkey % 3 = 0 THEN 'refused' WHEN o_totalprice <= 50000 THEN 'rejected' ELSE 'written' END AS status FROM orders)
  SELECT 'events' AS part, type, count(*) AS n FROM w WHERE status = 'written' AND type <> 'F' GROUP BY 2 UNION ALL SELECT 'assertions', type, count(*) FROM w WHERE status = 'written' GROUP BY 2
  UNION ALL SELECT 'links', '', count(*) FROM (SELECT DISTINCT CASE WHEN type = 'F' THEN 'k' || o_custkey % 10 ELSE item || '#0' END, o_custkey FROM w WHERE status = 'written') UNION ALL SELECT status, '', count(*) FROM w GROUP BY 1""")
def s48(spark, d):
    """One item a request: an order tells a known event of its customer or a new one."""
    from tidewater.operators import passes

    o = table(spark, d, "orders").withColumn("item", F.col("o_orderkey"))
    items = o.select(F.col("o_orderkey").alias("request"), "item", F.lit(0).alias("position"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    events = o.select(
        "item", F.lit(0).alias("position"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("k"), (F.col("o_custkey") % 10).cast("string"))).alias("candidate_id"), F.lit(None).cast("string").alias("new_ref"), F.lit(None).cast("string").alias("new_label"),
        F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("type"), F.col("o_orderstatus").alias("standing"), (F.col("o_totalprice") > 50000).alias("valid"))
    entities = o.select("item", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("entity"))
    batch = graph.cut(passes.resolved_batch(items, events, entities, items.select("item").limit(0), F.lit("2024-01-01").cast("timestamp")))
    links = passes.new_links(batch, spark.createDataFrame([], "event string, entity long"))
    told = passes.new_assertions(batch, spark.createDataFrame([], "item long, event string"))
    count = lambda rows, part, by: rows.groupBy(by.alias("type")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "type", "n")
    out = count(passes.new_events(batch), "events", F.col("type")).unionByName(count(told, "assertions", F.col("standing"))).unionByName(count(links, "links", F.lit("")))
    return out.unionByName(batch.groupBy(F.col("status").alias("part")).agg(F.count("*").alias("n")).select("part", F.lit("").alias("type"), "n"))


@query("r04_negative_pairs", """WITH u AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS item, min(l_returnflag) AS outlet, min(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5('6|' || k || '|' || item), item) AS n FROM u), p AS (SELECT DISTINCT least(a.item, b.item) AS a, greatest(a.item, b.item) AS b FROM r a JOIN r b ON b.k = a.k AND b.n > a.n AND b.n <= a.n + 8
    WHERE abs(epoch(a.seen) - epoch(b.seen)) >= 365 * 86400 AND a.outlet <> b.outlet) SELECT a, b FROM p ORDER BY md5('6|' || a || '|' || b), a, b LIMIT 500""")
def r04(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).agg(F.min("l_returnflag").alias("outlet"), F.min("l_shipdate").alias("at"))
    return sampling.far_pairs(rows, "k", "item", "outlet", "at", 365, 500, "6")
