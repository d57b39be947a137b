"""Golden values and edge cases of single operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.operators import graph, joins, state, stats, topk, windows
from tidewater.sources import readers
from tidewater.streaming import monitors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_trigram_similarity_has_the_documented_values(spark):
    assert one(spark, scalars.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(0.363636, abs=1e-6)
    assert one(spark, scalars.trigram_similarity(F.lit("Iran"), F.lit("Iranian"))) == pytest.approx(0.625)
    assert one(spark, scalars.trigram_similarity(F.lit(""), F.lit(""))) == 0


def test_ratios_of_nothing_are_null(spark):
    assert one(spark, scalars.flicker_ratio(F.lit(3), F.lit(0))) is None
    assert one(spark, scalars.turnover_from_rate(F.lit(3), F.lit(0), F.lit(10))) is None
    assert one(spark, scalars.full_turnover_minutes(F.lit(1.0), F.lit(10))) is None
    rows = spark.createDataFrame([], "key string, x double, y double")
    assert stats.hit_rate(rows, [], "x", "y").first().hit_rate is None
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "key string, x double, y double")
    assert stats.rank_ic(flat, ["key"], "x", "y").first().ic == 0


def test_duplicate_claims_need_equal_numbers(spark):
    assert one(spark, scalars.is_duplicate_claim(F.lit("oil rose 5 percent"), F.lit("Oil rose 5 percent.")))
    assert not one(spark, scalars.is_duplicate_claim(F.lit("oil rose 5 percent"), F.lit("oil rose 6 percent")))


def test_form_matches_whole_words(spark):
    hit = lambda form, text: one(spark, predicates.form_matches(F.lit(form), F.lit(text)))
    assert hit("Bank", "the bank said") and not hit("Bank", "banking") and not hit("Bank", "éBank")
    assert hit("EU", "the EU said") and not hit("EU", "the eu said")


def test_url_normalisation(spark):
    assert one(spark, scalars.normalize_url(F.lit("http://a/b?utm_x=1&k=2&gclid=3&z#f"))) == "http://a/b?k=2&z"
    assert one(spark, scalars.normalize_url(F.lit("http://a/b?utm_x=1"))) == "http://a/b"


def test_pair_and_bcubed_recall_golden_values(spark):
    # one group of three items of three outlets, of which two are linked
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "grp int, item int, outlet int")
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "item int, event int")
    got = stats.pair_recall(rows, links, "grp", "item", "outlet").first()
    assert (got.pairs, got.linked) == (3, 1) and got.recall == pytest.approx(1 / 3)
    assert stats.bcubed_recall(rows, links, "grp", "item").first().recall == pytest.approx(5 / 9)


def test_pair_recall_is_not_transitive(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "grp int, item int, outlet int")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11)], "item int, event int")
    assert stats.pair_recall(rows, links, "grp", "item", "outlet").first().recall == pytest.approx(2 / 3)


def test_pairwise_agreement_golden_values(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)], "item int, a int, b int")
    got = stats.agreement(rows, "a", "b", "item").first()
    assert got.precision == pytest.approx(2 / 6) and got.recall == 1
    same = stats.agreement(rows, "a", "a", "item").first()
    assert same.ari == 1
    alone = spark.createDataFrame([(1, None, None), (2, None, None)], "item int, a int, b int")
    assert stats.agreement(alone, "a", "b", "item").first().ari == 1


def test_quantile_buckets_follow_the_slice_rule(spark):
    rng = random.Random(4)
    for _ in range(5):
        n, q = rng.randint(1, 40), rng.randint(1, 8)
        rows = windows.quantile_buckets(spark.range(n).withColumn("k", F.lit(1)), ["k"], ["id"], q).collect()
        for r in rows:
            assert r.bucket * n // q <= r.id < (r.bucket + 1) * n // q


def test_token_bucket_equals_the_recurrence(spark):
    rng = random.Random(5)
    steps = [(1, i, rng.uniform(0, 2), rng.uniform(0, 2)) for i in range(50)]
    rows = spark.createDataFrame(steps, "k int, i int, a double, s double")
    got = {r.i: r.balance for r in windows.token_bucket(rows, "k", "i", "a", "s", 1.0, 3.0).collect()}
    balance = 1.0
    for _, i, a, s in steps:
        balance = min(3.0, balance + a) - s
        assert got[i] == pytest.approx(balance)


def test_asof_ties_and_tolerance(spark):
    d = dt.date
    left = spark.createDataFrame([("a", d(2024, 1, 5)), ("a", d(2024, 1, 1)), ("b", d(2024, 1, 5))], "k string, t date")
    right = spark.createDataFrame([("a", d(2024, 1, 5), 1.0), ("a", d(2024, 1, 5), 2.0), ("a", d(2024, 1, 2), 9.0)], "k string, u date, v double")
    got = {(r.k, r.t): r.value for r in joins.asof_backward(left, right, ["k"], "t", "u", "v").collect()}
    assert got == {("a", d(2024, 1, 5)): 2.0, ("a", d(2024, 1, 1)): None, ("b", d(2024, 1, 5)): None}
    ahead = {(r.k, r.t): r.snapped for r in joins.asof_forward(left, right, ["k"], "t", "u", 4).collect()}
    assert ahead[("a", d(2024, 1, 1))] == d(2024, 1, 2) and ahead[("b", d(2024, 1, 5))] is None


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src int, dst int")
    got = {r.id: r.component for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_seed_star_is_not_transitive_but_bfs_is(spark):
    items = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)], "window int, item int")
    edges = spark.createDataFrame([(0, 3, 4, 0.9), (0, 2, 3, 0.8)], "window int, a int, b int, weight double")
    star = {r.item: r.cluster for r in graph.seed_star(items, edges).collect()}
    assert star == {4: 4, 3: 4, 2: 2, 1: 1}
    assert {r.item: r.cluster for r in graph.capped_bfs(items, edges).collect()} == {4: 4, 3: 4, 2: 4, 1: 1}
    assert {r.item: r.cluster for r in graph.capped_bfs(items, edges, cap=2).collect()} == {4: 4, 3: 4, 2: 2, 1: 1}


def test_reserved_slots_do_not_repeat(spark):
    rows = spark.createDataFrame([(1, i, i, 10 - i) for i in range(1, 8)], "q int, c int, r1 int, r2 int")
    got = [r.c for r in topk.reserved_slots(rows, "q", ["r1", "r2"], [2, 3], "c").orderBy("slot").collect()]
    assert got == [1, 2, 7, 6, 5]


def test_merged_claims(spark):
    prior = spark.createDataFrame([("L", "c-0001", "oil output rose 5 percent"), ("L", "c-0007", "gold fell 2 percent")], "ledger string, id string, claim string")
    reply = spark.createDataFrame(
        [("L", 0, "c-0007", "gold fell again", "fact"), ("L", 1, None, "Oil output rose 5 percent", "fact"), ("L", 2, None, "oil output rose 5 percent", "fact"),
         ("L", 3, None, "rates stay", "observation"), ("L", 4, None, "a new claim appears", None), ("L", 5, None, None, "fact")],
        "ledger string, pos int, id string, claim string, kind string")
    got = [(r.id, r.action) for r in state.merge_claims(prior, reply).collect()]
    assert got == [("c-0007", "reaffirm"), ("c-0001", "reuse"), (None, "repeat"), (None, "reject"), ("c-0008", "new")]


def test_status_transitions(spark):
    move = lambda old, new, why: one(spark, state.transition(F.lit(old), F.lit(new), F.lit(why)))
    assert move("broken", "standing", "x") == "broken"
    assert move("standing", "broken", " ") == "challenged" and move("standing", "Broken", "seen") == "broken"
    assert move("standing", "nonsense", None) == "standing"


def test_schedule(spark):
    at = F.lit("2024-01-02 03:50:00").cast("timestamp_ntz")
    base = one(spark, F.unix_timestamp(F.lit("2024-01-02").cast("timestamp_ntz")))
    assert one(spark, state.previous_fire(at, every_minutes=60)) == base + 3 * 3600
    assert one(spark, state.next_fire(at, every_minutes=60)) == base + 4 * 3600
    assert one(spark, state.previous_fire(at, at_minutes=240)) == base + 4 * 3600 - 86400
    late = F.lit("2024-01-02 23:59:00").cast("timestamp_ntz")
    assert one(spark, state.next_fire(late, every_minutes=7 * 60)) == base + 86400


def test_feeds_report_failures_as_rows(spark, tmp_path):
    (tmp_path / "good.xml").write_text("<rss><channel><item><guid>1</guid><title> </title><description>&lt;b&gt;Body&lt;/b&gt; text</description><link>http://a/?utm_s=1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    (tmp_path / "bad.xml").write_text("<rss>")
    (tmp_path / "empty.xml").write_text("<rss></rss>")
    urls = [f"file://{tmp_path}/{n}.xml" for n in ("good", "bad", "empty", "missing")]
    rows = readers.read_feeds(spark, urls)
    assert {r.feed.rpartition("/")[2]: r.failure for r in rows.collect()} == {"good.xml": None, "bad.xml": "malformed", "empty.xml": "empty", "missing.xml": "network"}
    entry = readers.normalised_entries(rows).first()
    assert entry.title == "Body text" and entry.published_at is not None and len(entry.hash) == 64


def test_event_lines_and_charts(spark):
    fields = [""] * 58
    for k, v in {1: "20240102", 28: "18", 29: "4", 30: "-5.0", 31: "7", 34: "1.5", 51: "IZ"}.items():
        fields[k] = v
    lines = spark.createDataFrame([("\t".join(fields),), ("\t".join(fields[:20]),), ("\t".join(["x"] * 58),)], "value string")
    got = readers.typed_event_rows(lines).collect()
    assert len(got) == 1 and got[0].mentions == 7 and got[0].date == dt.date(2024, 1, 2)
    charts = spark.createDataFrame([("S", "America/New_York", [1704200400, 1704204000, 1704240000], [1.0, 2.0, None], [1.1, None, None])], readers.BARS)
    assert [(r.date, r.close) for r in readers.chart_closes(charts).collect()] == [(dt.date(2024, 1, 2), 2.0)]


def test_watch_file_reports_bad_rows(spark):
    text = '{"version": 1, "rows": [{"id": "a", "trigger": "x"}, {"id": "b", "condition": "below"}, {"id": "c", "condition": "above_ma200"}, {"trigger": "y"}]}'
    got = [(r.kind, r.error) for r in readers.watch_rows(spark.createDataFrame([(text,), ("junk",)], "value string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("event", None), ("price", "level"), ("price", None), ("event", "id"), ("event", "version")]))


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(hours=i), float(rng.choice([1, 2, 3, 50])), rng.choice(["x", "y", None])) for i in range(120)]
    frame = spark.createDataFrame(rows, "k int, ts timestamp, v double, e string")
    for part in range(4):
        frame.filter((F.col("ts") >= start + dt.timedelta(hours=30 * part)) & (F.col("ts") < start + dt.timedelta(hours=30 * part + 30))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(stream, name):
        spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/ck-{name}")
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(monitors.volume_alerts(read(), "k", "ts", "v"), "volume") == sorted(map(tuple, monitors.volume_alerts(frame, "k", "ts", "v").collect()))
    batch = state.alert_once(frame, "k", "ts", "e").select("k", "ts", "e")
    assert run(monitors.alert_once(read(), "k", "ts", "e"), "once") == sorted(map(tuple, batch.collect()))
    counts = run(monitors.window_counts(read(), "ts", "k"), "counts")
    assert counts and all(n <= 6 for _, _, n in counts)
    target = f"{tmp_path}/target"
    frame.limit(0).write.parquet(target)
    writer = monitors.capture(read(), lambda: spark.read.schema(frame.schema).parquet(target), lambda new: new.write.mode("append").parquet(target), ["k"], ["ts"])
    writer.option("checkpointLocation", f"{tmp_path}/ck-capture").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(target).count() == 3
