"""Responses, census windows, annotations and pages."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewater.operators import aggregates, knowledge, sampling
from tidewater.sources import readers


def test_extractions_are_checked_in_order(spark):
    event = {"summary": "s", "type": "Action"}
    rows = [
        {"item_id": 1, "entities": [{"candidate_id": "E1"}], "events": [event | {"new_label": "N1"}]},
        {"item_id": 2, "entities": [], "events": [{"new_ref": "N1"}]},
        {"item_id": 3, "entities": [], "events": [{"new_ref": "N9"}]},
        {"item_id": 4, "entities": [{"candidate_id": "E7"}], "events": []},
        {"item_id": 5, "entities": [], "events": [{"summary": "s", "type": "song"}]},
        {"item_id": 9, "entities": [], "events": []},
    ]
    responses = spark.createDataFrame([("r", json.dumps(rows)), ("q", "not json")], "request string, json string")
    offered = spark.createDataFrame([("r", i) for i in range(1, 6)], "request string, item_id long")
    labels = F.array(F.lit("E1"))
    got = knowledge.validated_extractions(responses, offered, labels, F.array().cast("array<string>")).filter("request = 'r'")
    assert {r.item_id: r.reason for r in got.collect()} == {1: None, 2: None, 3: "orphan", 4: "bad_entity", 5: "bad_type", 9: "not_offered"}


def test_triage_takes_offered_ids_and_booleans(spark):
    responses = spark.createDataFrame([("r", '[{"id": 1, "material": true}, {"id": 1, "material": false}, {"id": 7, "material": true}, {"id": 2}]')], "request string, json string")
    offered = spark.createDataFrame([("r", 1), ("r", 2)], "request string, item_id long")
    assert [tuple(r) for r in knowledge.parsed_triage(responses, offered).collect()] == [("r", 1, True)]


def test_verdicts(spark):
    rows = spark.createDataFrame([(k,) for k in "abcd"], "id string")
    replies = spark.createDataFrame([("a", 0, "Triggered", ["H1"]), ("a", 1, "unclear", []), ("b", 0, "triggered", []), ("c", 0, "triggered", ["H9"]), ("z", 0, "unclear", [])], "id string, pos int, verdict string, evidence array<string>")
    got = {r.id: r.verdict for r in knowledge.validated_verdicts(rows, replies, F.array(F.lit("H1"))).collect()}
    assert got == {"a": "triggered", "b": "unclear", "c": "invalid", "d": "invalid"}


def test_sections_and_source_titles(spark):
    doc = spark.createDataFrame([(1, "# A\nx\n## Top\ny\nz\n# B\nw"), (2, None)], "id int, text string")
    assert [r.line for r in knowledge.section(doc, "id", "text", "Top").collect()] == ["y", "z"]
    feed = spark.createDataFrame([(1, "SOURCE: One\n- Title a [2 Jan]\n\nSOURCE: Two\n- Title b")], "id int, text string")
    assert [(r.source, r.title) for r in knowledge.source_titles(feed, "id", "text").collect()] == [("One", "Title a"), ("Two", "Title b")]


def test_window_states(spark):
    schema = "window_id int, order_no int, repeat_of int, status string, abandon_reason string, blind_done_at timestamp"
    w = spark.createDataFrame([(1, 1, None, "open", None, None), (2, 2, 1, "pending", None, None), (3, 3, 1, "complete", None, None)], schema)
    gone = {r.window_id: r.status for r in knowledge.abandoned(w, 1, "why").collect()}
    assert gone == {1: "abandoned", 2: "abandoned", 3: "complete"}
    none = spark.createDataFrame([], "window_id int")
    assert {r.window_id: r.status for r in knowledge.finished(w, none, 1, F.current_timestamp()).collect()}[1] == "complete"
    assert {r.window_id: r.status for r in knowledge.finished(w, w, 1, F.current_timestamp()).collect()}[1] == "blind_done"
    assert knowledge.next_task(w).first().window_id == 1
    queue = spark.createDataFrame([(1, "queued"), (2, "done")], "id int, status string")
    assert [r.status for r in knowledge.claimed(queue, 1).orderBy("id").collect()] == ["running", "done"]
    assert [r.status for r in knowledge.claimed(queue, 2).orderBy("id").collect()] == ["queued", "done"]


def test_tone_and_transcripts(spark):
    replies = spark.createDataFrame([("score: -0.4",), ("3",), ("none",), (None,)], "t string")
    assert [r.v for r in replies.select(knowledge.tone_score(F.col("t")).alias("v")).collect()] == [-0.4, 1.0, None, None]
    calls = spark.createDataFrame([("T", "2020Q3", [("Operator", "", 1.0), ("Ann", "CEO", 0.5), ("Bob", "VP Investor Relations", 1.0)]), ("U", "2020Q4", [])], "ticker string, quarter string, segments array<struct<speaker: string, title: string, sentiment: double>>")
    assert [tuple(r) for r in knowledge.transcript_means(calls).orderBy("ticker").collect()] == [("T", dt.date(2020, 11, 19), 0.5), ("U", dt.date(2021, 2, 19), None)]


def test_annotations_default(spark):
    signals = spark.createDataFrame([("NYSE:abc.US", 1), ("zzz", None)], "ticker string, source_id int")
    bundles = spark.createDataFrame([("ABC", 0.3)], "ticker string, sentiment double")
    sources = spark.createDataFrame([(1, "wire", "neutral")], "source_id int, kind string, perspective string")
    got = {r.ticker: (r.sentiment, r.kind) for r in knowledge.annotated(signals, bundles, sources).collect()}
    assert got == {"NYSE:abc.US": (0.3, "wire"), "zzz": (None, "unknown")}


def test_pending_reads_the_version_in_the_join(spark):
    t = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(i, t, t) for i in range(1, 5)], "item int, published_at timestamp, created_at timestamp")
    verdicts = spark.createDataFrame([(1, 2, "material", 1), (2, 1, "material", 1), (3, 2, "failed", 2), (4, 2, "failed", 3)], "item int, version int, verdict string, attempts int")
    got = knowledge.pending(items, verdicts, 2, F.lit(dt.datetime(2024, 1, 20)))
    assert {(r.item, r.stale) for r in got.collect()} == {(2, True), (3, True)}
    assert tuple(knowledge.at_risk(verdicts).first()) == (1, 1)


def test_surges_count_missing_days_as_zero(spark):
    rows = spark.createDataFrame([("a", 0)] * 250 + [("b", 0)] * 250 + [("b", k) for k in range(1, 8) for _ in range(240)], "key string, ago long")
    assert {r.key: (r.median, r.surge) for r in aggregates.surges(rows, "key", "ago").collect()} == {"a": (0, True), "b": (240, False)}


def test_shares_of_nothing(spark):
    none = spark.createDataFrame([], "event int, outlet int")
    assert aggregates.multi_outlet_share(none, "event", "outlet").first().share is None
    assert aggregates.confusion(spark.createDataFrame([], "a boolean, b boolean"), F.col("a"), F.col("b")).first().precision is None


def test_far_pairs_are_far(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, i, i % 3, t + dt.timedelta(days=i)) for i in range(30)], "key int, item int, outlet int, at timestamp")
    got = sampling.far_pairs(rows, "key", "item", "outlet", "at", 5, 20, "s").collect()
    assert got and all(r.b - r.a >= 5 and r.a % 3 != r.b % 3 for r in got) and len(got) <= 20


def test_embedded_articles(spark):
    page = '<html><script>window.__DATA__ = {"articles": [{"title": "T", "url": "u"}]};</script></html>'
    pages = spark.createDataFrame([(1, page), (2, "<html></html>"), (3, None)], "page_id int, html string")
    assert [(r.page_id, r.title) for r in readers.embedded_articles(pages, "page_id", "html").collect()] == [(1, "T")]
