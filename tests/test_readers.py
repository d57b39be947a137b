"""Readers on files: series, bundles, labelled items, books that may be missing, feeds."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewater.sources import readers


def test_series_and_price_points(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "A", "points": [{"date": "2024-01-02", "value": 1.5}, {"date": "soon", "value": 2}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"ticker": "B", "points": []}, {"ticker": "C", "points": [{"date": "2024-01-03", "value": None}]}]))
    got = sorted(map(tuple, readers.read_points(spark, str(tmp_path)).collect()))
    assert got == [("A", dt.date(2024, 1, 2), 1.5), ("C", dt.date(2024, 1, 3), None)]


def test_bundles_and_gold_sets(spark, tmp_path):
    (tmp_path / "bundles").mkdir()
    (tmp_path / "bundles" / "x.json").write_text(json.dumps({"ticker": "X", "sentiment": {"daily_sentiment": 0.25}, "events": [], "error": None}))
    wanted = spark.createDataFrame([("X",), ("Y",)], "ticker string")
    got = {r.ticker: (r.sentiment.daily_sentiment if r.sentiment else None, r.error) for r in readers.read_bundles(spark, str(tmp_path / "bundles"), wanted).collect()}
    assert got == {"X": (0.25, None), "Y": (None, None)}
    (tmp_path / "gold.json").write_text(json.dumps({"items": [{"id": 1, "label": "true"}, {"id": 2, "label": "false"}]}, indent=1))
    assert sorted((r.id, r.label) for r in readers.read_gold_set(spark, str(tmp_path / "gold.json")).collect()) == [(1, "true"), (2, "false")]


def test_books_that_may_be_missing(spark, tmp_path):
    schema = "array<struct<instrument: string, entry: double>>"
    default = spark.createDataFrame([("none", 0.0)], "instrument string, entry double")
    read = lambda name: sorted(map(tuple, readers.read_or_default(spark, str(tmp_path / name), schema, default).collect()))
    (tmp_path / "good.json").write_text('[{"instrument": "A", "entry": 1.0}, {"instrument": "B"}]')
    (tmp_path / "broken.json").write_text('[{"instrument": "A", "ent')
    (tmp_path / "empty.json").write_text("[]")
    assert read("good.json") == [("A", 1.0), ("B", None)]
    assert read("broken.json") == read("empty.json") == read("absent.json") == [("none", 0.0)]


def test_feeds_report_their_failures(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><guid>g1</guid><title>T</title><description>&lt;p&gt;Body&lt;/p&gt;</description><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><summary>No title here</summary><link href="http://x/2?utm_source=f"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>')
    (tmp_path / "bad.xml").write_text("<rss><channel>")
    (tmp_path / "none.xml").write_text("<rss><channel/></rss>")
    urls = [f"file://{tmp_path}/{n}.xml" for n in ("rss", "atom", "bad", "none", "absent")]
    rows = readers.read_feeds(spark, urls)
    kinds = {r.feed.rpartition("/")[2]: r.failure for r in rows.collect()}
    assert kinds == {"rss.xml": None, "atom.xml": None, "bad.xml": "malformed", "none.xml": "empty", "absent.xml": "network"}
    got = {r.guid: (r.title, r.summary, r.published_at) for r in readers.normalised_entries(rows).withColumn("published_at", F.unix_timestamp("published_at")).collect()}
    assert got == {"g1": ("T", "Body", 1704164645), "a1": ("No title here", "No title here", 1704153600)}
