"""Text rules by the cases they were made for, and rewritten operators against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.operators import joins, stats
from tidewater.streaming import monitors

PATRIOT = "Ukraine was granted a Patriot production licence"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_duplicate_claims(spark):
    cases = [
        (PATRIOT, PATRIOT, True),
        ("Ukraine has been granted a Patriot production licence", "Ukraine was granted the Patriot production licence", True),
        ("The ECB will have held rates", "ECB held rates", True),
        ("oil was cut in May", "oil is cut in May", True),
        ("The BOJ raised the policy rate to 1.0%", "The BOJ raised the policy rate to 1.5%", False),
        ("Japan's 10-year JGB held around 2.88%", "Japan's 10-year JGB held around 2.70%", False),
        ("Exports of 1,000 tons.", "Exports of 1,000, tons", True),
        ("Exports of 1,000 tons", "Exports of 1 000 tons", False),
        ("Iran and Oman are negotiating a shipping framework", "Iran and Oman signed a shipping framework", False),
        (PATRIOT, "The BOJ held rates steady", False),
        ("", "", False), ("the and of", "the and of", False), (None, "oil", False),
    ]
    got = values(spark, cases, "a string, b string, want boolean", scalars.is_duplicate_claim(F.col("a"), F.col("b")), "want")
    assert all(bool(x) == want for x, want in got)
    numbers = values(spark, [("Up 1,000.5, then 2. and 2.",), (None,)], "a string", scalars.fingerprint_numbers(F.col("a")))
    assert numbers == [(["1,000.5", "2"],), ([],)]


def test_titles(spark):
    cases = [
        ("Oil jumps -Reuters", "oil jumps"), ("Oil jumps - Reuters", "oil jumps"), ("Oil jumps | Al Jazeera", "oil jumps"), ("Oil “jumps” – reuters.com", "oil jumps"),
        ("Iran - what happens next in the long war over enrichment", "iran what happens next in the long war over enrichment"), (None, ""),
    ]
    got = values(spark, cases, "a string, want string", scalars.normalise_title(F.col("a")), "want")
    assert all(x == want for x, want in got)
    pairs = [("Oil jumps on news - Reuters", "Oil jumps on news | BBC", True), ("", None, False), ("- BBC", "- BBC", False), ("Oil jumps", "Gold falls", False)]
    got = values(spark, pairs, "a string, b string, want boolean", predicates.is_syndication(F.col("a"), F.col("b")), "want")
    assert all(x == want for x, want in got)


def test_quote_pages(spark):
    cases = [
        ("AAPL.O - Reuters", True), ("About Apple (AAPL.O) - Reuters", True), ("DFTKn.H - Reuters", True), ("Apple Stock Price &amp; Latest News", True),
        ("Iran", False), ("Rally", False), ("Breakingviews - Reuters", False), ("About 100 killed - Reuters", False), ("", False), (None, False),
    ]
    got = values(spark, cases, "a string, want boolean", predicates.is_quote_page(F.col("a")), "want")
    assert all(x == want for x, want in got)


@pytest.mark.parametrize("k", [3, 40])
def test_trigram_top_k(spark, k):
    rng = random.Random(1)
    name = lambda: " ".join(rng.choice(["ring", "rings", "bolt", "plate", "xq", "ö"]) for _ in range(rng.randint(1, 2)))
    c = [(i, rng.randint(0, 5), name()) for i in range(60)] + [(90, 9, None), (91, 9, "")]
    q = [(100 + i, name()) for i in range(6)] + [(200, None), (201, "zzz")]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in (t or "").split() for i in range(len(w) + 1)}

    def score(a, b):
        return round(len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b))), 9)

    want = []
    for qid, t in q:
        best = sorted(c, key=lambda r: (score(t, r[2]), r[1], r[0]), reverse=True)[:k]
        want += [(qid, r[0], n + 1) for n, r in enumerate(best)]
    got = joins.trigram_top_k(spark.createDataFrame(q, "qid long, text string"), spark.createDataFrame(c, "cid long, recency long, text string"), "qid", "cid", k)
    assert sorted((r.qid, r.cid, r.rank) for r in got.collect()) == sorted(want)


def test_pair_recall(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.randint(0, 12), rng.randint(0, 3), rng.randint(0, 6)) for _ in range(60)]
    own = {r[:3] for r in rows}
    pairs = [(a, b) for a in own for b in own if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]]
    events = {}
    for r in rows:
        events.setdefault(r[1], set()).add(r[3])
    linked = {(a[0], a[1], b[1]) for a, b in pairs if events[a[1]] & events[b[1]]}
    df = spark.createDataFrame(rows, "grp int, item int, outlet int, event int")
    got = stats.pair_recall(df, df.select("item", "event"), "grp", "item", "outlet").first()
    assert (got.pairs, got.linked) == (len(pairs), len(linked))
    none = stats.pair_recall(df.limit(0), df.select("item", "event").limit(0), "grp", "item", "outlet").first()
    assert (none.pairs, none.linked, none.recall) == (0, 0, None)


def test_volume_alerts_of_a_batch(spark):
    rng, start, rows = random.Random(3), dt.datetime(2024, 1, 1), []
    for key in "ab":
        for i in range(150):
            rows.append((key, start + dt.timedelta(hours=i), float(rng.choice([1, 1, 2, 2, 3, 9]))))
    want = []
    for key in "ab":
        samples, last = [], None
        for _, at, v in sorted(r for r in rows if r[0] == key):
            if len(samples) >= 5 and v >= 2.5 * sum(samples) / len(samples) and (last is None or at - last >= dt.timedelta(hours=12)):
                want.append((key, at, v, round(v / (sum(samples) / len(samples)), 9)))
                last = at
            if not samples or samples[-1] != v:
                samples = (samples + [v])[-20:]
    got = monitors.volume_alerts(spark.createDataFrame(rows, "user string, ts timestamp_ntz, value double"), "user", "ts", "value").collect()
    assert want and sorted((r.user, r.at, r.value, round(r.ratio, 9)) for r in got) == sorted(want)
