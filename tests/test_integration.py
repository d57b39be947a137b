"""Triage, candidates, ceilings and reports on small tables, with nulls, ties and empty ones."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import integration as ig


def test_triage_takes_the_first_rule(spark):
    hits = spark.createDataFrame([(1, "named", 0, "a"), (1, "tracked_story", 2, "b"), (1, "tracked_claim", 1, "c"), (2, "named", 0, "d"), (3, None, 0, "e")], "item int, reason string, pos int, form string")
    got = ig.triage_by_rules(hits, "item", "reason", ["pos"], ["form"]).collect()
    assert [tuple(r) for r in got] == [(1, "tracked_claim", "c")]


def test_entity_prefers_public_and_then_position(spark):
    rows = spark.createDataFrame(
        [(1, "abc", "ABC", None, "x", 0), (1, "abc", "abc", "PUBLIC", "y", 1), (1, "abc", "ABCD", "PUBLIC", "z", 2), (2, "q", None, "PUBLIC", "n", 0), (3, "k", "K", "PRIVATE", "k1", 1), (3, "k", "K", None, "k0", 0)],
        "request int, wanted string, ticker string, kind string, id string, pos int",
    )
    got = {r.request: r.id for r in ig.picked_entity(rows, "request", "wanted", "ticker", "kind", "id", "pos").collect()}
    assert got == {1: "y", 3: "k0"}


def pool_tables(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    events = spark.createDataFrame([(1, day(20), day(20)), (2, day(1), day(1)), (3, day(19), day(25)), (4, day(18), day(18))], "event int, occurred_at timestamp, created_at timestamp")
    links = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "b"), (4, "c"), (4, None)], "event int, entity string")
    wanted = spark.createDataFrame([(7, "a", day(22)), (7, "b", day(22)), (8, None, day(22))], "request int, entity string, at timestamp")
    return events, links, wanted


def test_pool_and_overlap(spark):
    events, links, wanted = pool_tables(spark)
    pool = ig.candidate_pool(events, links, wanted)
    assert {(r.request, r.event, tuple(r.entities)) for r in pool.collect()} == {(7, 1, ("a", "b")), (7, 4, ("b", "c"))}
    ranked = ig.batch_overlap(pool, spark.createDataFrame([(7, "c"), (7, "b"), (7, "b")], "request int, entity string"), 1).collect()
    assert [(r.event, r.overlap) for r in ranked] == [(4, 2)]
    assert ig.batch_overlap(pool, wanted.limit(0), 5).select("overlap").distinct().collect()[0].overlap == 0
    assert ig.candidate_pool(events.limit(0), links, wanted).count() == 0


def test_candidate_entities_are_capped_at_the_newest(spark):
    hits = spark.createDataFrame([("x", 1), ("x", 3), ("x", 3), ("x", 2), ("y", 5), ("z", None)], "batch string, entity int")
    got = {(r.batch, r.entity, r.capped) for r in ig.candidate_entities(hits, "batch", "entity", 2).collect()}
    assert got == {("x", 3, True), ("x", 2, True), ("y", 5, False)}


def test_ceiling(spark):
    events = spark.createDataFrame([(i,) for i in range(1, 7)], "event int")
    outlets = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (3, "q"), (4, "r"), (5, "r")], "event int, outlet string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a int, b int")
    got = ig.outlet_ceiling(pairs, outlets, events).collect()[0]
    assert (got.events_after, got.multi_after) == (3, 1)  # 1-2-3 become one, 4-5 one with one outlet, 6 stays
    none = ig.outlet_ceiling(pairs.limit(0), outlets, events).collect()[0]
    assert (none.events_after, none.multi_after) == (6, 1)
    empty = ig.outlet_ceiling(pairs.limit(0), outlets.limit(0), events.limit(0)).collect()[0]
    assert (empty.rate, empty.events_after, empty.multi_after) == (0.0, 1, 0)


def test_grid_halves_and_last_run(spark):
    cells = spark.createDataFrame([("s", "tone", 1, 0.05, 0.6, 9, 1), ("s", "count", 2, 0.05, 0.6, 9, 1), ("t", "tone", 3, None, None, 4, 1), ("u", "tone", 1, 0.02, 0.5, 5, 1)], "symbol string, field string, best_horizon int, ic double, hit_rate double, n int, expected_sign int")
    grid = {(r.symbol, r.field): (r.n, r.sign_ok) for r in ig.scored_grid(cells, ["symbol", "field"], F.col("field") == "tone").collect()}
    assert grid == {("s", "tone"): (9, "yes"), ("s", "count"): (9, None), ("t", "tone"): (0, None), ("u", "tone"): (5, "no")}
    w = spark.createDataFrame([(1, 1, "complete", 4, 2, 1, 2), (2, 2, "complete", 9, 9, 9, 9), (None, 1, "complete", 9, 9, 9, 9)], "start int, pass int, status string, items int, multi int, yes int, asked int")
    halves = {r.half: (r.windows, r.mean_items, r.yes, r.asked) for r in ig.half_split(w, F.lit(3)).collect()}
    assert halves == {"before": (1, 4.0, 1, 2), "after": (0, None, 0, 0)}
    runs = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id int, at int")
    assert [r.id for r in ig.last_run(runs, "at", "id").collect()] == [2]
    assert ig.last_run(runs.limit(0), "at", "id").count() == 0


def test_report_and_replay(spark):
    kind = "date string, n_claims int, counts map<string,int>, claims array<struct<verdict:string,reason:string>>"
    records = spark.createDataFrame([("d1", 3, {"supported": 1, "contradicted": 2}, [("supported", None), ("contradicted", " "), ("contradicted", "why")]), ("d2", None, None, None)], kind)
    got = ig.verification_report(records).collect()[0]
    assert (got.days, got.n_claims, got.contradicted, got.overstated, got.flagged_total, got.unreasoned_flags, got.unreasoned_rate) == (2, 3, 2, 0, 2, 1, 0.5)
    none = ig.verification_report(records.limit(0)).collect()[0]
    assert (none.days, none.n_claims, none.flag_rate) == (0, 0, 0.0)
    rows = spark.createDataFrame([(1,), (2,), (3,)], "at int")
    assert ig.replayed(lambda r: r.agg(F.max("at").alias("m")), rows, "at", F.lit(2)).collect()[0].m == 2
