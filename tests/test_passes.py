"""Budget, triage pass, knowledge writes and density sweep, held against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewater.operators import passes as ps

NOW = dt.datetime(2024, 5, 2)


def test_budget_accrues_up_to_its_cap_and_starts_afresh(spark):
    rows = [("a", "1.0", "2024-05-01 00:00:00"), ("b", "9.5", "2024-04-01 00:00:00"), ("c", "nan", "2024-05-01 00:00:00"), ("d", None, None), ("e", "-1.5", "2024-05-03 00:00:00"), ("f", "x", "2024-05-01 00:00:00"), ("g", "Infinity", "2024-05-01 00:00:00"), ("h", "2", "yesterday-ish")]
    state = spark.createDataFrame([(*r, "2024-04-30") for r in rows], "key string, balance string, at string, exhausted_on string")
    got = {r.key: (r.balance, r.exhausted_on) for r in ps.open_budget(state, F.lit(NOW), 4.0, 2.5).collect()}
    assert got == {"a": (5.0, "2024-04-30"), "b": (10.0, "2024-04-30"), "c": (4.0, None), "d": (4.0, None), "e": (-1.5, "2024-04-30"), "f": (4.0, None), "g": (4.0, None), "h": (4.0, None)}
    assert ps.open_budget(state.limit(1), F.lit(NOW), 4.0, 0.5).collect()[0].balance == 2.0
    assert ps.open_budget(state.limit(0), F.lit(NOW), 4.0, 0.5).count() == 0


def test_pass_follows_the_order_of_rules_and_stops_when_spent(spark):
    pending = spark.createDataFrame([("k", i, i == 9, i in (8, 9)) for i in range(1, 10)] + [("k", 1, None, None), ("z", 20, None, None)], "key string, item int, stale boolean, quote boolean")
    rules = spark.createDataFrame([(7, "tracked_story"), (7, "tracked_claim"), (8, "tracked_claim")], "item int, reason string")
    replies = spark.createDataFrame([(6, True, None, "0.4"), (5, None, False, "0.4"), (4, True, True, "0.1"), (3, True, False, "0.2"), (2, True, False, "1"), (20, True, False, "1")], "item int, material boolean, failed boolean, cost string")
    budget = spark.createDataFrame([("k", 1.1)], "key string, balance double")
    got = {r.item: (r.verdict, r.reason) for r in ps.triage_pass(pending, rules, replies, budget, 2).collect()}
    assert got == {9: ("stale", "stale"), 8: ("immaterial", "quote_page"), 7: ("material", "tracked_claim"), 6: ("material", "topical"), 5: ("immaterial", "none"), 4: ("failed", "error"), 3: ("failed", "error")}
    assert {r.item for r in ps.triage_pass(pending, rules, replies, budget, 2, most=4).collect()} == {9, 8, 7, 6}
    assert ps.triage_pass(pending.limit(0), rules, replies, budget, 2).count() == 0


def brute(items, events, entities, done):
    """Item by item, as one writer would."""
    status, links, told, labels = {}, set(), {}, {}
    for request, item, _, _ in sorted(items, key=lambda r: (r[0], r[2], r[1])):
        seen = labels.setdefault(request, {})
        ev = sorted((e for e in events if e[0] == item), key=lambda e: e[1])
        offered = [n for i, n in entities if i == item]
        named = [e[2] and str(e[2]) or (seen.get(e[3]) if e[3] else f"{item}#{k}") for k, e in enumerate(ev)]
        if item in done:
            status[item] = "already"
        elif None in named:
            status[item] = "deferred"
        elif not offered and not ev:
            status[item] = "empty"
        elif not offered and any(not e[2] and not e[3] for e in ev):
            status[item] = "entityless"
        elif offered and not [n for n in offered if n]:
            status[item] = "refused"
        elif any(e[8] is False for e in ev):
            status[item] = "rejected"
        else:
            status[item] = "written"
            for e, name in zip(ev, named):
                if e[4]:
                    seen[e[4]] = name
                told.setdefault((item, name), e[7])
                links |= {(name, n) for n in offered if n}
    return status, links, told


def test_batch_writes_like_one_writer(spark):
    r = random.Random(7)
    items = [(n // 6, n, r.randrange(4), None) for n in range(240)]
    events = []
    for n in range(240):
        for p in range(r.choice([0, 1, 1, 2, 3])):
            kind = r.choice("cnnrr")
            events.append((n, p, r.randrange(1, 9) if kind == "c" else None, r.choice("xy") if kind == "r" else None, r.choice(["x", "y", None]), "s", "t", r.choice("abc"), r.choice([True] * 9 + [None, False])))
    entities = [(n, r.choice(["e", "f", "g", None])) for n in range(240) for _ in range(r.choice([0, 1, 2, 2]))]
    done = r.sample(range(240), 15)
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    ev = frame(events, "item long, position int, candidate_id long, new_ref string, new_label string, summary string, type string, standing string, valid boolean")
    it, en = frame(items, "request int, item long, position int, published_at timestamp"), frame(entities, "item long, entity string")
    batch = ps.resolved_batch(it, ev, en, frame([(d,) for d in done], "item long"), F.lit(NOW).cast("timestamp")).cache()
    status, links, told = brute(items, events, entities, set(done))
    assert {x.item: x.status for x in batch.collect()} == status
    assert set(status.values()) == {"already", "deferred", "empty", "entityless", "refused", "rejected", "written"}
    none = frame([], "event string, entity string"), frame([], "item long, event string")
    assert {tuple(x) for x in ps.new_links(batch, none[0]).collect()} == links
    assert {(x.item, x.event): x.standing for x in ps.new_assertions(batch, none[1]).collect()} == told
    fresh = ps.new_events(batch).collect()
    assert {x.event for x in fresh} == {e for (i, e) in told if e.startswith(f"{i}#")} and all(x.occurred_at == NOW for x in fresh)
    assert ps.new_links(batch, ps.new_links(batch, none[0])).count() == ps.new_assertions(batch, ps.new_assertions(batch, none[1])).count() == 0
    assert ps.resolved_batch(it.limit(0), ev, en, frame([], "item long"), F.lit(NOW).cast("timestamp")).count() == 0


def test_density_sweep(spark):
    items = spark.createDataFrame([(n, n // 10) for n in range(40)], "item int, hour int")

    def measure(kept):
        return kept.filter("item % 10 = 0").select(F.explode(F.array(F.lit("u"), F.lit("v"))).alias("variant"), (F.col("item") > 5).alias("baseline"), "item").withColumn("visible", (F.col("variant") == "u") | (F.col("item") > 15)).drop("item")

    got = {(r.rate, r.variant): r for r in ps.density_sweep(items, F.col("item") % 10 == 0, F.col("hour"), [2, 50], ["a", "b"], measure).collect()}
    assert (got[2, "u"].per_hour, got[50, "v"].per_hour) == (3.0, 10.0)
    assert (got[2, "v"].baseline, got[2, "v"].share, got[2, "v"].gap, got[2, "v"].within) == (0.75, 0.5, -0.25, False)
    assert got[50, "u"].within and got[50, "u"].baseline_min == got[50, "u"].baseline_max == 0.75
