"""What the findings of round 3 named: small inputs on which the code before them failed."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import predicates
from tidewater.llm import lshforest
from tidewater.operators import graph, integration, joins, knowledge, ledgers, passes, state, stats, topk, windows
from tidewater.plans import catalog, intake, matching  # noqa: F401
from tidewater.plans import knowledge as plans
from tidewater.sources import readers
from tidewater.streaming import monitors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_single_items_are_packed_by_cluster(spark):
    rows = [(1, c, 7) for c in range(30, 0, -1)] + [(1, 50, 9), (1, 50, 8)]
    got = topk.pack_requests(spark.createDataFrame(rows, "w long, cluster long, item long").repartition(4), "w", "cluster", "item", 10)
    assert {(r.cluster, r.request) for r in got.collect()} == {(c, f"s{(c - 1) // 10}") for c in range(1, 31)} | {(50, "c50")}


def test_cooldown_counts_parts_of_a_second(spark):
    rows = spark.createDataFrame([("2024-01-15 00:00:00.000001",), ("2024-01-15 00:00:00",), ("noon",), (None,)], "at string")
    got = rows.select("at", predicates.in_cooldown(F.col("at"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("c")).collect()
    assert [r.c for r in got] == [True, False, False, False]


def test_closes_of_one_second(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 9, 0, 0)
    rows = [(1, at, 1, "view", 10.0, ""), (2, at, 1, "click", 8.0, ""), (3, at, 1, "error", 99.0, ""), (4, at, 3, "view", 6.0, ""), (5, at, 3, "click", 2.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["s20_s21_chart_closes"](spark, str(tmp_path))
    assert {(r.symbol, r.close) for r in got.collect()} == {(1, 8.0), (3, 3.0)}


def test_snap_forward_has_no_frame_to_the_end(spark):
    left = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1)), ("a", 2, dt.date(2024, 1, 1)), ("a", 3, None), (None, 4, dt.date(2024, 1, 1)), ("b", 5, dt.date(2024, 1, 2))], "k string, id long, t date")
    right = spark.createDataFrame([("a", dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 9)), ("b", dt.date(2024, 1, 1)), ("b", dt.date(2024, 1, 2))], "k string, u date")
    got = joins.asof_forward(left, right, ["k"], "t", "u", 4)
    assert {r.id: r.snapped for r in got.collect()} == {1: dt.date(2024, 1, 3), 2: dt.date(2024, 1, 3), 3: None, 4: None, 5: dt.date(2024, 1, 2)}
    assert "unboundedfollowing" not in plan(got)


def test_similar_pairs_are_not_dealt_again(spark):
    rows = spark.createDataFrame([(k, ("large ring", "large rings", "hot bolt", "")[k % 4]) for k in range(40)], "id long, x string")
    got = joins.similar_pairs(rows, "id", "x", 0.7)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 < 3 and (a % 4 == b % 4 or {a % 4, b % 4} == {0, 1})}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    top = plan(got).split("Join")[0]
    assert "Aggregate" not in top and "Deduplicate" not in top
    twice = rows.unionByName(rows)
    assert sorted((r.a, r.b) for r in joins.similar_pairs(twice, "id", "x", 0.7).collect()) == sorted(want)


def test_probable_misses_compare_classes(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, k % 2, k % 3, at + dt.timedelta(hours=k), "large ring" if k % 5 else "hot bolt") for k in range(60)], "e long, k long, o long, t timestamp_ntz, x string")
    got = knowledge.probable_misses(rows, "k", "e", "o", "t", "x", 10, 0.5)
    want = {(a, b) for a in range(60) for b in range(a + 1, min(60, a + 11)) if a % 2 == b % 2 and a % 3 != b % 3 and (a % 5 > 0) == (b % 5 > 0)}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    assert "Aggregate" not in plan(got).split("Join")[0]


def test_like_queries_are_ranked_once(spark):
    rng = random.Random(3)
    texts = ["gold price", "gold mine", "oil price rises", None]
    q = spark.createDataFrame([(k, k % 2, texts[k % 3]) for k in range(12)] + [(50, 0, None)], "query long, b long, text string")
    c = spark.createDataFrame([(k, rng.randrange(6), k % 2, texts[k % 4]) for k in range(40)], "candidate long, recency long, b long, candidate_text string")
    names = ["recency", "tokens", "trigrams", "hybrid"]
    got = knowledge.ranked_pool(q, c, "query", ["b"], ["text"], ["candidate_text"], names)
    want = knowledge.ranked(q.join(c, "b"), "query", names).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 13 * 20
    assert plan(got).count("Join ") <= 3 < plan(want).count("Join ")
    best = knowledge.best_of(knowledge.ranked_pool(q, c, "query", ["b"], ["text"], ["candidate_text"], names, most=3), "query", names, 3)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, knowledge.bake_off(q.join(c, "b"), "query", names, most=3).collect()))


@pytest.mark.parametrize("odd", [False, True])
def test_visibility_is_counted_without_pairs(spark, monkeypatch, odd):
    rng = random.Random(7)
    at = dt.datetime(2024, 1, 1)
    rows = [(k // 60, k, rng.choice([1, 2, None]), k // 30, rng.choice(["x", "y", "z", None]), at + dt.timedelta(minutes=k)) for k in range(150)]
    rows += [(0, 3, 2, 1, "y", at)] if odd else []
    rows = spark.createDataFrame(rows, "window long, item long, user_id long, hour long, kind string, at timestamp_ntz")
    placed = graph.seed_star(rows.select("window", "item"), graph.shared_key_edges(rows, "window", "item", "user_id"))
    want = knowledge.visibility(placed, joins.pairs_by_key(rows, "hour", "item", "kind", "at").select("a", "b"), "window").collect()
    if not odd:
        assert sorted(map(tuple, graph.key_stars(rows, "window", "item", "user_id").select(placed.columns).collect())) == sorted(map(tuple, placed.collect()))
        monkeypatch.setattr(graph, "shared_key_edges", None)
    assert knowledge.key_visibility(rows, "window", "item", "user_id", "hour", "kind", "at").collect() == want


def test_visibility_query_makes_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "shared_key_edges", None)
    assert plans.l21(spark, "/root/testdata/sf0.001").count() == 1


def test_means_are_summed_from_the_newest_sample(spark):
    rng = random.Random(5)
    while True:
        v = [rng.randrange(100, 9000) / 100 for _ in range(20)]
        up, down = 0.0, 0.0
        for x, y in zip(v, v[::-1]):
            up, down = up + x, down + y
        last = round(2.5 * up / 20, 2)
        if (last >= 2.5 * (up / 20)) != (last >= 2.5 * (down / 20)) and len(set(v)) == 20 and all(b < 2.5 * (sum(v[:k]) / k) for k, b in enumerate(v) if k >= 5):
            break
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), x) for k, x in enumerate([*v, last])]
    got = monitors.volume_alerts(spark.createDataFrame(rows, "k long, t timestamp, v double"), "k", "t", "v").collect()
    assert len(got) == int(last >= 2.5 * (down / 20))


def test_claims_meet_by_numbers_and_words(spark):
    rng = random.Random(4)
    claim = lambda: " ".join(rng.sample("oil gold rates trade price output falls rises again china".split(), rng.randrange(1, 5))) + rng.choice(["", " 5", " 7"])
    prior = [("L", f"c-{k:04d}", claim()) for k in range(9990, 10040)]
    reply = [("L", k, rng.choice([None, None, None, f"c-{rng.randrange(9990, 10050):04d}"]), rng.choice([claim(), claim(), claim(), ""]), rng.choice(["fact", "observation"])) for k in range(200)]
    words = lambda t: {w for w in t.split() if not w.isdigit()}
    same = lambda a, b: a[-1:].isdigit() * a[-1:] == b[-1:].isdigit() * b[-1:] and len(words(a) & words(b)) >= 0.85 * len(words(a) | words(b))
    old, given, want, number = dict(r[1:] for r in sorted(prior, key=lambda r: r[1])), {}, [], 10040
    for _, _, name, text, kind in reply:
        twin = next((i for i in sorted(old) if i not in given and same(text, old[i])), None)
        if name in old:
            want.append((name, text, "reaffirm"))
            given[name] = old[name]
        elif not text:
            continue
        elif any(same(text, g) for g in given.values()):
            want.append((None, text, "repeat"))
        elif twin:
            want.append((twin, text, "reuse"))
            given[twin] = old[twin]
        elif kind == "observation":
            want.append((None, text, "reject"))
        else:
            want.append((f"c-{number:04d}", text, "new"))
            given[want[-1][0]] = text
            number += 1
    got = state.merge_claims(spark.createDataFrame(prior, "ledger string, id string, claim string"), spark.createDataFrame(reply, "ledger string, pos int, id string, claim string, kind string"))
    assert sorted((r.id, r.claim, r.action) for r in got.collect() if r.id) == sorted(w for w in want if w[0])
    assert sorted((r.claim, r.action) for r in got.collect() if not r.id) == sorted(w[1:] for w in want if not w[0])
    assert "FlatMapGroupsInPandas [ledger" in plan(got) and "n#" in plan(got).split("FlatMapGroupsInPandas [")[1].split("]")[0]


def test_edges_are_cut_to_a_forest(spark):
    name = lambda k: k.to_bytes(4, "big")
    edges = [(name(tree + 1000 * group), name(1000 * group + k)) for group in range(3) for tree in range(20) for k in range(tree + 1, 400)]
    edges = spark.createDataFrame(edges, "src binary, dst binary")
    few = lshforest.spanning(edges)
    assert few.count() <= 2 * 1200 < edges.count()
    ends = lambda df: sorted((bytes(r.id), bytes(r.component)) for r in graph.connected_components(df).collect())
    assert ends(few) == ends(edges)


def test_components_are_contracted(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(8), 1000 + k) for k in range(200) for _ in range(4)] + [(2000 + k, 2001 + k) for k in range(20)]
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 2000 if k >= 2000 else 0 for e in edges for k in e}
    left = [df.count() for df in sizes if df.columns == ["a", "b"]]
    assert left[0] == len(set(edges)) and left[-1] == 0 and sum(left[1:]) < left[0] / 10


def test_best_passages_are_cut_before_they_are_dealt_out(spark):
    rows = [(t, k, k % 5, "x" * 600) for k in range(60) for t in ("en", "fr", "de", None)]
    passages = spark.createDataFrame(rows, "topic string, passage_id long, score long, text string").repartition(3)
    topics = spark.createDataFrame([("fr", 1), ("en", 2)], "topic string, n int")
    got = knowledge.topic_context(passages, topics.filter("n = 1"), topics.filter("n = 2"))
    best = [4, 9, 14]
    assert {(r.topic, r.passage_id, len(r.text)) for r in got.collect()} == {(t, k, 500) for t, n in (("en", 3), ("de", 2), (None, 2)) for k in best[:n]}
    assert "WindowGroupLimit" in plan(got)


def test_a_key_is_ranked_by_many_tasks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(40))]), k) for k in range(500)]
    want = {}
    order = lambda v: (v is not None, v != v, v if v == v else 0)
    for k, v, i in rows:
        peers = [x for q, x, _ in rows if q == k]
        want[i] = sum(order(x) < order(v) if v is not None else 0 for x in peers) + (sum(order(x) == order(v) if None not in (x, v) else x is v for x in peers) + 1) / 2
    got = windows.average_ranks(spark.createDataFrame(rows, "k string, v double, id long").repartition(3), ["k"], "v")
    assert {r.id: r["rank"] for r in got.collect()} == want and got.columns == ["k", "v", "id", "rank"]
    assert "rank(" not in plan(got)
    assert windows.average_ranks(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_candidates_meet_by_spans_of_time(spark):
    rng = random.Random(9)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 90))
    events = [(k, at(), at()) if k % 3 else (k, *[at()] * 2) for k in range(150)] + [(150, None, at())]
    links = [(k, rng.randrange(6)) for k in range(151) for _ in range(3)]
    when = {r: at() for r in range(40)}
    wanted = [(r, rng.randrange(6), when[r]) for r in range(40) for _ in range(2)]
    sets = {k: {e for x, e in links if x == k} for k in range(151)}
    need = {r: {e for x, e, _ in wanted if x == r} for r in when}
    want = {(r, k) for r, t in when.items() for k, o, c in events if o and c < t and o >= t - dt.timedelta(days=14) and sets[k] & need[r]}
    asked = spark.createDataFrame(wanted, "request long, entity long, at timestamp_ntz")
    pool = integration.candidate_pool(spark.createDataFrame(events, "event long, occurred_at timestamp_ntz, created_at timestamp_ntz"), spark.createDataFrame(links, "event long, entity long"), asked)
    assert sorted((r.request, r.event) for r in pool.collect()) == sorted(want)
    assert "_span" in plan(pool)
    got = integration.batch_overlap(pool, asked, 500)
    assert {(r.request, r.event): r.overlap for r in got.collect()} == {(r, k): len(sets[k] & need[r]) for r, k in want}
    assert "Generate" not in plan(integration.batch_overlap(pool.limit(5), asked, 5)).split("GlobalLimit")[0]


def test_event_lines_are_split_once(spark):
    lines = spark.range(4).select(F.array_join(F.array(*[F.lit("20240102" if k == 1 else "7") for k in range(58)]), "\t").alias("x"), "id").select(F.concat("x", F.col("id").cast("string")).alias("value"))
    got = readers.typed_event_rows(lines)
    assert got.count() == 4 and plan(got).count("split(") == 1


def test_both_kinds_of_visibility_in_one_pass(spark):
    got = catalog.queries()["g07_g08_visible"](spark, "/root/testdata/sf0.001")
    assert plan(got).count("Relation ") <= 3 and got.first().pairs > 0


def test_forms_meet_distinct_words(spark):
    items = spark.createDataFrame([(1, "Red ring red"), (2, "hot red bolt ring"), (3, None), (4, ""), (1, "red")], "item long, text string")
    forms = spark.createDataFrame([("R", "red"), ("R", "RED"), ("B", "red bolt"), ("S", "ring"), ("N", "bolt red"), ("E", " ")], "entity string, form string")
    got = joins.dictionary_hits(items, forms)
    assert sorted(map(tuple, got.collect())) == [(1, "R"), (1, "S"), (2, "B"), (2, "R"), (2, "S")]
    single = joins.dictionary_hits(items, forms.filter("entity <> 'B' AND entity <> 'N'"))
    assert sorted(map(tuple, single.collect())) == [(1, "R"), (1, "S"), (2, "R"), (2, "S")]
    assert "slice(words" not in plan(single)


@pytest.mark.parametrize("a, b, n", [([1, 2, 2], [2, 3], 3), ([], [], 0), ([1], [1], 0)])
def test_differing_hits_are_counted_in_one_pass(spark, a, b, n):
    side = lambda x: spark.createDataFrame([(k, "e") for k in x], "item long, entity string")
    got = knowledge.differing_hits(side(a), side(b))
    assert got.first().differ == n
    assert plan(got).count("LogicalRDD") <= 2 and "Generate" not in plan(got)


@pytest.fixture
def told():
    """(rows g, item, outlet; links item, event; the linked pairs g, i, j): groups and events of 1 to 20 items."""
    rng = random.Random(15)
    rows = [(g, rng.randrange(30), rng.randrange(3)) for g in range(12) for _ in range(1 + g * 2)] + [(None, 1, 1), (1, None, 1), (2, 2, None), (3, 4, 1), (3, 4, 1)]
    links = [(rng.randrange(30), e) for e in range(14) for _ in range(1 + e)] + [(None, 1), (1, None), (2, None), (4, 3), (4, 3)]
    events = {k: {e for i, e in links if i == k and e is not None} for k in range(30)}
    members = {}
    for g, i, _ in rows:
        if g is not None and i is not None:
            members.setdefault(g, set()).add(i)
    return rows, links, members, {(g, i, j) for g, m in members.items() for i, j in itertools.combinations(sorted(m), 2) if events[i] & events[j]}


LIMITS = [(200, 200, 1000, 100_000), (200, 10, 1000, 100_000), (6, 10, 2, 5), (6, 200, 1000, 5), (200, 200, 1000, 5), (0, 0, 0, 0)]


def limit(monkeypatch, limits):
    for name, value in zip(("HOT_EVENT_ITEMS", "LARGE_GROUP_ROWS", "MANY_GROUPS", "BUSY_ITEM_ROWS"), limits):
        monkeypatch.setattr(stats, name, value)


@pytest.mark.parametrize("limits", LIMITS)
def test_pair_recall_by_all_ways(spark, monkeypatch, told, limits):
    rows, links, _, linked = told
    limit(monkeypatch, limits)
    own = sorted({r for r in rows if None not in r})
    pairs = [(x, y) for x, y in itertools.combinations(own, 2) if x[0] == y[0] and x[1] != y[1] and x[2] != y[2]]
    df = stats.pair_recall(spark.createDataFrame(rows, "g long, item long, outlet long"), spark.createDataFrame(links, "item long, event long"), "g", "item", "outlet")
    got = df.first()
    assert (got.pairs, got.linked) == (len(pairs), len({(x[0], x[1], y[1]) for x, y in pairs} & linked))
    # Pairs of small groups carry no lists of their items' groups.
    assert ("array_intersect" in plan(df)) == (limits[1] < 200)


@pytest.mark.parametrize("limits", LIMITS)
def test_bcubed_recall_by_all_ways(spark, monkeypatch, told, limits):
    rows, links, members, linked = told
    limit(monkeypatch, limits)
    df = stats.bcubed_recall(spark.createDataFrame(rows, "g long, item long, outlet long"), spark.createDataFrame(links, "item long, event long"), "g", "item")
    got = df.first()
    shares = [(1 + sum((g, *sorted((i, j))) in linked for j in m)) / len(m) for g, m in members.items() for i in m]
    assert got["items"] == len(shares) and abs(got.recall - sum(shares) / len(shares)) < 1e-9
    assert ("array_intersect" in plan(df)) == (limits[1] < 200)


def test_actions_are_judged_once(spark):
    rng = random.Random(20)
    pick = lambda n: rng.choice([None, *range(n)]) if rng.random() < 0.1 else rng.randrange(n)
    actions = [(rng.randrange(4), pick(2), pick(3), rng.randrange(3), pick(9), pick(4), rng.choice([None, True, False])) for _ in range(150)]
    members = {(w, i) for w in range(4) for i in range(9) if rng.random() < 0.9}
    groups = {(w, g) for w in range(4) for g in range(4) if rng.random() < 0.8}
    log = [(rng.randrange(4), pick(2), pick(3), pick(9)) for _ in range(10)]
    states = [(0, "prepared", None, None), (1, "open", False, 7), (2, "complete", False, None)]
    told = {}
    for a in actions:
        told.setdefault(a[:4], []).append(a[4:])
    refused, fitting = set(), {}
    for k, rows in told.items():
        items = [r[0] for r in rows]
        why = "closed" if k[0] > 1 else "repeated_item" if len(set(items)) < len(items) else "foreign_item" if {(k[0], i) for i in items} - members else None
        why = why or ("foreign_group" if any(r[1] is not None and (k[0], r[1]) not in groups for r in rows) else None)
        if why:
            refused.add((*k, why))
            continue
        for r in rows:
            if (*k[:3], r[0]) not in {x for x in log if None not in x}:
                fitting.setdefault((*k[:3], r[0]), []).append((k[3], r[1], r[2] or False))
    fits = [k for k in told if not any(r[:4] == k for r in refused)]
    frame = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    got = ledgers.append_assignments(
        frame(log, "window long, tab long, seq long, item long"), frame(actions, "window long, tab long, seq long, at long, item long, group long, unsure boolean"),
        frame(states, "window long, status string, blind_done boolean, opened_at long"), frame(members, "window long, item long"), frame(groups, "window long, group long"))
    first = lambda x: min(x, key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    assert {(r.window, r.tab, r.seq, r["item"]): (r["at"], r.group) for r in got.rows.collect()} == {k: first(x)[:2] for k, x in fitting.items()}
    assert sorted(map(str, map(tuple, got.refused.collect()))) == sorted(map(str, refused))
    opened = {w: min(k[3] for k in fits if k[0] == w) for w in {k[0] for k in fits}}
    assert {(r.window, r.status, r.opened_at) for r in got.windows.collect()} == {(w, "open", 7 if w == 1 else at) for w, at in opened.items()}
    # The three results are read from what was judged, not judged again.
    assert "Join" not in plan(got.rows) + plan(got.refused) and "Aggregate" not in plan(got.rows) + plan(got.refused)


def test_names_of_a_batch_are_told_once(spark):
    items = spark.createDataFrame([(1, "a", 0, None), (1, "b", 1, None), (1, "c", 2, None), (1, "d", 3, None)], "request long, item string, position long, published_at timestamp")
    events = [("a", 0, None, None, "x", True), ("b", 0, None, "x", "y", True), ("b", 1, "7", None, None, True), ("c", 0, None, "y", None, True), ("c", 1, None, None, "x", False), ("d", 0, None, "z", None, True)]
    events = spark.createDataFrame([(i, p, c, r, n, "", "t", "s", v) for i, p, c, r, n, v in events], "item string, position long, candidate_id string, new_ref string, new_label string, summary string, type string, standing string, valid boolean")
    entities = spark.createDataFrame([(i, 5) for i in "abcd"], "item string, entity long")
    got = passes.resolved_batch(items, events, entities, items.select("item").limit(0), F.lit("2024-01-01").cast("timestamp"))
    assert {r["item"]: (r.status, [e.event for e in r.events]) for r in got.collect()} == {"a": ("written", ["a#0"]), "b": ("written", ["a#0", "7"]), "c": ("rejected", ["a#0", "c#1"]), "d": ("deferred", [None])}
    assert plan(got).count("element_at(") == 1
