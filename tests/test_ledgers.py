"""Writes with rules, table sets, the day cache, and the mechanisms behind clustering, pair recall and rankings, against plain versions."""

import datetime as dt
import itertools
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import census, graph, joins, knowledge, ledgers, state, stats, windows
from tidewater.sources import daily, tableset
from tidewater.streaming import monitors


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tables_change_together(spark, tmp_path):
    tables = tableset.TableSet(spark, f"file://{tmp_path}")
    a, b = spark.range(3), spark.range(5).withColumnRenamed("id", "k")
    assert tables.version() == 0 and tables.state() == {}
    assert tables.commit(replaced={"a": a, "b": b.limit(0)}) == 1
    old = tables.read("b")
    assert tables.commit(appended={"b": b, "a": a}) == 2
    assert (tables.read("a").count(), tables.read("b").count(), old.count()) == (6, 5, 0)
    assert tables.read("a", 1).count() == 3
    # A run that dies while its second table is written shows neither of them.
    broken = b.withColumn("k", F.raise_error(F.lit("the run dies")).cast("long"))
    with pytest.raises(Exception, match="dies"):
        tables.commit(replaced={"a": spark.range(100), "b": broken})
    assert tables.version() == 2 and tables.read("a").count() == 6
    # Of two writers that start from one version the second is told and changes nothing.
    assert tables.commit(replaced={"a": spark.range(7)}, base=2) == 3
    with pytest.raises(tableset.Conflict):
        tables.commit(replaced={"a": spark.range(8)}, base=2)
    assert tables.read("a").count() == 7
    with pytest.raises(ValueError):
        tables.commit(appended={"a": b})
    assert len(tables.unreferenced()) >= 2 and tables.vacuum() >= 2 and tables.unreferenced() == []
    assert (tables.read("a", 2).count(), tables.read("b").count()) == (6, 5)


def test_census_is_frozen_once(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(k, "a title" if k % 11 else " ", k % 13 == 0, None if k % 5 == 0 else at(k / 4 - (30 if k % 7 == 0 else 1)), at(k / 4)) for k in range(4 * 24 * 14)]
    items = spark.createDataFrame(rows, "item long, title string, quote boolean, published timestamp, created timestamp")
    tables = tableset.TableSet(spark, f"file://{tmp_path}")
    span = census.block_of(dt.date(2024, 1, 18))
    assert span == (dt.date(2024, 1, 1), dt.date(2024, 1, 15))
    with pytest.raises(census.Refused):
        census.block_of(dt.date(2024, 1, 10), dt.date(2024, 1, 2))
    with pytest.raises(census.Refused):
        census.prepare(tables, items, *span, least=25)
    assert tables.version() == 0
    assert census.prepare(tables, items, *span, least=5) == "prepared"
    assert census.prepare(tables, items.limit(0), *span, least=5) == "already prepared"
    seen = census.frozen_windows(tables).collect()
    assert tables.version() == 1 and len(seen) == 17
    again = next(r for r in seen if r["pass"] == 2)
    first = next(r for r in seen if r.window == again.repeat_of)
    assert (again.window, again.start, again.members) == (17, first.start, first.members)
    for r in seen:
        own = [x for x in rows if r.start <= x[4].replace(tzinfo=dt.timezone.utc).timestamp() < r.start + 21600 and x[1].strip() and not x[2]]
        late = [x for x in own if x[3] is not None and x[4] - x[3] > dt.timedelta(hours=24)]
        assert (r.members, r.backlog_excluded) == (len(own) - len(late), len(late))
    tables.commit(replaced={"block": tables.read("block").limit(0)})
    with pytest.raises(census.Refused):
        census.prepare(tables, items, *span, least=5)


SPEC = "spec long, candidate long, name string, type string, aliases array<string>"


def test_entities_resolve_within_the_batch(spark):
    known = spark.createDataFrame([(5, "Apple", "company"), (9, "apple", "company"), (7, "Gold", "topic")], "entity long, name string, type string")
    symbols = spark.createDataFrame([(5, "AAPL"), (7, "GLD")], "entity long, symbol string")
    specs = [(1, 7, None, None, None), (2, None, "APPLE", "company", None), (3, None, "Zürich", "topic", ["ZH"]), (4, None, "zürich", "topic", None), (5, None, "aapl", "instrument", None), (6, None, "gld", "instrument", None), (7, None, None, "topic", None), (8, None, " ", "topic", None), (9, None, "Gold", "company", None), (10, None, "ZÜRICH", "company", None)]
    got = ledgers.resolve_entities(spark.createDataFrame(specs, SPEC), known, symbols)
    assert rows_of(got.resolved) == rows_of(spark.createDataFrame([(1, 7, "candidate"), (2, 5, "known"), (3, 10, "created"), (4, 10, "known"), (6, 11, "created"), (9, 12, "created"), (10, 13, "created")], "a long, b long, c string"))
    assert {(r.entity, r.name, r.type, tuple(r.aliases)) for r in got.created.collect()} == {(10, "Zürich", "topic", ("ZH",)), (11, "gld", "instrument", ()), (12, "Gold", "company", ()), (13, "ZÜRICH", "company", ())}
    assert {(r.spec, r.reason) for r in got.refused.collect()} == {(5, "company_symbol"), (7, "no_name"), (8, "no_name")}
    none = ledgers.resolve_entities(spark.createDataFrame([], SPEC), known.limit(0), symbols.limit(0))
    assert none.resolved.count() == none.created.count() == none.refused.count() == 0


def test_import_happens_once(spark):
    kind = "id string, status string, first_seen string, last string"
    rows = spark.createDataFrame([("c-1", "standing", "d1", None), ("c-2", "broken", "d1", None), (None, "standing", "d1", "d2"), ("c-1", "standing", "d0", None), ("c-4", None, "d1", "d1"), ("c-5", "odd", "d1", "d1")], kind)
    loads = spark.createDataFrame([], "load string, expected long, landed long, rejected long")
    checks = {"status": F.col("status").isin("standing", "broken")}
    load = lambda target, done: ledgers.import_once(target, rows, done, "old", "id", checks, {"last": F.coalesce("last", "first_seen")})
    got = load(rows.limit(0), loads)
    assert rows_of(got.landed) == [("c-1", "standing", "d0", "d0"), ("c-2", "broken", "d1", "d1")]
    assert sorted((str(r.key), r.reason) for r in got.rejected.collect()) == [("None", "no_key"), ("c-1", "repeated"), ("c-4", "status"), ("c-5", "status")]
    assert rows_of(got.record) == [("old", 6, 2, 4)]
    for again in (load(got.landed, loads), load(rows.limit(0), got.record)):
        assert again.landed.count() == again.rejected.count() == again.record.count() == 0


def test_assignment_log(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    kind = "window long, tab string, seq long, at timestamp, item long, group long, unsure boolean"
    actions = [
        (1, "a", 1, t(1), 10, 100, False), (1, "a", 1, t(1), 11, None, None),
        (1, "a", 1, t(2), 10, 101, True),  # a retry of the first action with other groups
        (1, "a", 2, t(3), 10, 100, True), (1, "a", 2, t(3), 99, 100, True),  # 99 is no member: the whole action goes
        (1, "b", 1, t(4), 10, 100, False), (1, "b", 1, t(4), 10, 101, False),  # an item twice
        (1, "b", 2, t(5), 10, 200, False),  # another window's group
        (2, "a", 1, t(6), 20, None, False), (3, "a", 1, t(7), 30, None, False), (9, "a", 1, t(8), 30, None, False),
        (1, "c", 5, t(9), 11, 101, True),  # logged before
        (4, None, None, t(9), 40, None, False),
    ]
    opened = spark.createDataFrame([(1, "prepared", False, None), (2, "complete", False, None), (3, "open", True, t(0)), (4, "open", None, t(0))], "window long, status string, blind_done boolean, opened_at timestamp")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (4, 40)], "window long, item long")
    groups = spark.createDataFrame([(1, 100), (1, 101), (2, 200)], "window long, group long")
    log = spark.createDataFrame([(1, "c", 5, 11)], "window long, tab string, seq long, item long")
    got = ledgers.append_assignments(log, spark.createDataFrame(actions, kind), opened, members, groups)
    rows = sorted((r.window, str(r.tab), r.seq or 0, r.item, r.group, r.unsure, r["at"].minute) for r in got.rows.collect())
    assert rows == [(1, "a", 1, 10, 100, False, 1), (1, "a", 1, 11, None, False, 1), (4, "None", 0, 40, None, False, 9)]
    assert sorted((r.window, r.seq, r.reason) for r in got.refused.collect()) == [(1, 1, "repeated_item"), (1, 2, "foreign_group"), (1, 2, "foreign_item"), (2, 1, "closed"), (3, 1, "closed"), (9, 1, "closed")]
    assert sorted((r.window, r.status, r.opened_at.minute) for r in got.windows.collect()) == [(1, "open", 1), (4, "open", 0)]


def test_adjudications(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    offered = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 5, 6), (3, 7, 8)], "window long, a long, b long")
    told = [(1, 2, 1, "same", t(2)), (1, 1, 2, "different", t(1)), (1, 2, 3, "maybe", t(1)), (1, 3, 9, "same", t(1)), (2, 6, 5, "unsure", t(3)), (3, 7, 8, None, t(1)), (2, 5, 6, "same", t(3))]
    decided = spark.createDataFrame([], "window long, a long, b long")
    open_ = spark.createDataFrame([(1, "open", None), (2, "open", None), (3, "open", None)], "window long, status string, completed_at timestamp")
    got = ledgers.adjudicate(decided, spark.createDataFrame(told, "window long, item_a long, item_b long, decision string, at timestamp"), offered, open_)
    assert sorted((r.window, r.a, r.b, r.decision) for r in got.rows.collect()) == [(1, 1, 2, "different"), (2, 5, 6, "same")]
    assert sorted((r.window, r.a, r.reason, r.n) for r in got.refused.collect()) == [(1, 1, "answered", 1), (1, 2, "unknown_decision", 1), (1, 3, "not_offered", 1), (2, 5, "answered", 1), (3, 7, "unknown_decision", 1)]
    assert [(r.window, r.status, r.completed_at.minute) for r in got.windows.collect()] == [(2, "complete", 3)]


def test_days_are_fetched_once(spark, tmp_path):
    raw, cache = tmp_path / "raw", f"file://{tmp_path}/cache"
    raw.mkdir()
    for k, day in enumerate(("20240101", "20240102", "20240104")):
        with zipfile.ZipFile(raw / f"{day}.zip", "w") as z:
            z.writestr("rows.csv", "\n".join(f"{day}\t{k}\t{i}" for i in range(k + 2)) + "\n\n")
    (raw / "20240105.zip").write_bytes(b"PK no archive")
    asked = []

    def load(days):
        asked.append(days)
        return daily.read_days(spark, f"file://{raw}/{{day}}.zip", days)

    first = daily.days_between(dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert daily.cached_scan(spark, cache, first, load).groupBy("day").count().orderBy("day").collect() == [("20240101", 2), ("20240102", 3)]
    week = daily.days_between(dt.date(2024, 1, 2), dt.date(2024, 1, 5))
    for _ in range(2):
        rows = daily.cached_scan(spark, cache, week, load)
        assert [(r.day, r["count"]) for r in rows.groupBy("day").count().orderBy("day").collect()] == [("20240102", 3), ("20240104", 4)]
    # Days that were there aren't asked for again; what can't be had stays missing.
    assert asked == [["20240101", "20240102"], ["20240103", "20240104", "20240105"], ["20240103", "20240105"]]
    assert daily.cached(spark, cache) == ["20240101", "20240102", "20240104"]
    assert daily.cached_scan(spark, cache, ["20230101"], load).count() == 0


def sequential(items, edges, cap, transitive):
    near, of = {}, {}
    for (w, a, b), s in edges.items():
        near.setdefault((w, a), []).append((-s, -b))
        near.setdefault((w, b), []).append((-s, -a))
    for w, seed in sorted(items, key=lambda x: -x[1]):
        if (w, seed) in of:
            continue
        of[w, seed], group, front = seed, 1, [seed]
        while front and group < cap:
            nxt = []
            for node in front:
                for _, o in sorted(near.get((w, node), [])):
                    if group < cap and (w, -o) not in of:
                        of[w, -o] = seed
                        group += 1
                        nxt.append(-o)
            front = nxt if transitive else []
    return of


@pytest.mark.parametrize("transitive,cap", [(False, 4), (True, 3)])
def test_clusters_by_rounds(spark, transitive, cap):
    rng = random.Random(cap)
    items = [(w, k) for w in (1, 2) for k in range(120)]
    edges = {}
    for _ in range(260):
        a, b = sorted(rng.sample(range(120), 2))
        edges[rng.choice((1, 2)), a, b] = rng.choice((0.0, 0.5, 0.9))
    want = sequential(items, edges, cap, transitive)
    rule = graph.capped_bfs if transitive else graph.seed_star
    i = spark.createDataFrame(items, "window long, item long")
    e = spark.createDataFrame([(*k, s) for k, s in edges.items()], "window long, a long, b long, weight double")
    for most in (graph.MOST_EDGE_ROWS, 40):
        assert {(r.window, r.item): r.cluster for r in rule(i, e, cap=cap, most=most).collect()} == want
    assert rows_of(rule(i, e.limit(0), cap=cap)) == sorted(((w, k, k) for w, k in items), key=str)


def test_pair_recall_with_hot_events(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.randrange(25), rng.randrange(3)) for _ in range(140)] + [(None, 1, 1), (1, None, 1), (2, 2, None)]
    links = [(k, rng.randrange(12)) for k in range(25) for _ in range(3)] + [(k, 100) for k in range(0, 25, 2)] + [(k, 101) for k in range(0, 25, 3)]
    own = {r for r in rows if None not in r}
    pairs = [(x, y) for x, y in itertools.combinations(sorted(own), 2) if x[0] == y[0] and x[1] != y[1] and x[2] != y[2]]
    events = {k: {e for i, e in links if i == k} for k in range(25)}
    linked = {(x[0], *sorted((x[1], y[1]))) for x, y in pairs if events[x[1]] & events[y[1]]}
    frame = spark.createDataFrame(rows, "g long, item long, outlet long")
    told = spark.createDataFrame(links, "item long, event long")
    for hot, many in ((200, 1000), (8, 1000), (8, 2), (1, 1)):
        monkeypatch.setattr(stats, "HOT_EVENT_ITEMS", hot)
        monkeypatch.setattr(stats, "MANY_GROUPS", many)
        got = stats.pair_recall(frame, told, "g", "item", "outlet").first()
        assert (got.pairs, got.linked) == (len(pairs), len(linked)), (hot, many)
        members = {}
        for g, i, _ in (r for r in rows if None not in r[:2]):
            members.setdefault(g, set()).add(i)
        shares = [(1 + sum(1 for j in m if j != i and events[i] & events[j])) / len(m) for m in members.values() for i in m]
        got = stats.bcubed_recall(frame, told, "g", "item").first()
        assert got["items"] == len(shares) and abs(got.recall - sum(shares) / len(shares)) < 1e-9


def test_ranks_over_all_rows(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(40)) for k in range(700)]
    got = windows.global_rank(spark.createDataFrame(rows, "id long, v long").repartition(7), [F.desc("v"), F.col("id")]).collect()
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r.rank for r in got} == want


def test_batch_scores_and_rankers(spark):
    pool = spark.createDataFrame([(1, 5, "gold price rises"), (2, 6, "gold mine"), (2, 6, "oil price rises again"), (3, 1, None), (4, 9, "weather")], "candidate long, recency long, text string")
    batch = spark.createDataFrame([("Gold price",), ("oil price rises",), (None,)], "text string")
    got = {r.candidate: (r.score, r.rank) for r in knowledge.batch_scores(pool, batch, scalars.tokens).collect()}
    assert got == {2: (0.75, 1), 1: (round(2 / 3, 9), 2), 4: (0.0, 3), 3: (0.0, 4)}
    rows = spark.createDataFrame([(1, c, r, "gold price", t) for c, r, t in [(1, 5, "gold price"), (2, 9, "gold"), (3, 7, "oil")]], "query long, candidate long, recency long, text string, candidate_text string")
    best = {(r.ranker, r.rank): r.candidate for r in knowledge.bake_off(rows, "query", ["recency", "tokens", "hybrid"]).collect()}
    assert [best["recency", k] for k in (1, 2, 3)] == [2, 3, 1] and [best["tokens", k] for k in (1, 2, 3)] == [1, 2, 3] and best["hybrid", 1] == 2
    truth = spark.createDataFrame([(1, 1), (8, 1)], "query long, candidate long")
    found = {r.ranker: (r.queries, r.found, r.share) for r in knowledge.bake_off(rows, "query", ["recency", "tokens"], truth, most=2).collect()}
    assert found == {"recency": (2, 0, 0.0), "tokens": (2, 1, 0.5)}
    with pytest.raises(ValueError):
        knowledge.ranker("tokens")(knowledge.by_columns())


@pytest.mark.parametrize("k,few", [(1, 0), (3, 0), (40, 0), (3, 100_000)])
def test_top_k_by_steps(spark, monkeypatch, k, few):
    monkeypatch.setattr(joins, "FEW_CANDIDATES", few)
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + rng.choice(["ing", "ing", ""])
    text = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    queries = [(n, text()) for n in range(25)] + [(90, None), (91, ""), (92, "zzz qqq")]
    candidates = [(n, rng.randrange(9), text()) for n in range(70)] + [(100, 3, None)]
    q, c = spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(candidates, "cid long, recency long, text string")
    got = {}
    for r in joins.trigram_top_k(q, c, "qid", "cid", k).collect():
        got.setdefault(r.qid, []).append((r.rank, r.cid))
    pairs = q.select("qid", F.col("text").alias("a")).crossJoin(c.select("cid", "recency", F.col("text").alias("b")))
    scored = pairs.select("qid", "cid", "recency", F.coalesce(F.round(scalars.trigram_similarity(F.col("a"), F.col("b")), 9), F.lit(0.0)).alias("s")).collect()
    for n, _ in queries:
        want = sorted((r for r in scored if r.qid == n), key=lambda r: (-r.s, -r.recency, -r.cid))[:k]
        assert [x for _, x in sorted(got[n])] == [r.cid for r in want]


def test_state_ends(spark, tmp_path):
    """Streams give what batches give, and keys that fell silent leave the state store."""
    t0, rng = dt.datetime(2024, 1, 1), random.Random(1)
    rows = []
    for k in range(12):
        at = t0 + dt.timedelta(hours=k)
        for n in range(40):
            at += dt.timedelta(hours=200 if n == 20 and k % 3 == 0 else 1 + k % 2)
            rows.append((f"k{k}", at, float(rng.choice((1, 1, 2, 2, 3, 30))), rng.choice(("x", "x", "y", None))))
    rows.sort(key=lambda r: r[1])
    end = rows[-1][1]
    later = [[("late", end + dt.timedelta(days=d), 1.0, None)] for d in (20, 40, 60)]
    kind = "k string, ts timestamp, v double, e string"
    parts = [rows[:150], rows[150:300], rows[300:], *later]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    frame = spark.createDataFrame([r for p in parts for r in p], kind)
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(stream, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        query.stop()
        return rows_of(spark.table(name)), sizes

    volume = rows_of(monitors.volume_alerts(frame, "k", "ts", "v", idle_hours=100))
    got, sizes = run(monitors.volume_alerts(read(), "k", "ts", "v", idle_hours=100, watermark="1 minute"), "volume_ttl")
    assert got == volume and volume and volume != rows_of(monitors.volume_alerts(frame, "k", "ts", "v"))
    assert sizes[-1] < max(sizes) / 3
    once = rows_of(state.alert_once(frame, "k", "ts", "e", 100).select("k", "ts", "e"))
    got, sizes = run(monitors.alert_once(read(), "k", "ts", "e", idle_hours=100, watermark="1 minute"), "once_ttl")
    assert got == once and sizes[-1] == 0
