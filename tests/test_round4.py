"""What the findings of round 4 named: small inputs on which the code before them failed."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from tidewater.operators import joins, knowledge, stats, windows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def unsteady(c):
    """A column's value plus a share that differs each time it is worked out, as a mean of doubles may."""
    return F.udf(lambda v: v + random.random() / 4, "double").asNondeterministic()(c)


def test_ranks_read_their_rows_once(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), unsteady(F.col("id").cast("double")).alias("x"), "id")
    got = stats.rank_ic(rows, ["k"], "x", "id").collect()
    assert {(r.k, r.n, round(r.ic, 9)) for r in got} == {(0, 100, 1.0), (1, 100, 1.0)}
    assert {(r.id, r["rank"]) for r in windows.average_ranks(rows, ["k"], "x").collect()} == {(k, k // 2 + 1) for k in range(200)}


def test_backtest_reads_its_pairs_once(spark):
    at = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    days = [("ab"[k % 2], at(k // 2), float(k)) for k in range(120)]
    rows = spark.createDataFrame(days, "key string, date date, v double").select("key", "date", unsteady("v").alias("value"))
    prices = spark.createDataFrame(days, "key string, date date, v double").select("key", "date", unsteady(F.col("v") * F.col("v") + 100).alias("close"))
    got = stats.backtest(rows, prices, "key", "date", "value", "close", [1, 3])
    assert {(r.horizon, r.part, r.n) for r in got.collect()} == {(1, "discovery", 59), (1, "holdout", 59), (3, "discovery", 57), (3, "holdout", 57)}


def test_similar_rows_are_met_block_by_block(spark, tmp_path):
    rows = spark.createDataFrame([(k, "large ring") for k in range(1000)], "id long, x string").repartition(3)
    joins.similar_pairs(rows, "id", "x", 0.8).coalesce(1).write.parquet(f"{tmp_path}/pairs")
    pairs = [(r.a, r.b) for r in spark.read.parquet(f"{tmp_path}/pairs").collect()]
    assert len(pairs) == 499500 == len(set(pairs)) and all(a < b for a, b in pairs)
    # A row meets one block at a time, so it stays for many pairs and for no more than a block's.
    runs = [len(list(g)) for _, g in itertools.groupby(pairs, lambda p: p[0])]
    assert max(runs) <= joins.BLOCK_ROWS and len(pairs) / len(runs) >= 32


def test_similar_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRED_ROWS", 5)
    got = joins.similar_pairs(spark.createDataFrame([(k, ("large ring", "oil")[k % 2]) for k in range(60)], "id long, x string"), "id", "x", 0.8)
    assert got.count() == 2 * 30 * 29 // 2
    assert len([x for x in plan(got).splitlines() if "RepartitionByExpression [c2" in x and x.rstrip().endswith(", 12")]) == 2


def test_similarity_is_rounded_by_classes(spark):
    rows = spark.createDataFrame([(1, "hot rings"), (2, "hot ring"), (3, None), (4, "")], "id long, x string")
    got = joins.similar_pairs(rows, "id", "x", 0.5, 3)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 0.727)] and "round" not in plan(got).split("Join")[0]


def test_a_pool_is_put_in_order_of_recency_once(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "POOL_PART_ROWS", 5)
    q = spark.createDataFrame([(k, k % 2, ("gold price", "oil")[k % 3 % 2]) for k in range(9)], "query long, b long, text string")
    c = spark.createDataFrame([(k, k % 4, k % 2, ("gold", "oil price", None)[k % 3]) for k in range(50)], "candidate long, recency long, b long, candidate_text string")
    got = knowledge.ranked_pool(q, c, "query", ["b"], ["text"], ["candidate_text"], ["recency", "tokens"])
    want = knowledge.ranked(q.join(c, "b"), "query", ["recency", "tokens"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9 * 25
    # Only the ranking by tokens sorts a group's rows, and groups go to as many tasks as the candidates need.
    assert plan(got).count("row_number() windowspecdefinition(_group") == 1
    assert [x for x in plan(got).splitlines() if "RepartitionByExpression [_group" in x and x.rstrip().endswith(", 10")]
