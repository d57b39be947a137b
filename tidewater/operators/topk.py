"""Sorting, top-k and set operations; every order is total."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows (TakeOrderedAndProject)."""
    return rows.orderBy(*order).limit(k)


def top_k_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column) -> DataFrame:
    """The k first rows of each key; Spark cuts each map task's groups before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def capped_sample(rows: DataFrame, used: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """As many first rows as the cap leaves after what is used (``used``: one row n); each task keeps its own first rows."""
    first = rows.orderBy(*order).limit(cap)
    placed = first.withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # at most cap rows
    return placed.crossJoin(F.broadcast(used.select(F.col("n").alias("_used")))).filter(F.col("_r") <= F.lit(cap) - F.col("_used")).drop("_r", "_used")  # one row


def newest_run(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """The one row with the latest time, the largest ``tie`` of several."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(1)


def chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Add the number of each row's chunk."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("chunk", F.floor((at - 1) / size).cast("int"))


def pack_requests(clusters: DataFrame, window: str, cluster: str, item: str, size: int) -> DataFrame:
    """Clusters of two or more are requests; single items are packed together, newest first, of equal items the smaller cluster first."""
    own = Window.partitionBy(window, cluster)
    rows = clusters.withColumn("_n", F.count("*").over(own))
    several = rows.filter("_n > 1").withColumn("request", F.concat(F.lit("c"), F.col(cluster).cast("string")))
    single = chunked(rows.filter("_n = 1"), [window], [F.desc(item), F.col(cluster)], size)
    single = single.withColumn("request", F.concat(F.lit("s"), F.col("chunk").cast("string"))).drop("chunk")
    return several.unionByName(single).drop("_n")


def interleave_hosts(rows: DataFrame, host: str, order: str) -> DataFrame:
    """Round-robin over hosts, those with most rows first."""
    at = F.row_number().over(Window.partitionBy(host).orderBy(order))
    n = F.count("*").over(Window.partitionBy(host))
    return rows.withColumn("round", at).withColumn("of", n).orderBy("round", F.desc("of"), host)


def pick_evidence(rows: DataFrame, key: str, group: str, depth: str, url: str, k: int = 3) -> DataFrame:
    """Depth first across groups, each url once, at most k a key."""
    once = rows.groupBy(key, url).agg(F.min(F.struct(depth, group)).alias("_at")).select(key, url, f"_at.{depth}", f"_at.{group}")
    return top_k_per_key(once, [key], [F.col(depth), F.col(group), F.col(url)], k)


def batch_around(rows: DataFrame, anchors: DataFrame, key: str, at: str, item: str, hours: int, n: int) -> DataFrame:
    """Each anchor with its n - 1 latest rows of the hours before it."""
    a = anchors.select(key, F.col(item).alias("anchor"), F.col(at).alias("anchor_at"))
    near = a.join(rows, key).filter((F.col(at) <= F.col("anchor_at")) & (F.unix_timestamp("anchor_at") - F.unix_timestamp(at) <= hours * 3600))
    return top_k_per_key(near, ["anchor"], [F.desc(at), F.desc(item)], n)


def best_horizon(rows: DataFrame, keys: Sequence[str], horizon: str, ic: str) -> DataFrame:
    """The horizon with the largest |IC|, the shortest on a tie."""
    return rows.groupBy(*keys).agg(F.max_by(horizon, F.struct(F.abs(F.col(ic)).alias("a"), (-F.col(horizon)).alias("h"))).alias("best"))


def recall_at(rows: DataFrame, ranks: Sequence[str], k: int) -> DataFrame:
    """For each rank column, how many targets stand within k."""
    hits = [F.count_if(F.col(r) <= k).alias(r) for r in ranks]
    return rows.agg(F.count("*").alias("targets"), *hits)


def reserved_slots(candidates: DataFrame, key: str, ranks: Sequence[str], slots: Sequence[int], item: str) -> DataFrame:
    """Fill slots from several rankings in turn without repeats; one key's candidates are a bounded group."""
    fields = [(key, candidates.schema[key].dataType.simpleString()), (item, candidates.schema[item].dataType.simpleString())]

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        taken: list = []
        for rank, n in zip(ranks, slots):
            own = [i for i in group.sort_values([rank, item])[item] if i not in taken]
            taken += own[:n]
        return pd.DataFrame({key: [group[key].iloc[0]] * len(taken), item: taken, "slot": range(1, len(taken) + 1)})

    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", slot int"
    return candidates.groupBy(key).applyInPandas(fill, schema)


def collapsed_headlines(rows: DataFrame, title: Column, item: str) -> DataFrame:
    """(title, first, n): equal headlines as one, with the smallest item."""
    return rows.groupBy(title.alias("title")).agg(F.min(item).alias("first"), F.count("*").alias("n"))


def first_occurrences(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with where they first stood."""
    return rows.groupBy(value).agg(F.min(position).alias(position))


def ordered_union(parts: Sequence[DataFrame], value: str) -> DataFrame:
    """Stacked sources, each value from the first source that has it."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    first = out.groupBy(value).agg(F.min_by(F.struct(*[c for c in out.columns if c != value]), F.col("source_no")).alias("_r"))
    return first.select(value, *[F.col(f"_r.{c}").alias(c) for c in out.columns if c != value])


def overlaid_edges(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Edges (a, b, weight) of two kinds, the larger weight where both have one."""
    return weak.unionByName(strong).groupBy("a", "b").agg(F.max("weight").alias("weight"))
