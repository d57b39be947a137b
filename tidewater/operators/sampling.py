"""Sampling by hash order: the same rows on every run and on any number of tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *columns: str) -> Column:
    """A row's place in the draw: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def stratified(rows: DataFrame, strata: Sequence[str], ids: Sequence[str], per_stratum: int, seed: str) -> DataFrame:
    """Some rows of each stratum; ``order_no`` interleaves the strata round by round."""
    own = Window.partitionBy(*strata).orderBy("_d", *ids)
    rows = rows.withColumn("_d", draw(seed, *ids)).withColumn("round", F.row_number().over(own)).filter(F.col("round") <= per_stratum)
    mixed = Window.orderBy("round", draw(seed + "s", "round", *strata), *strata)  # strata x per_stratum rows
    return rows.withColumn("order_no", F.row_number().over(mixed)).drop("_d")


def one_pair_per_group(pairs: DataFrame, group: str, a: str, b: str, groups: int, seed: str) -> DataFrame:
    """Some groups, one pair of each."""
    best = pairs.withColumn("_d", draw(seed, group, a, b)).groupBy(group).agg(F.min(F.struct("_d", a, b)).alias("p"))
    return best.withColumn("_g", draw(seed, group)).orderBy("_g", group).limit(groups).select(group, f"p.{a}", f"p.{b}")


def far_pairs(rows: DataFrame, key: str, item: str, outlet: str, at: str, least_days: int, most: int, seed: str, neighbours: int = 8) -> DataFrame:
    """Pairs of a key at least some days apart and of different outlets; rows meet neighbours in hash order, not all others."""
    order = Window.partitionBy(key).orderBy("_d", item)
    rows = rows.withColumn("_d", draw(seed, key, item))
    ahead = F.array(*[F.struct(F.lead(item, k).over(order).alias("b"), F.lead(outlet, k).over(order).alias("ob"), F.lead(at, k).over(order).alias("tb")) for k in range(1, neighbours + 1)])
    met = rows.withColumn("_a", ahead).withColumn("_n", F.explode("_a")).filter("_n.b IS NOT NULL")
    far = F.abs(F.unix_timestamp(at) - F.unix_timestamp("_n.tb")) >= least_days * 86400
    pairs = met.filter(far & (F.col(outlet) != F.col("_n.ob"))).select(F.least(F.col(item), F.col("_n.b")).alias("a"), F.greatest(F.col(item), F.col("_n.b")).alias("b")).distinct()
    return pairs.orderBy(draw(seed, "a", "b"), "a", "b").limit(most)


def thinned(rows: DataFrame, keep: Column, hour: Column, item: str, per_hour: int, seed: str) -> DataFrame:
    """Marked rows stay; the others are thinned to a number an hour."""
    rows = rows.withColumn("_k", keep).withColumn("_h", hour).withColumn("_d", draw(seed, item))
    at = F.row_number().over(Window.partitionBy("_h", "_k").orderBy("_d", item))
    return rows.withColumn("_r", at).filter(F.col("_k") | (F.col("_r") <= per_hour)).drop("_k", "_h", "_d", "_r")
