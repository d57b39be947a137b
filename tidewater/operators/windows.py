"""Window operators: latest rows, gaps, runs, forward values, ranks, buckets, recurrences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.graph import cut, written


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last row by ``order``; by aggregation, so hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*order, *[c for c in rest if c not in order])
    last = rows.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def gaps(rows: DataFrame, key: Sequence[str], at: str, until: Column | None = None) -> DataFrame:
    """Seconds between neighbouring times of a key, and from the last one to ``until``."""
    order = Window.partitionBy(*key).orderBy(at)
    seconds = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a)
    inner = rows.select(*key, F.lag(at).over(order).alias("begin"), F.col(at).alias("end")).filter("begin IS NOT NULL")
    if until is not None:
        inner = inner.unionByName(rows.groupBy(*key).agg(F.max(at).alias("begin")).withColumn("end", until))
    return inner.withColumn("seconds", seconds(F.col("begin"), F.col("end")))


def largest_gap(rows: DataFrame, key: Sequence[str], at: str, until: Column | None = None) -> DataFrame:
    """The longest gap of each key, the earliest on a tie."""
    found = gaps(rows, key, at, until)
    best = F.max_by(F.struct("begin", "end", "seconds"), F.struct("seconds", (-F.unix_timestamp("begin")).alias("early")))
    return found.groupBy(*key).agg(best.alias("g")).select(*key, "g.begin", "g.end", "g.seconds")


def close_pairs(rows: DataFrame, key: str, at: str, nominal_minutes: float, factor: float = 1.5) -> DataFrame:
    """Neighbouring times at most ``factor`` nominal intervals apart."""
    order = Window.partitionBy(key).orderBy(at)
    pairs = rows.select(key, F.col(at).alias("before"), F.lead(at).over(order).alias("after"))
    return pairs.filter(F.unix_timestamp("after") - F.unix_timestamp("before") <= factor * nominal_minutes * 60)


def active_minutes(rows: DataFrame, key: str, at: str, idle_minutes: float = 5) -> DataFrame:
    """The sum of gaps that are not idle."""
    order = Window.partitionBy(key).orderBy(at)
    gap = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(order))
    short = F.when(gap <= idle_minutes * 60, gap)
    return rows.select(key, short.alias("g")).groupBy(key).agg((F.coalesce(F.sum("g"), F.lit(0)) / 60).alias("minutes"))


def zero_runs(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The length of the run of zeros that ends each key's rows, and of the longest one before it."""
    order = Window.partitionBy(key).orderBy(at)
    islands = rows.withColumn("island", F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(order))
    runs = islands.groupBy(key, "island").agg(F.count_if(F.col(value) == 0).alias("n"))
    return runs.groupBy(key).agg(F.max_by("n", "island").alias("current"), F.max(F.struct("island")).alias("last"), F.collect_list(F.struct("island", "n")).alias("all")).select(
        key, "current", F.coalesce(F.array_max(F.transform(F.filter("all", lambda r: r["island"] < F.col("last.island")), lambda r: r["n"])), F.lit(0)).alias("longest_before")
    )


def sustained(rows: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """Whether the last k values are all above 0; fewer than k values are not sustained."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    last = rows.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= k)
    return last.groupBy(key).agg(((F.count("*") == k) & F.every(F.col(value) > 0)).alias("sustained"))


def volume_anomaly(rows: DataFrame, key: str, at: str, value: str, spike: float = 2.5, trailing: int = 20, least: int = 5, floor: float = 0.0) -> DataFrame:
    """Add ``baseline`` and ``anomaly``: the value against the mean of the samples before it."""
    before = Window.partitionBy(key).orderBy(at).rowsBetween(-trailing, -1)
    rows = rows.withColumn("baseline", F.when(F.count(value).over(before) >= least, F.avg(value).over(before)))
    hit = (F.col("baseline") > 0) & (F.col(value) >= floor) & (F.col(value) >= spike * F.col("baseline"))
    return rows.withColumn("anomaly", F.coalesce(hit, F.lit(False)))


def moving_average(rows: DataFrame, key: str, at: str, value: str, n: int = 200) -> DataFrame:
    """Mean of the last n values; null before there are n."""
    last = Window.partitionBy(key).orderBy(at).rowsBetween(1 - n, 0)
    return rows.withColumn("average", F.when(F.count(value).over(last) >= n, F.avg(value).over(last)))


def forward_returns(prices: DataFrame, key: str, at: str, close: str, horizons: Sequence[int]) -> DataFrame:
    """(key, at, horizon, forward): close some rows ahead over this one, less 1; a base of 0 is skipped."""
    order = Window.partitionBy(key).orderBy(at)
    ahead = [F.struct(F.lit(h).alias("horizon"), F.lead(close, h).over(order).alias("next")) for h in horizons]
    rows = prices.select(key, at, close, F.array(*ahead).alias("ahead")).select(key, at, close, F.inline("ahead"))
    return rows.filter((F.col(close) != 0) & F.col("next").isNotNull()).select(key, at, "horizon", (F.col("next") / F.col(close) - 1).alias("forward"))


def deltas(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The value less the one before it; the first row goes."""
    order = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(order)).filter("delta IS NOT NULL")


def zscores(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Population z-score inside a key; a flat key gives 0."""
    own = Window.partitionBy(key)
    spread = F.stddev_pop(value).over(own)
    return rows.withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(own), F.when(spread > 1e-12, spread)), F.lit(0.0)))


def near_flag(rows: DataFrame, key: str, at: str, flag: str, reach: int) -> DataFrame:
    """Rows within some positions of a flagged one."""
    around = Window.partitionBy(key).orderBy(at).rowsBetween(-reach, reach)
    return rows.withColumn("_n", F.max(F.col(flag).cast("int")).over(around)).filter("_n = 1").drop("_n")


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, ties at their mean.

    The rows are written once: they are counted and then meet their ranks by value, and a
    mean of doubles may come out otherwise when it is worked out again.
    """
    return ranks_by_value(written(rows), keys, value, out)


def ranks_by_value(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``average_ranks`` of rows whose values are the same at every reading.

    Distinct values are counted and sorted over range partitions, so a key's values are
    ranked by many tasks; a value's rank follows from the counts before it and its own.
    """
    by = [*keys, value]
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    placed = cut(counts.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", *keys).agg(F.sum("_n").alias("_n"))  # at most one row for each partition and key, and each partition
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = parts.select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    at = placed.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed("_part", "_p")
    at = at.join(skips, [F.col("_p") == F.col("_part"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]])
    ranks = at.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], (F.col("_skip") + F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranks, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]).drop(*[f"_b{i}" for i in range(len(by))])


def fresh_samples(rows: DataFrame, key: str, at: str, value: str, keep: int) -> DataFrame:
    """Without values equal to the one before, the last ``keep``."""
    order = Window.partitionBy(key).orderBy(at)
    changed = rows.withColumn("_b", F.lag(value).over(order)).filter(~F.col("_b").eqNullSafe(F.col(value)) | F.col("_b").isNull()).drop("_b")
    return changed.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter(F.col("_r") <= keep).drop("_r")


def quantile_buckets(rows: DataFrame, keys: Sequence[str], order: Sequence[str], q: int) -> DataFrame:
    """Bucket b holds the sorted rows from b n / q to (b + 1) n / q."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("bucket", F.floor((at * q - 1) / n).cast("int"))


def token_bucket(rows: DataFrame, key: str, order: str, accrued: str, spent: str, start: float, cap: float) -> DataFrame:
    """Balance after each row of min(cap, balance + accrued) - spent, in closed form (prefix sum and running minimum)."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(F.col(accrued) - F.col(spent)).over(so_far))
    room = F.min(F.lit(cap) - F.col(spent) - F.col("_s")).over(so_far)
    return rows.withColumn("_room", room).withColumn("balance", F.col("_s") + F.least(F.lit(start), F.col("_room"))).drop("_s", "_room")


def temporal_split(rows: DataFrame, keys: Sequence[str], order: Sequence[str], share: float) -> DataFrame:
    """``part`` is discovery for the first int(n * share) rows by ``order``, else holdout; without keys over all rows, by ``global_rank``."""
    if keys:
        rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    else:
        placed = global_rank(rows, [F.col(c) for c in order], "_pos")
        rows = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("_n"))))  # one row
    return rows.withColumn("part", F.when(F.col("_pos") <= F.floor(F.col("_n") * share), "discovery").otherwise("holdout")).drop("_pos", "_n")


def global_rank(rows: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add ``out``: a row's place (from 1) among all rows by ``order``, without a window over all of them.

    Rows are sorted over range partitions; a partition's places start where those of the
    partitions before it end.  What is summed up over all is one row for each partition.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    place = F.col("_at") - F.shiftleft("_part", 33) + F.col("_skip") + 1
    return placed.withColumn("_part", part).join(F.broadcast(skips), "_part").withColumn(out, place).drop("_part", "_skip", "_at")
