"""Aggregations: health, shares, surges, performance, accumulators, confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feed_health(polls: DataFrame, source: str = "source", at: str = "polled_at", failure: str = "failure") -> DataFrame:
    """Last good poll, failures since it and the last failure's kind, of each source.  Never polled well: null."""
    good = F.col(failure).isNull()
    last = polls.groupBy(source).agg(F.max(F.when(good, F.col(at))).alias("last_ok"), F.max_by(failure, F.when(~good, F.col(at))).alias("last_failure"))
    after = polls.join(last.select(source, "last_ok"), source).filter(~good & (F.col("last_ok").isNull() | (F.col(at) > F.col("last_ok"))))
    since = after.groupBy(source).agg(F.count("*").alias("failures_since"))
    return last.join(since, source, "left").fillna(0, ["failures_since"])


def failing_feeds(polls: DataFrame, now: Column, limits: DataFrame, source: str = "source") -> DataFrame:
    """Sources without a good poll inside their own limit (``limits``: source, minutes)."""
    rows = feed_health(polls, source).join(limits, source)
    late = F.unix_timestamp(now) - F.unix_timestamp("last_ok") > F.col("minutes") * 60
    return rows.filter(F.col("last_ok").isNull() | late)


def multi_outlet_share(rows: DataFrame, event: str, outlet: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events with two or more outlets over all events."""
    per = rows.groupBy(*keys, event).agg(F.countDistinct(outlet).alias("_n"))
    both = [F.count("*").alias("events"), F.count_if(F.col("_n") >= 2).alias("multi")]
    return per.groupBy(*keys).agg(*both).withColumn("share", F.try_divide("multi", "events"))


def cohorts(rows: DataFrame, event: str, outlet: str, at: str, cutover: Column, hours: int) -> DataFrame:
    """Multi-outlet shares of the window after the cutover and the equal one before it; rows outside are left out."""
    gap = F.unix_timestamp(at) - F.unix_timestamp(cutover)
    cohort = F.when((gap >= 0) & (gap < hours * 3600), "after").when((gap < 0) & (gap >= -hours * 3600), "before")
    return multi_outlet_share(rows.withColumn("cohort", cohort).filter("cohort IS NOT NULL"), event, outlet, ["cohort"])


def gate(shares: DataFrame, gap_seconds: Column, horizon_hours: int, low: float = 0.10, high: float = 0.60) -> DataFrame:
    """not_measurable without events or with a gap beyond the horizon, fail outside the bounds, else pass."""
    verdict = F.when((F.col("events") == 0) | (gap_seconds > horizon_hours * 3600), "not_measurable").when((F.col("share") < low) | (F.col("share") > high), "fail").otherwise("pass")
    return shares.withColumn("verdict", verdict)


def distribution(rows: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The share of each value, of all rows or within some columns."""
    counts = rows.groupBy(*within, *columns).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def enum_rule(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two values of a tenth or more, and none above nine tenths."""
    agg = shares.groupBy(*keys).agg(F.count_if(F.col("share") >= 0.1).alias("common"), F.max("share").alias("top"))
    return agg.withColumn("passes", (F.col("common") >= 2) & (F.col("top") <= 0.9))


def match_rate(n_assertions: Column, n_events: Column) -> Column:
    """A10: null without assertions."""
    return F.when(n_assertions > 0, F.try_divide(n_assertions - n_events, n_assertions))


def surges(rows: DataFrame, key: str, ago: str, history: int = 7, factor: float = 3, excess: int = 200) -> DataFrame:
    """Keys whose count at ``ago`` 0 beats the median of the days before; a missing day counts 0."""
    days = F.array(*[F.count_if(F.col(ago) == k) for k in range(1, history + 1)])
    agg = rows.groupBy(key).agg(F.count_if(F.col(ago) == 0).alias("recent"), days.alias("days"))
    middle = F.element_at(F.array_sort("days"), history // 2 + 1)
    agg = agg.select(key, "recent", middle.alias("median"))
    return agg.withColumn("surge", (F.col("recent") > factor * F.col("median")) & (F.col("recent") - F.col("median") >= excess))


def performance(positions: DataFrame, dimensions: Sequence[str], value: str = "net_return", edge: str = "edge") -> DataFrame:
    """N, hit rate, mean and median return and mean edge, overall and by each dimension alone (grouping sets)."""
    closed = positions.filter(F.col(value).isNotNull())
    stats = [
        F.count("*").alias("n"), F.avg(F.when(F.col(value) > 0, 100.0).otherwise(0.0)).alias("hit_rate"), F.avg(value).alias("mean"),
        F.median(value).alias("median"), F.avg(edge).alias("mean_edge"), F.grouping_id().alias("_g"),
    ]
    sets = closed.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(*stats)
    name, kept = F.lit("all"), F.lit(True)
    bits = len(dimensions)
    for k, d in enumerate(dimensions):
        only = F.col("_g") == ((1 << bits) - 1) ^ (1 << (bits - 1 - k))
        name = F.when(only, d).otherwise(name)
        kept = kept & ~(only & F.col(d).isNull())
    return sets.filter(kept).select(name.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n", "hit_rate", "mean", "median", "mean_edge")


def gate_verdict(n: Column, mean_edge: Column, hit_rate: Column, sustained: Column, least_n: int = 30, least_hit: float = 55.0) -> Column:
    """The first rule that fails."""
    return F.when(n < least_n, "too_few").when(mean_edge <= 0, "no_edge").when(hit_rate < least_hit, "low_hit_rate").when(~sustained, "not_sustained").otherwise("pass")


def leakage(log: DataFrame, day: str, reason: str, n: str, days: int = 7) -> DataFrame:
    """Totals by reason over the most recent logged days."""
    recent = log.select(day).distinct().orderBy(F.desc(day)).limit(days)
    return log.join(F.broadcast(recent), day, "left_semi").groupBy(reason).agg(F.sum(n).alias("n"))


def daily_signals(events: DataFrame, day: str, region: Column, conflict: Column, tone: str, goldstein: str, mentions: str, keys: Sequence[str] = ()) -> DataFrame:
    """By day, counts and mention-weighted means of events in the region; 0 where the weight is 0."""
    w = F.col(mentions)
    agg = events.filter(region).groupBy(*keys, day).agg(
        F.count("*").alias("n"), F.count_if(conflict).alias("n_conflict"), F.sum(w).alias("weight"),
        F.sum(F.col(tone) * w).alias("_t"), F.sum(F.col(goldstein) * w).alias("_g"),
    )
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), "weight"), F.lit(0.0))
    return agg.select(*keys, day, "n", "n_conflict", "weight", mean("_t").alias("tone"), mean("_g").alias("goldstein"))


def weekly_weighted(rows: DataFrame, key: str, friday: Column, relevance: str, score: str) -> DataFrame:
    """Relevance-weighted mean score by key and week."""
    sums = rows.groupBy(key, friday.alias("week")).agg(F.sum(F.col(relevance) * F.col(score)).alias("s"), F.sum(relevance).alias("w"))
    return sums.select(key, "week", F.try_divide("s", "w").alias("value"))


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall and the base rate; rows with a null on either side are left out."""
    r = rows.select(truth.alias("t"), predicted.alias("p")).filter("t IS NOT NULL AND p IS NOT NULL")
    t, p = F.col("t"), F.col("p")
    agg = r.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    every = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return agg.select("tp", "fp", "fn", "tn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(F.col("tp") + F.col("fn"), every).alias("base_rate"))


def field_variance(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows present, distinct values, and whether one value is all there is, of each field."""
    long = rows.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    agg = long.groupBy("field").agg(F.count("value").alias("n"), F.countDistinct("value").alias("distinct"), F.count_if(F.col("value").isNull()).alias("absent"))
    return agg.withColumn("degenerate", F.col("distinct") <= 1)


def next_id(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One more than the largest number behind the prefix."""
    number = F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("int")
    return rows.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def feed_stats(polls: DataFrame, spans: DataFrame) -> DataFrame:
    """By source, of what a poll shows: median window, departures, share seen once (what is still live is left out)."""
    newest = polls.filter("failure IS NULL").groupBy("source").agg(F.max("polled_at").alias("newest"), F.percentile("entries", 0.5).alias("entries"))
    gone = spans.join(newest, "source").filter(F.col("last_seen") < F.col("newest"))
    left = gone.groupBy("source").agg(F.count("*").alias("departed"), F.avg((F.col("first_seen") == F.col("last_seen")).cast("int")).alias("single_share"))
    return newest.join(left, "source", "left").select("source", "entries", F.coalesce("departed", F.lit(0)).alias("departed"), "single_share")


def portfolio_weights(rows: DataFrame, value: str, least: float = 0.5) -> DataFrame:
    """Percent of the total; values themselves never leave.  Small holdings without a thesis are dropped."""
    total = rows.agg(F.sum(value).alias("_total"))
    share = (100 * F.col(value) / F.col("_total")).alias("weight")
    return rows.crossJoin(F.broadcast(total)).select(*[c for c in rows.columns if c != value], share).filter((F.col("weight") >= least) | F.col("has_thesis"))


def inversions(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Neighbouring bands where the higher one scored less."""
    back = Window.orderBy(order)  # a handful of bands
    return rows.withColumn("below", F.lag(value).over(back)).filter(F.col(value) < F.col("below"))


def tier_histogram(rows: DataFrame, tier: Column, *keys: str) -> DataFrame:
    """Rows by tier and keys."""
    return rows.groupBy(tier.alias("tier"), *keys).agg(F.count("*").alias("n"))


def groups_of(rows: DataFrame, key: str, kind: str, least: int) -> DataFrame:
    """(key, kinds, n) of keys with enough rows."""
    return rows.groupBy(key).agg(F.countDistinct(kind).alias("kinds"), F.count("*").alias("n")).filter(F.col("n") >= least)


def failure_histogram(rows: DataFrame, kind: str, failures: Sequence[str]) -> DataFrame:
    """Failures by kind, most frequent first."""
    return rows.filter(F.col(kind).isin(list(failures))).groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)


def share_by(rows: DataFrame, key: Column, part: Column) -> DataFrame:
    """(key, share): rows for which ``part`` holds over all of the key's rows."""
    return rows.groupBy(key.alias("key")).agg(F.try_divide(F.count_if(part), F.count("*")).alias("share"))


def hubness(rows: DataFrame, entity: str, event: str) -> DataFrame:
    """In how many events each entity takes part."""
    return rows.groupBy(F.col(entity).alias("entity")).agg(F.countDistinct(event).alias("events"))


def entity_sets(rows: DataFrame, event: str, entity: str) -> DataFrame:
    """Each event's entities, once each, in order."""
    return rows.groupBy(F.col(event).alias("event")).agg(F.array_sort(F.collect_set(entity)).alias("entities"))


def slot_counts(rows: DataFrame, start: str, seconds: int, marked: Column, least: int) -> DataFrame:
    """Every slot from the first to the last, also without rows: items, marked ones, and whether there are too few."""
    counts = rows.groupBy(start).agg(F.count("*").alias("items"), F.count_if(marked).alias("marked"))
    spine = counts.agg(F.min(start).alias("_lo"), F.max(start).alias("_hi")).select(F.explode(F.sequence("_lo", "_hi", F.lit(seconds).cast("long"))).alias(start))
    return spine.join(counts, start, "left").fillna(0, ["items", "marked"]).withColumn("skipped", F.col("items") < least)


def adjudication_counts(rows: DataFrame, decision: str, same: str) -> DataFrame:
    """Decisions for the same, of all."""
    return rows.agg(F.count_if(F.col(decision) == same).alias("same"), F.count("*").alias("n"))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, cuts): a value's percentiles by linear interpolation, exact."""
    return rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares])).alias("cuts"))


def discrete_percentile(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """the least value that at least the share of rows doesn't exceed."""
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias("cut"))
