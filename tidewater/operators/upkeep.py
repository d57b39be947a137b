"""Operators around a feed's upkeep: completed bars, prices of calls, droughts, logs, queues and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completed_bars(bars: DataFrame, at: str, as_of: Column) -> DataFrame:
    """Bars dated strictly before the UTC date of ``as_of``; that day's bar may still be forming."""
    return bars.filter(F.col(at) < F.to_date(as_of))


def usable_symbols(bars: DataFrame, key: str, at: str, as_of: Column, stale_days: int = 5) -> DataFrame:
    """P20: (key, last) of the symbols whose last completed bar is at most ``stale_days`` old."""
    last = completed_bars(bars, at, as_of).groupBy(key).agg(F.max(at).alias("last"))
    return last.filter(F.datediff(F.to_date(as_of), "last") <= stale_days)


def price_of(model: Column, prompt_tokens: Column, prices: Mapping[str, tuple[float, float]], long_prompt: Mapping[str, tuple[int, tuple[float, float]]]) -> Column:
    """struct(price_in, price_out) of a model, dearer beyond a prompt size where it has a second tier; an unknown model is an error."""
    pair = lambda p: F.struct(F.lit(float(p[0])).alias("price_in"), F.lit(float(p[1])).alias("price_out"))
    out = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(model, F.lit("null")))).cast("struct<price_in:double,price_out:double>")
    for name, flat in prices.items():
        own = pair(flat)
        if name in long_prompt:
            own = F.when(F.coalesce(prompt_tokens, F.lit(0)) > long_prompt[name][0], pair(long_prompt[name][1])).otherwise(own)
        out = F.when(model == name, own).otherwise(out)
    return out


def tool_rows(text: Column, schema: str) -> Column:
    """the JSON list between the first [ and the last ] of a model's text, as structs; null where there is none."""
    block = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(block != "", F.from_json(block, f"array<struct<{schema}>>"))


def droughts(runs: DataFrame, key: str, at: str, run: str, new: str, failed: str, now: Column, days: int = 7) -> DataFrame:
    """(key, current, longest) where the passes without new items up to now are more than ever in the last ``days``.

    Silent for keys with less history than that, and where a failure among these passes explains it.
    """
    since = now - F.expr(f"INTERVAL {days} DAYS")
    old = runs.groupBy(key).agg(F.min(at).alias("_first")).filter(F.col("_first") <= since).select(key)
    own = Window.partitionBy(key)
    some = (F.col(new) > 0).cast("int")
    rows = runs.filter(F.col(at) > since).withColumn("_later", F.sum(some).over(own.orderBy(F.desc(at), F.desc(run)))).withColumn("_before", F.sum(some).over(own.orderBy(at, run)))
    streaks = rows.filter(F.col(new) == 0).groupBy(key, "_before").agg(F.count("*").alias("n"), F.max(F.col("_later") == 0).alias("now"), F.max(failed).alias("failed"))
    found = streaks.groupBy(key).agg(
        F.max(F.when(F.col("now"), F.col("n"))).alias("current"), F.coalesce(F.max(F.when(~F.col("now"), F.col("n"))), F.lit(0)).alias("longest"), F.max(F.col("now") & F.col("failed")).alias("failed")
    )
    return found.filter((F.col("current") > F.col("longest")) & ~F.col("failed")).join(old, key, "left_semi").select(key, "current", "longest")


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """A log with rows behind it; columns are matched by name, missing ones are null."""
    return log.unionByName(rows, allowMissingColumns=True)


def looked_up(entries: DataFrame, items: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The stored id of each entry's key; entries that aren't stored drop out, repeated ones count once."""
    return entries.select(*keys).distinct().join(items.select(*keys, id_col), list(keys))


def ledger_in_order(claims: DataFrame, severity: str, reaffirmed: str, id_col: str, retired: str, ranks: Sequence[str] = ("high", "medium", "low")) -> DataFrame:
    """Live claims, the severest first, then the latest reaffirmed, then by id."""
    rank = F.lit(len(ranks))
    for n, name in enumerate(ranks):
        rank = F.when(F.col(severity) == name, n).otherwise(rank)
    return claims.filter(~F.col(retired)).orderBy(rank, F.desc(reaffirmed), id_col)


def tallied(rows: DataFrame, *names: str) -> DataFrame:
    """How often each reason occurs, the most frequent first."""
    return rows.groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names)


def spend_average(calls: DataFrame, stage: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Calls of each stage and their mean tokens in and out."""
    return calls.groupBy(stage).agg(F.count("*").alias("calls"), F.avg(tokens_in).alias("mean_in"), F.avg(tokens_out).alias("mean_out"))


def sets_by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The sorted set of values of each key; for keys with few values."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("found"))


def unanswered(pairs: DataFrame, answered: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs of a sample that have no answer, in either direction."""
    both = answered.select(a, b).unionByName(answered.select(F.col(b).alias(a), F.col(a).alias(b)))
    return pairs.join(both.distinct(), [a, b], "left_anti")


def with_tail(rows: DataFrame, tail: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in order with a tail row behind them all; ``_tail`` tells them apart."""
    both = rows.withColumn("_tail", F.lit(0)).unionByName(tail.withColumn("_tail", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("_tail", *order)


def queued(runs: DataFrame, status: str, id_col: str, wanted: str = "queued") -> DataFrame:
    """Runs that wait, the oldest id first."""
    return runs.filter(F.col(status) == wanted).orderBy(id_col)


def bonferroni(horizons: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(n, threshold): alpha over the number of horizons, alpha itself where there are none."""
    return horizons.agg(F.count("*").alias("n")).withColumn("threshold", F.coalesce(F.try_divide(F.lit(alpha), "n"), F.lit(alpha)))


def passages_since(passages: DataFrame, topic: str, at: str, id_col: str, after: Column, k: int) -> DataFrame:
    """Each topic's k latest passages on or after a date, ties by id."""
    latest = Window.partitionBy(topic).orderBy(F.desc(at), F.desc(id_col))
    return passages.filter(F.col(at) >= after).withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= k)


def window_members(members: DataFrame, items: DataFrame, outlets: DataFrame, item: str, outlet: str, order: Sequence[str]) -> DataFrame:
    """A window's items with their outlets, in capture order."""
    return members.join(items, item).join(outlets, outlet).orderBy(*order)


def shadowed(symbols: DataFrame, companies: DataFrame, on: str) -> DataFrame:
    """The symbols that a known company already maps to."""
    return symbols.join(companies.select(on).distinct(), on, "left_semi")
