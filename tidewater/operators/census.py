"""A census of a block of days: windows, their members and the order they are judged in, frozen together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.operators import sampling
from tidewater.sources.tableset import TableSet

# Fixed values.
WINDOW_HOURS = 6
BLOCK_DAYS, BLOCK_LAG_DAYS, LEAST_BLOCK_DAYS = 14, 3, 7
TABLES = ["block", "window_order", "windows", "window_items", "skipped"]


class Refused(RuntimeError):
    """The census can't be prepared, and why."""


def block_of(today: dt.date, first_day: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """the days that end some days before ``today``, none before ``first_day``."""
    end = today - dt.timedelta(days=BLOCK_LAG_DAYS)
    start = max(end - dt.timedelta(days=BLOCK_DAYS), first_day or dt.date.min)
    if (end - start).days < LEAST_BLOCK_DAYS:
        raise Refused(f"the block has {(end - start).days} days of {LEAST_BLOCK_DAYS}")
    return start, end


def census_tables(items: DataFrame, start: dt.date, end: dt.date, least: int, per_stratum: int = 4, seed: str = "7", repeat: int = 3) -> dict[str, DataFrame]:
    """The tables of a census of items (item, title, quote, published, created).

    Every six-hour slot of the block is a window; one with fewer than ``least`` eligible
    items is skipped with its count, also where it has none.  The drawn ones (some of each
    time of day, interleaved; R01) get their number as id; the ``repeat``-th comes again as
    pass 2 under the next id, with the same members.
    """
    spark = items.sparkSession
    seconds = lambda d: int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())
    lo, hi = seconds(start), seconds(end)
    slots = spark.range(lo, hi, WINDOW_HOURS * 3600).select(F.col("id").alias("start"))
    at = F.unix_timestamp("created")
    rows = items.filter((at >= lo) & (at < hi)).select("item", scalars.six_hour_start(F.col("created")).alias("start"), "published", predicates.exclusion_reason(F.col("title"), F.col("quote"), F.col("published"), F.col("created")).alias("reason"))
    counts = rows.groupBy("start").agg(
        F.count_if(F.col("reason").isNull()).alias("eligible"), F.count_if(F.col("reason") == "backlog").alias("backlog_excluded"), F.count_if(F.col("reason").isNull() & F.col("published").isNull()).alias("null_published")
    )
    stats = slots.join(counts, "start", "left").fillna(0)
    skipped = stats.filter(F.col("eligible") < least).select("start", F.format_string("fewer than %d eligible items (%d)", F.lit(least), "eligible").alias("reason"))
    stratum = (F.floor(F.col("start") / (3600 * WINDOW_HOURS)) % (24 // WINDOW_HOURS)).cast("int")
    drawn = sampling.stratified(stats.filter(F.col("eligible") >= least).withColumn("stratum", stratum), ["stratum"], ["start"], per_stratum, seed)
    order = drawn.select("order_no", "start", "stratum", "backlog_excluded", "null_published")
    first = order.select(F.col("order_no").cast("long").alias("window"), "order_no", "start", F.lit(1).alias("pass"), F.lit(None).cast("long").alias("repeat_of"), "backlog_excluded", "null_published")
    n = order.agg(F.max("order_no").alias("_n"))
    again = first.filter(F.col("order_no") == repeat).crossJoin(F.broadcast(n)).select((F.col("_n") + 1).cast("long").alias("window"), "order_no", "start", F.lit(2).alias("pass"), F.col("window").alias("repeat_of"), "backlog_excluded", "null_published")  # one row
    windows = first.unionByName(again).withColumn("status", F.lit("prepared"))
    members = rows.filter("reason IS NULL").join(windows.select("window", "start"), "start").select("window", "item")
    block = spark.range(1).select(F.lit(lo).alias("start"), F.lit(hi).alias("end"))
    return {"block": block, "window_order": order.select("order_no", "start", "stratum"), "windows": windows, "window_items": members, "skipped": skipped}


def prepare(tables: TableSet, items: DataFrame, start: dt.date, end: dt.date, least: int, per_stratum: int = 4, seed: str = "7", repeat: int = 3) -> str:
    """Freeze the census in one commit; a second call changes nothing.

    Refused where windows of a released census are left, or a time of day has too few
    windows.  A run that dies leaves the old state; one that comes second while another
    prepares gets ``tableset.Conflict``.
    """
    base = tables.version()
    state = tables.state(base)
    if "block" in state and not tables.read("block", base).isEmpty():
        return "already prepared"
    if any(not tables.read(t, base).isEmpty() for t in ("window_order", "windows") if t in state):
        raise Refused("windows of a released census are left")
    made = census_tables(items, start, end, least, per_stratum, seed, repeat)
    thin = made["window_order"].groupBy("stratum").count().filter(F.col("count") >= per_stratum).count()
    if thin < 24 // WINDOW_HOURS:
        raise Refused(f"{thin} of {24 // WINDOW_HOURS} times of day have {per_stratum} windows")
    tables.commit(replaced=made, base=base)
    return "prepared"


def frozen_windows(tables: TableSet, version: int | None = None) -> DataFrame:
    """What a reader sees: each window with its number of members and its latest row of the order."""
    version = tables.version() if version is None else version
    sizes = tables.read("window_items", version).groupBy("window").agg(F.count("*").alias("members"), F.min("item").alias("first_item"), F.max("item").alias("last_item"))
    rows = tables.read("windows", version).join(tables.read("window_order", version).select("order_no", "stratum"), "order_no")
    return rows.join(sizes, "window", "left").fillna(0, ["members"])
