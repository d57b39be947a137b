"""Structured Streaming twins of the scheduled operators."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.operators import state


def capture(stream: DataFrame, read_target: Callable[[], DataFrame], append: Callable[[DataFrame], None], keys: list[str], order: list[str]):
    """Append what the target lacks, batch by batch; returns the writer to start.

    A batch that is run again finds its rows in the target and appends nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        append(state.insert_if_absent(read_target(), rows, keys, order))

    return stream.writeStream.foreachBatch(batch)


def deduplicated(stream: DataFrame, keys: list[str], at: str, watermark: str = "48 hours") -> DataFrame:
    """One row a key within the watermark."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, at: str, key: str, length: str = "6 hours", slide: str | None = None, watermark: str = "24 hours") -> DataFrame:
    """Counts by key and event-time window."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    counts = stream.withWatermark(at, watermark).groupBy(span.alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


#: A key that nothing was heard of for so long is forgotten; its state goes.
IDLE_HOURS = 24.0 * 30


class _Forgetful(StatefulProcessor):
    """One state row a key, and a timer that clears it when the watermark passes the key's last row by the idle time."""

    schema = ""

    def __init__(self, columns: list[str], at: str, idle_hours: float):
        self.columns, self.at, self.idle_ms = columns, at, int(idle_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def fresh(self) -> tuple:
        raise NotImplementedError

    def step(self, held: tuple, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (named by Spark)
        frame = pd.concat(list(rows)).sort_values(self.at)
        held = self.held.get() if self.held.exists() else self.fresh()
        held, found = self.step(held, list(frame[self.columns].itertuples(index=False, name=None)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(int(pd.Timestamp(frame[self.at].iloc[-1]).timestamp() * 1000) + self.idle_ms + 1)
        yield pd.DataFrame(found, columns=[self.columns[0], "at", *self.extra])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.held.clear()
        yield pd.DataFrame([], columns=[self.columns[0], "at", *self.extra])

    def close(self) -> None:
        pass


def _seconds(when) -> float:
    return pd.Timestamp(when).timestamp()


class _VolumeAlerts(_Forgetful):
    schema, extra = "samples array<double>, alerted double, seen double", ["value", "ratio"]

    def __init__(self, columns, at, idle_hours, spike, trailing, least, floor, cooldown_hours):
        super().__init__(columns, at, idle_hours)
        self.spike, self.trailing, self.least, self.floor, self.cooldown = spike, trailing, least, floor, cooldown_hours * 3600

    def fresh(self):
        return ([], None, None)

    def step(self, held, rows):
        samples, alerted, seen = list(held[0]), held[1], held[2]
        found = []
        for name, when, v in rows:
            now = _seconds(when)
            if seen is not None and (now - seen) * 1000 > self.idle_ms:
                samples, alerted = [], None
            seen = now
            if v is None or v != v:
                continue
            if len(samples) >= self.least and v >= self.floor:
                mean = functools.reduce(operator.add, reversed(samples)) / len(samples)  # rounded as the batch rounds it
                if mean > 0 and v >= self.spike * mean and (alerted is None or now - alerted >= self.cooldown):
                    found.append((name, when, float(v), v / mean))
                    alerted = now
            if not samples or samples[-1] != v:
                samples = (samples + [float(v)])[-self.trailing :]
        return (samples, alerted, seen), found


class _AlertOnce(_Forgetful):
    schema, extra = "episode string, seen double", ["episode"]

    def fresh(self):
        return (None, None)

    def step(self, held, rows):
        current, seen = held
        found = []
        for name, when, e in rows:
            now = _seconds(when)
            if seen is not None and (now - seen) * 1000 > self.idle_ms:
                current = None
            seen, e = now, None if pd.isna(e) else e
            if e is not None and e != current:
                found.append((name, when, e))
            current = e
        return (None if current is None else (current, seen)), found


def _with_state(rows: DataFrame, key: str, processor: _Forgetful, out: str) -> DataFrame:
    """Timers need the RocksDB state store; the session is set to it."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def volume_alerts(
    stream: DataFrame, key: str, at: str, value: str, spike: float = 2.5, trailing: int = 20, least: int = 5, floor: float = 0.0, cooldown_hours: float = 12, idle_hours: float = IDLE_HOURS, watermark: str = "1 hour"
) -> DataFrame:
    """(key, at, value, ratio) where a value beats the mean of the samples before it, at most once a cooldown.

    State is a ring of samples and the last alert's time for each key; a key that was silent
    for over ``idle_hours`` starts afresh, and its state goes when the watermark shows that.
    A null value is no sample.  Works on a batch table too, with the same result for rows in
    time order.
    """
    schema = stream.select(key, at, value).schema
    out = f"`{key}` {schema[key].dataType.simpleString()}, at {schema[at].dataType.simpleString()}, value double, ratio double"
    rows = stream.select(key, at, value)
    if stream.isStreaming:
        processor = _VolumeAlerts([key, at, value], at, idle_hours, spike, trailing, least, floor, cooldown_hours)
        return _with_state(rows.withWatermark(at, watermark), key, processor, out)
    # A batch: means by row frames over the samples that differ from the one before; only the cooldown goes row by row.
    by_key = Window.partitionBy(key).orderBy(at)
    silent = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(by_key).cast("timestamp")) > int(idle_hours * 3_600_000_000)
    rows = rows.withColumn("_g", F.coalesce(silent, F.lit(False)).cast("int")).withColumn("_life", F.sum("_g").over(by_key)).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    in_order = Window.partitionBy(key, "_life").orderBy(at)
    fresh = F.col(value) != F.lag(value).over(in_order)
    rows = rows.withColumn("_new", F.when(F.coalesce(fresh, F.lit(True)), F.col(value).cast("double")))
    rows = rows.withColumn("_seen", F.count("_new").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    ring = Window.partitionBy(key, "_life").orderBy(F.desc("_seen")).rangeBetween(1, trailing)  # summed up from the newest sample on
    rows = rows.withColumn("_mean", F.avg("_new").over(ring)).withColumn("_n", F.count("_new").over(ring))
    hits = rows.filter((F.col("_n") >= least) & (F.col(value) >= floor) & (F.col("_mean") > 0) & (F.col(value) >= spike * F.col("_mean")))
    hits = hits.select(F.col(key), F.col(at).alias("at"), F.col(value).cast("double").alias("value"), (F.col(value) / F.col("_mean")).alias("ratio"))

    def spaced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for frame in frames:
            keep = []
            for own, when in zip(frame[key], frame["at"]):
                late = own != name or (when - last).total_seconds() >= cooldown_hours * 3600
                keep.append(late)
                if late:
                    name, last = own, when
            yield frame[keep]

    return hits.repartition(F.col(key)).sortWithinPartitions(key, "at", "value").mapInPandas(spaced, out)


def alert_once(stream: DataFrame, key: str, at: str, episode: str, idle_hours: float = IDLE_HOURS, watermark: str = "1 hour") -> DataFrame:
    """(key, at, episode) when a key's episode is new; a null episode clears it.

    A healthy key holds no state; one in an episode loses it when nothing was heard of it
    for over ``idle_hours``, and the same episode is news again.
    """
    schema = stream.select(key, at, episode).schema
    out = f"`{key}` {schema[key].dataType.simpleString()}, at {schema[at].dataType.simpleString()}, episode string"
    return _with_state(stream.select(key, at, episode).withWatermark(at, watermark), key, _AlertOnce([key, at, episode], at, idle_hours), out)
