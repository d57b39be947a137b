"""State as tables: inserts, upserts, diffs, ledgers, positions, schedules.

Each operator takes the old table and the new rows and returns the new table (or the rows
to append); writing and swapping it is the caller's single job.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars


def _total(columns: Sequence[str], order: Sequence[str]) -> Column:
    """``order``, with all other columns behind it: rows that still tie are equal."""
    return F.struct(*order, *[c for c in columns if c not in order])


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows to append: the first of each key that the target lacks."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), _total(rest, order)).alias("_r"))
    fresh = first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return fresh.join(target.select(*keys).distinct(), list(keys), "left_anti")


def upsert_seen(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first_seen, last_seen, position): the first sighting stays, the last one and its position win."""
    both = target.unionByName(rows)
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("position", F.struct("last_seen", "position")).alias("position"))


def upsert_latest(target: DataFrame, rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the largest version of each key."""
    both = target.unionByName(rows)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), _total(rest, [version])).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_verdicts(target: DataFrame, rows: DataFrame, key: str, verdict: str, seq: str) -> DataFrame:
    """The latest verdict, and attempts counted over all."""
    both = target.select(key, verdict, seq, "attempts").unionByName(rows.select(key, verdict, seq).withColumn("attempts", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(verdict, F.struct(seq, verdict)).alias(verdict), F.max(seq).alias(seq), F.sum("attempts").alias("attempts"))


def upsert_sparse(target: DataFrame, rows: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A null in a new row keeps the old value; a new key gets the default."""
    columns = [c for c in target.columns if c != key]
    new = rows.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns if c in rows.columns])
    joined = target.join(new, key, "full_outer")
    pick = lambda c: F.coalesce(*([F.col(f"_n_{c}")] if c in rows.columns else []), F.col(c), F.lit(defaults.get(c)))
    return joined.select(key, *[pick(c).alias(c) for c in columns])


def defer_or_charge(rows: DataFrame, touched: Column, defers: str, attempts: str, ceiling: int) -> DataFrame:
    """A touched row at the ceiling is charged an attempt, one below it is deferred."""
    full = touched & (F.col(defers) >= ceiling)
    return rows.withColumn(attempts, F.col(attempts) + full.cast("int")).withColumn(defers, F.col(defers) + (touched & ~full).cast("int"))


def ledger_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Add ``action``: write (new or changed), retire (gone) or keep."""
    b = before.select(key, F.struct(*columns).alias("_b"))
    a = after.select(key, F.struct(*columns).alias("_a"))
    action = F.when(F.col("_a").isNull(), "retire").when(~F.col("_a").eqNullSafe(F.col("_b")), "write").otherwise("keep")
    return b.join(a, key, "full_outer").select(key, action.alias("action"), F.coalesce("_a", "_b").alias("row")).select(key, "action", "row.*")


def replace_for_owner(target: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """An owner's new list takes the place of the old one."""
    return target.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def split_deleted(target: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed); a null condition keeps."""
    hit = F.coalesce(gone, F.lit(False))
    return target.filter(~hit), target.filter(hit)


def pruned_by_age(rows: DataFrame, day: str, today: Column, days: int) -> DataFrame:
    """Rows not older than the window, undated rows too."""
    return rows.filter(F.col(day).isNull() | (F.col(day) >= F.date_sub(today, days)))


def key_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A small state table as one map."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("state"))


def frozen_violations(before: DataFrame, after: DataFrame, key: str, text: str, status: str, terminal: Sequence[str] = ("broken", "resolved", "expired")) -> DataFrame:
    """Rows whose text changed or whose terminal status was left; they go to quarantine."""
    b = before.select(key, F.col(text).alias("_t"), F.col(status).alias("_s"))
    bad = (F.col(text) != F.col("_t")) | (F.col("_s").isin(list(terminal)) & (F.col(status) != F.col("_s")))
    return after.join(b, key).filter(bad).drop("_t", "_s")


def reaffirmed(rows: DataFrame, today: Column) -> DataFrame:
    """Rows with stored claim, new_claim, counts and horizons: one restatement more, the larger source count.

    A rewrite that drops numbers challenges a standing claim; a horizon is set once.
    """
    dropped = F.size(scalars.dropped_numbers(F.col("claim"), F.coalesce("new_claim", "claim"))) > 0
    horizon = F.coalesce("horizon_days", predicates.horizon_days(F.col("new_horizon_days")))
    return (
        rows.withColumn("restate_count", F.col("restate_count") + 1)
        .withColumn("source_count", F.greatest("source_count", F.coalesce(predicates.source_count(F.col("new_source_count")), F.lit(0))))
        .withColumn("last_reaffirmed", today)
        .withColumn("status", F.when((F.col("status") == "standing") & dropped, "challenged").otherwise(F.col("status")))
        .withColumn("resolution_date", F.when(F.col("horizon_days").isNull() & horizon.isNotNull(), F.date_add("first_seen", horizon)).otherwise(F.col("resolution_date")))
        .withColumn("horizon_days", horizon)
    )


def transition(old: Column, proposed: Column, evidence: Column, terminal: Sequence[str] = ("broken", "resolved", "expired")) -> Column:
    """A terminal status is final; broken needs evidence; an unknown proposal changes nothing."""
    allowed = predicates.enum_or_null(proposed, ["standing", "challenged", *terminal])
    has = F.length(F.trim(F.coalesce(evidence, F.lit("")))) > 0
    return F.when(old.isin(list(terminal)), old).when((allowed == "broken") & ~has, F.lit("challenged")).otherwise(F.coalesce(allowed, old))


def surviving(rows: DataFrame, today: Column, days: int = 7, bonus: int = 7) -> DataFrame:
    """T13's last step: a standing claim that wasn't reaffirmed for too long goes; high severity has longer."""
    age = F.datediff(today, "last_reaffirmed") - F.when(F.col("severity") == "high", bonus).otherwise(0)
    return rows.filter((F.col("status") != "standing") | (age <= days))


_JUDGED = "ledger string, pos long, id string, claim string, action string"


class _Alike:
    """Sets of words, found by Jaccard similarity: alike ones share one of their first words in a common order."""

    def __init__(self, rank: dict[str, int]):
        self.rank, self.by_word, self.known = rank, {}, {}

    def _first(self, words: frozenset) -> list[str]:
        keep = len(words) - math.ceil(scalars.DUPLICATE_JACCARD * len(words) - 1e-9) + 1
        return sorted(words, key=self.rank.__getitem__)[:keep]

    def add(self, words: frozenset) -> list:
        """The list that goes with the set."""
        if words and words not in self.known:
            self.known[words] = []
            for w in self._first(words):
                self.by_word.setdefault(w, []).append(words)
        return self.known.setdefault(words, [])

    def like(self, words: frozenset) -> Iterator[frozenset]:
        if words in self.known and words:
            yield words
        met = {y for w in self._first(words) for y in self.by_word.get(w, ()) if y != words} if words else ()
        yield from (y for y in met if len(words & y) >= scalars.DUPLICATE_JACCARD * len(words | y))


def merge_claims(prior: DataFrame, reply: DataFrame) -> DataFrame:
    """What each claim of a reply is: (ledger, id, claim, action).

    ``prior`` has (ledger, id, claim), ``reply`` (ledger, pos, id, claim, kind).  In the
    reply's order: a known id reaffirms its row (``reaffirm``); a claim equal to one this
    reply already gave is dropped (``repeat``); one equal to a row not yet returned reuses
    it (``reuse``); an observation is rejected (``reject``); anything else is new (``new``)
    with the next number.  Equal: the same numbers and nearly the same words.  Only claims with
    the same numbers bear on each other, so those of a ledger with the same numbers are a
    group, and in it claims meet by their rarest words alone.
    """
    words = lambda c: scalars.fingerprint_words(F.col(c))
    numbers = lambda c: scalars.fingerprint_numbers(F.col(c))
    p = prior.filter("id IS NOT NULL").groupBy("ledger", "id").agg(F.max("claim").alias("claim")).select("ledger", "id", words("claim").alias("w"), numbers("claim").alias("n"))
    r = reply.select("ledger", F.col("pos").cast("long").alias("pos"), "id", "claim", "kind", words("claim").alias("w"), numbers("claim").alias("n"))
    held = p.select("ledger", "id", F.col("w").alias("_w"), F.col("n").alias("_n"), F.lit(True).alias("known"))
    r = r.join(held, ["ledger", "id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    r = r.filter("known OR claim <> ''").select("ledger", "pos", "id", "claim", "kind", "known", F.coalesce("_w", "w").alias("w"), F.coalesce("_n", "n").alias("n"))
    old = p.select("ledger", F.lit(-1).cast("long").alias("pos"), "id", F.lit(None).cast("string").alias("claim"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("known"), "w", "n")
    rows = r.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True)))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(w=[frozenset(w) for w in group["w"]])
        uses = Counter(w for words in group["w"] for w in words)
        rank = {w: k for k, w in enumerate(sorted(uses, key=lambda w: (uses[w], w)))}
        given, waiting, taken, out = _Alike(rank), _Alike(rank), set(), []
        for x in group[group["old"]].sort_values("id").itertuples():
            waiting.add(x.w).append(x.id)
        for own in waiting.known.values():
            own.reverse()  # the first id last
        for x in group[~group["old"]].sort_values(["pos", "claim"]).itertuples():
            name, action = None, "new"
            if x.known:
                name, action = x.id, "reaffirm"
                taken.add(name)
            elif next(given.like(x.w), None) is not None:
                action = "repeat"
            else:
                first = None
                for y in waiting.like(x.w):
                    own = waiting.known[y]
                    while own and own[-1] in taken:
                        own.pop()
                    if own and (first is None or own[-1] < first[0]):
                        first = own[-1], y
                if first:
                    (name, twin), action = first, "reuse"
                    taken.add(name)
                    given.add(twin)
                elif x.kind == "observation":
                    action = "reject"
            if action in ("reaffirm", "new"):
                given.add(x.w)
            out.append((x.ledger, x.pos, name, x.claim, action))
        return pd.DataFrame(out, columns=["ledger", "pos", "id", "claim", "action"])

    judged = rows.groupBy("ledger", "n").applyInPandas(judge, _JUDGED)
    ends = prior.groupBy("ledger").agg(F.max(F.regexp_extract("id", r"^c-(\d+)$", 1).try_cast("long")).alias("_end"))
    before = Window.partitionBy("ledger").orderBy("pos", "claim").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged.join(ends, "ledger", "left").withColumn("_k", F.sum((F.col("action") == "new").cast("long")).over(before) + F.coalesce("_end", F.lit(0)))  # in the reply's order
    return rows.select("ledger", F.when(F.col("action") == "new", F.format_string("c-%04d", "_k")).otherwise(F.col("id")).alias("id"), "claim", "action")


def mark_to_market(positions: DataFrame, closes: DataFrame, today: Column, horizons: Sequence[int] = (7, 14, 28)) -> DataFrame:
    """Open positions (instrument, direction, entry_price, entry_date) with last price and return, checkpoints and status.

    ``closes``: (instrument, date, close).  The price of a day is the last close on or before
    it; implausible prices count as none; a position closes at the last horizon.
    """
    days = F.datediff(today, "entry_date")
    out = positions.withColumn("days_open", days)
    marks = positions.select("id", "instrument", "entry_price", "entry_date", "direction").join(closes, "instrument")
    marks = marks.filter((F.col("date") >= F.col("entry_date")) & (F.col("date") <= today) & predicates.plausible_mark(F.col("entry_price"), F.col("close")))
    last = lambda cond: F.max_by(F.when(cond, F.col("close")), F.when(cond, F.col("date")))
    points = [last(F.datediff("date", "entry_date") <= h).alias(f"price_{h}") for h in horizons]
    prices = marks.groupBy("id").agg(last(F.lit(True)).alias("last_price"), *points)
    out = out.join(prices, "id", "left").withColumn("last_return", scalars.signal_return(F.col("direction"), F.col("entry_price"), F.col("last_price")))
    for h in horizons:
        out = out.withColumn(f"return_{h}", F.when(F.col("days_open") >= h, scalars.signal_return(F.col("direction"), F.col("entry_price"), F.col(f"price_{h}")))).drop(f"price_{h}")
    return out.withColumn("status", F.when(F.col("days_open") >= max(horizons), "closed").otherwise("open"))


def admitted(signals: DataFrame, book: DataFrame) -> DataFrame:
    """Signals (pos, asset_class, ticker, direction) with ``reason``: open, repeat, held or opposite_held."""
    first = F.row_number().over(Window.partitionBy("asset_class", "ticker").orderBy("pos")) == 1
    held = book.filter("status = 'open'").groupBy("asset_class", "ticker").agg(F.max("direction").alias("held"))
    rows = signals.withColumn("_f", first).join(held, ["asset_class", "ticker"], "left")
    reason = F.when(F.col("held") == F.col("direction"), "held").when(F.col("held").isNotNull(), "opposite_held").when(~F.col("_f"), "repeat").otherwise("open")
    return rows.withColumn("reason", reason).drop("_f", "held")


def previous_fire(now: Column, every_minutes: int | None = None, at_minutes: int | None = None) -> Column:
    """Seconds of the latest due time: an interval counted from midnight, or a time of day."""
    seconds, day = F.unix_timestamp(now), F.floor(F.unix_timestamp(now) / 86400) * 86400
    if every_minutes:
        return (day + F.floor((seconds - day) / (60 * every_minutes)) * 60 * every_minutes).cast("long")
    due = day + 60 * at_minutes
    return F.when(due > seconds, due - 86400).otherwise(due).cast("long")


def next_fire(now: Column, every_minutes: int | None = None, at_minutes: int | None = None) -> Column:
    """Strictly after now; an interval starts afresh at midnight."""
    seconds, day = F.unix_timestamp(now), F.floor(F.unix_timestamp(now) / 86400) * 86400
    if every_minutes:
        return F.least(previous_fire(now, every_minutes) + 60 * every_minutes, day + 86400).cast("long")
    due = day + 60 * at_minutes
    return F.when(due <= seconds, due + 86400).otherwise(due).cast("long")


def fire_decision(now: Column, due: Column, last: Column, grace_minutes: int) -> Column:
    """Skip what was recorded, run inside the grace, else missed."""
    return F.when(last >= due, "skip").when(F.unix_timestamp(now) - due <= 60 * grace_minutes, "run").otherwise("missed")


def pass_liveness(runs: DataFrame, now: Column, interval_minutes: int, tolerance: int = 3) -> DataFrame:
    """``stale`` when the newest start is too old or there is none, ``crashed`` when an older run never finished."""
    newest = F.max("started_at")
    rows = runs.agg(newest.alias("newest"), F.max_by("finished_at", "started_at").alias("_f"), F.count_if(F.col("finished_at").isNull()).alias("open"))
    late = F.unix_timestamp(now) - F.unix_timestamp("newest") > tolerance * interval_minutes * 60
    older = F.col("open") - F.when(F.col("newest").isNotNull() & F.col("_f").isNull(), 1).otherwise(0)
    return rows.select(F.coalesce(late, F.lit(True)).alias("stale"), (older > 0).alias("crashed"))


def alert_once(rows: DataFrame, key: str, at: str, episode: str, idle_hours: float | None = None) -> DataFrame:
    """Rows whose episode isn't null and differs from the one before; a null episode clears it, and so does a silence of over ``idle_hours``."""
    order = Window.partitionBy(key).orderBy(at)
    before = F.lag(episode).over(order)
    if idle_hours is not None:
        silent = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp")) > int(idle_hours * 3_600_000_000)
        before = F.when(~F.coalesce(silent, F.lit(False)), before)
    return rows.withColumn("_b", before).filter(F.col(episode).isNotNull() & ~F.col(episode).eqNullSafe(F.col("_b"))).drop("_b")
