"""Writes with rules: entities that resolve, a load that happens once, logs that refuse what doesn't fit.

Each function takes the old tables and the new rows and returns what to append and what was
refused, and why.  Sets of tables that must change together go through ``tableset.TableSet``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import windows
from tidewater.operators.graph import cut, written

# Fixed values.
DECISIONS = ["same", "different", "unsure"]
OPEN_STATES = ["prepared", "open"]
#: Why an action is refused, the first that holds.
REFUSALS = ["closed", "repeated_item", "foreign_item", "foreign_group"]


@dataclass(frozen=True)
class Entities:
    """resolved: (spec, entity, outcome); created: rows to append; refused: (spec, name, type, reason)."""

    resolved: DataFrame
    created: DataFrame
    refused: DataFrame


def resolve_entities(specs: DataFrame, entities: DataFrame, symbols: DataFrame) -> Entities:
    """An id for each spec (spec, candidate, name, type, aliases): a candidate's, a known entity's or a new one's.

    An entity is known by its lower-case name and type; of several the smallest id stands.
    Spellings that differ in case are one entity, within the batch too: the first spec (by
    ``spec``) gives the name and the aliases.  New ids go on from the largest, in the order
    of the specs that name them.  ``symbols`` has (entity, symbol): an instrument may not
    take the symbol of a known company.  A spec without candidate, name or type is refused.
    """
    key = F.lower("name")
    companies = symbols.join(entities.filter("type = 'company'").select("entity"), "entity", "left_semi").select(F.lower("symbol").alias("key")).distinct()
    new = specs.filter("candidate IS NULL").withColumn("key", key)
    shadowed = new.filter("type = 'instrument'").join(companies, "key", "left_semi").select("spec", F.lit("company_symbol").alias("reason"))
    nameless = new.filter("name IS NULL OR type IS NULL OR trim(name) = ''").select("spec", F.lit("no_name").alias("reason"))
    reasons = nameless.unionByName(shadowed).groupBy("spec").agg(F.min("reason").alias("reason"))
    refused = specs.join(reasons, "spec").select("spec", "name", "type", "reason")
    asked = new.join(reasons, "spec", "left_anti")
    known = entities.groupBy(key.alias("key"), "type").agg(F.min("entity").alias("_known"))
    first = asked.groupBy("key", "type").agg(F.min("spec").alias("_first"), F.min_by(F.struct("name", "aliases"), "spec").alias("_s"))
    fresh = first.join(known, ["key", "type"], "left_anti")
    top = entities.agg(F.coalesce(F.max("entity"), F.lit(0)).alias("_top"))
    made = cut(windows.global_rank(fresh, [F.col("_first")], "_place").crossJoin(F.broadcast(top)).withColumn("_made", F.col("_top") + F.col("_place")))
    found = asked.join(known, ["key", "type"], "left").join(made.select("key", "type", "_made", "_first"), ["key", "type"], "left")
    outcome = F.when(F.col("_known").isNotNull(), "known").when(F.col("_first") == F.col("spec"), "created").otherwise("known")
    resolved = found.select("spec", F.coalesce("_known", "_made").alias("entity"), outcome.alias("outcome"))
    given = specs.filter("candidate IS NOT NULL").select("spec", F.col("candidate").alias("entity"), F.lit("candidate").alias("outcome"))
    return Entities(given.unionByName(resolved), made.select(F.col("_made").alias("entity"), F.col("_s.name").alias("name"), "type", F.coalesce("_s.aliases", F.array().cast("array<string>")).alias("aliases")), refused)


@dataclass(frozen=True)
class Load:
    """landed: rows to append; rejected: rows with ``reason``; record: one row (load, expected, landed, rejected), none where it is done."""

    landed: DataFrame
    rejected: DataFrame
    record: DataFrame


def import_once(target: DataFrame, rows: DataFrame, loads: DataFrame, load: str, key: str, checks: Mapping[str, Column], defaults: Mapping[str, Column] | None = None) -> Load:
    """Bring in old rows once: only while the target is empty and ``loads`` has no record of this load.

    ``defaults`` fill columns in, in order, before ``checks`` (reason to condition that must
    hold; a null one doesn't) are asked; the first that fails is the row's reason.  A row
    without ``key`` is rejected as no_key, and of rows with one key all but the first by
    their columns as repeated.  The three results belong in one commit.
    """
    done = target.limit(1).select(F.lit(1).alias("_x")).unionByName(loads.filter(F.col("load") == load).limit(1).select(F.lit(1).alias("_x")))
    guard = done.agg(F.count("*").alias("_done"))
    rows = rows.crossJoin(F.broadcast(guard)).filter("_done = 0").drop("_done")  # one row
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, value)
    reason = F.when(F.col(key).isNull(), "no_key")
    for name, holds in checks.items():
        reason = reason.when(~F.coalesce(holds, F.lit(False)), name)
    judged = rows.withColumn("reason", reason)
    columns = [c for c in rows.columns if c != key]
    good = judged.filter("reason IS NULL").groupBy(key).agg(F.min(F.struct(*columns)).alias("_first"), F.count("*").alias("_n"))
    landed = good.select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])
    extra = good.filter("_n > 1").select(key, F.explode(F.sequence(F.lit(2), F.col("_n"))).alias("_k")).select(F.col(key).cast("string").alias("key"), F.lit("repeated").alias("reason"))
    rejected = judged.filter("reason IS NOT NULL").select(F.col(key).cast("string").alias("key"), "reason").unionByName(extra)
    sums = good.agg(F.count("*").alias("landed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_good")).crossJoin(judged.agg(F.count("*").alias("expected"))).crossJoin(guard)
    record = sums.filter("_done = 0").select(F.lit(load).alias("load"), "expected", "landed", (F.col("expected") - F.col("landed")).alias("rejected"))
    return Load(landed, rejected, record)


@dataclass(frozen=True)
class Appended:
    """rows: to append; refused: with ``reason``; windows: the windows whose status changes."""

    rows: DataFrame
    refused: DataFrame
    windows: DataFrame


_ACTION = ["window", "tab", "seq", "at"]


def append_assignments(log: DataFrame, actions: DataFrame, opened: DataFrame, members: DataFrame, groups: DataFrame) -> Appended:
    """Log rows of actions (window, tab, seq, at, item, group, unsure) that fit.

    Rows that share window, tab, seq and at are one action, taken whole or not at all.  It
    is refused as closed (its window isn't in ``opened``: window, status, blind_done,
    opened_at; or is neither prepared nor open, or its blind pass is over), repeated_item,
    foreign_item (not in ``members``: window, item) or foreign_group (its group isn't the
    window's in ``groups``: window, group).  A row whose (window, tab, seq, item) is in the
    log, or in an earlier action that fits, is a retry: ignored without a word.  The first
    fitting action opens its window.  Rows are judged and written once, and the three
    results are read from there; those of one window, tab and seq are few, a task takes them
    together.
    """
    state = opened.select("window", (F.col("status").isin(OPEN_STATES) & ~F.coalesce(F.col("blind_done"), F.lit(False))).alias("_open"))
    rows = actions.join(state, "window", "left")
    rows = rows.join(members.select("window", "item").distinct().withColumn("_member", F.lit(True)), ["window", "item"], "left")
    rows = rows.join(groups.select("window", "group").distinct().withColumn("_own", F.lit(True)), ["window", "group"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    # What speaks against a row, as its place among the reasons; an action's is the least of its rows.
    against = F.when(~yes("_open"), 0).when(~yes("_member"), 2).when(F.col("group").isNotNull() & ~yes("_own"), 3)
    rows = rows.select(*_ACTION, "item", "group", "unsure", against.alias("_why"), F.lit(False).alias("_old"))
    key = ["window", "tab", "seq", "item"]
    old = log.select(*key, F.lit(True).alias("_old")).dropna(subset=key)
    rows = rows.unionByName(old, allowMissingColumns=True).repartition("window", "tab", "seq")
    action = Window.partitionBy(*_ACTION, "_old")
    place, before = F.row_number().over(action.orderBy("item")), F.lag("item").over(action.orderBy("item"))
    rows = rows.withColumn("_place", place).withColumn("_again", (F.col("_place") > 1) & before.eqNullSafe(F.col("item")))
    why = F.least(F.min("_why").over(action), F.min(F.when(F.col("_again"), 1)).over(action))
    rows = rows.withColumn("_why", why).withColumn("reason", reduce(lambda r, k: r.when(F.col("_why") == k, REFUSALS[k]), range(len(REFUSALS)), F))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.when(F.col("_old"), 0).when(F.col("reason").isNull(), 1).otherwise(2), "at", "group", "unsure"))
    rows = rows.withColumn("_fresh", F.col("reason").isNull() & (turn == 1)).withColumn("_head", F.col("_place") == 1)
    judged = written(rows.filter("NOT _old AND (_fresh OR _head)").select(*_ACTION, "item", "group", "unsure", "reason", "_fresh", "_head"), "actions")
    fresh = judged.filter("_fresh").select(*key, "group", F.coalesce("unsure", F.lit(False)).alias("unsure"), "at")
    heads = judged.filter("_head").select(*_ACTION, "reason")
    first = heads.filter("reason IS NULL").groupBy("window").agg(F.min("at").alias("_at"))
    moved = opened.join(first, "window").withColumn("status", F.lit("open")).withColumn("opened_at", F.coalesce("opened_at", "_at")).drop("_at")
    return Appended(fresh, heads.filter("reason IS NOT NULL"), moved)


def adjudicate(decided: DataFrame, decisions: DataFrame, offered: DataFrame, windows_: DataFrame, kinds: Sequence[str] = tuple(DECISIONS)) -> Appended:
    """Decisions (window, item_a, item_b, decision, at) on offered pairs, written with a < b, one a pair.

    Refused: unknown_decision, not_offered (the pair isn't in ``offered``: window, a, b with
    a < b) and answered (``decided`` has the pair, or an earlier decision took it; of two at
    one time the smaller word).  A window is complete when no offered pair is left.
    """
    pair = ["window", "a", "b"]
    rows = decisions.select("window", F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b"), "decision", "at")
    rows = rows.join(offered.select(*pair).distinct().withColumn("_offered", F.lit(True)), pair, "left").join(decided.select(*pair).distinct().withColumn("_old", F.lit(True)), pair, "left")
    known = F.coalesce(F.col("decision").isin(list(kinds)), F.lit(False))
    rows = rows.withColumn("reason", F.when(~known, "unknown_decision").when(F.col("_offered").isNull(), "not_offered").when(F.col("_old"), "answered"))
    open_ = rows.filter("reason IS NULL").groupBy(*pair).agg(F.min(F.struct("at", "decision")).alias("_r"), F.count("*").alias("_n"))
    fresh = open_.select(*pair, F.col("_r.decision").alias("decision"), F.col("_r.at").alias("at"))
    late = open_.filter("_n > 1").select(*pair, (F.col("_n") - 1).alias("n"), F.lit("answered").alias("reason"))
    refused = rows.filter("reason IS NOT NULL").groupBy(*pair, "reason").agg(F.count("*").alias("n")).unionByName(late.select(*pair, "reason", "n"))
    refused = refused.groupBy(*pair, "reason").agg(F.sum("n").alias("n"))
    answered = decided.select(*pair).unionByName(fresh.select(*pair)).distinct()
    left = offered.select(*pair).distinct().join(answered, pair, "left_anti").select("window").distinct()
    last = fresh.groupBy("window").agg(F.max("at").alias("_at"))
    done = windows_.join(last, "window").join(left, "window", "left_anti").withColumn("status", F.lit("complete")).withColumn("completed_at", F.col("_at")).drop("_at")
    return Appended(fresh, refused, done)
