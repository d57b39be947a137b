"""One pass over pending items: budget, triage, the writing of what a model returned, and the density sweep."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import sampling

MONEY = "decimal(28,8)"


def open_budget(state: DataFrame, now: Column, allowance: float, max_days: float) -> DataFrame:
    """(key, balance, at, exhausted_on) after accruing up to ``now``.

    The allowance a day flows in up to ``max_days`` of it.  A clock that went back accrues
    nothing.  A balance or time that is null, not a number or infinite starts afresh with one
    day's allowance, within the cap.
    """
    cap, balance = F.lit(float(allowance * max_days)), F.col("balance").try_cast("double")
    at = F.col("at").try_cast("timestamp")
    usable = balance.isNotNull() & ~F.isnan(balance) & (F.abs(balance) != F.lit(float("inf"))) & at.isNotNull()
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at)) / F.lit(86400e6))
    accrued = F.when(usable, F.least(cap, balance + F.lit(float(allowance)) * days)).otherwise(F.least(cap, F.lit(float(allowance))))
    return state.select("key", accrued.alias("balance"), now.cast("timestamp").alias("at"), F.when(usable, F.col("exhausted_on")).alias("exhausted_on"))


def triage_pass(pending: DataFrame, rules: DataFrame, replies: DataFrame, budget: DataFrame, batch: int, most: int | None = None) -> DataFrame:
    """(key, item, verdict, reason, batch, cost) of the items that the pass decides; the others stay pending.

    ``pending`` has key, item, stale and quote; ``rules`` (P08) item and reason; ``replies`` item,
    material, failed and cost; ``budget`` key and balance.  In this order an item is stale, a
    quote page, found by a rule, or put to the model, newest first in batches of a key.  A batch
    is asked while the balance less the cost of those before it is positive; a key without a
    budget asks none.  One failed reply fails its batch; an item without a reply is immaterial.
    Null flags are false; repeated items count once.  ``most`` is the pass's limit for a key.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    items = pending.groupBy("key", "item").agg(F.bool_or(flag("stale")).alias("stale"), F.bool_or(flag("quote")).alias("quote"))
    if most is not None:
        items = items.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("item")))).filter(F.col("_r") <= most).drop("_r")
    found = rules.groupBy("item").agg(F.min("reason").alias("rule"))
    sorted_out = items.join(found, "item", "left").withColumn(
        "reason", F.when(F.col("stale"), "stale").when(F.col("quote"), "quote_page").otherwise(F.col("rule"))
    )
    by_rule = sorted_out.filter("reason IS NOT NULL").select(
        "key", "item", F.when(F.col("stale"), "stale").when(F.col("quote"), "immaterial").otherwise("material").alias("verdict"), "reason", F.lit(None).cast("long").alias("batch"), F.lit(0).cast(MONEY).alias("cost")
    )
    answer = replies.groupBy("item").agg(F.bool_or(flag("material")).alias("material"), F.bool_or(flag("failed")).alias("failed"), F.sum(F.col("cost").cast(MONEY)).cast(MONEY).alias("cost"))
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("item")))
    asked = sorted_out.filter("reason IS NULL").select("key", "item", F.floor((at - 1) / batch).alias("batch")).join(answer, "item", "left")
    before = Window.partitionBy("key").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    batches = asked.groupBy("key", "batch").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY).alias("_cost"), F.bool_or(flag("failed")).alias("_failed"))
    batches = batches.withColumn("_spent", F.coalesce(F.sum("_cost").over(before), F.lit(0)).cast(MONEY)).join(budget.select("key", F.col("balance").cast(MONEY).alias("_balance")), "key")
    by_model = asked.join(batches.filter("_balance - _spent > 0"), ["key", "batch"]).select(
        "key", "item",
        F.when(F.col("_failed"), "failed").when(flag("material"), "material").otherwise("immaterial").alias("verdict"),
        F.when(F.col("_failed"), "error").when(flag("material"), "topical").otherwise("none").alias("reason"),
        "batch", F.coalesce("cost", F.lit(0)).cast(MONEY).alias("cost"),
    )
    return by_rule.unionByName(by_model)


def resolved_batch(items: DataFrame, events: DataFrame, entities: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """What a model returned, one row per item: (request, item, status, events, entities).

    ``items`` has request, item (one row each), position and published_at; ``events`` item,
    position, candidate_id or new_ref or neither, new_label, summary, type, standing and valid;
    ``entities`` item and entity, null where it was refused; ``done`` the items written before.
    An event is a known one (candidate_id), one that an earlier written item of the request
    declared under a label, the last such counts (new_ref), or new; a new one is named by its
    item and place, so that a repeated run names it alike.  An item is written whole or not at all:

    already     in ``done``                       deferred    refers to a label nobody declared
    empty       no entities and no events         entityless  no entities, but a new event
    refused     every entity was refused          rejected    an event isn't valid
    written     none of these

    Only written items declare labels.  A request is one call, so the items folded together are few.
    """
    ev = events.groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("position", F.col("candidate_id").cast("string").alias("candidate"), "new_ref", "new_label", "summary", "type", "standing", F.coalesce("valid", F.lit(True)).alias("valid")))).alias("_ev")
    )
    en = entities.groupBy("item").agg(F.count("*").alias("_offered"), F.array_sort(F.collect_set("entity")).alias("entities"))
    rows = items.select("request", "item", "position", F.coalesce("published_at", now).alias("occurred_at")).join(ev, "item", "left").join(en, "item", "left")
    rows = rows.join(done.select("item").distinct().withColumn("_done", F.lit(True)), "item", "left")
    fresh = F.exists("_ev", lambda e: e.candidate.isNull() & e.new_ref.isNull())
    none_offered = F.coalesce("_offered", F.lit(0)) == 0
    verdict = (
        F.when(none_offered & F.col("_ev").isNull(), "empty")
        .when(none_offered & fresh, "entityless")
        .when(~none_offered & (F.size("entities") == 0), "refused")
        .when(F.exists("_ev", lambda e: ~e.valid), "rejected")
        .otherwise("written")
    )
    rows = rows.withColumn("verdict", verdict).withColumn("_ev", F.coalesce("_ev", F.array())).withColumn("entities", F.coalesce("entities", F.array()))
    call = rows.groupBy("request").agg(
        F.sort_array(F.collect_list(F.struct("position", "item", "occurred_at", F.coalesce("_done", F.lit(False)).alias("done"), "verdict", F.col("_ev").alias("ev"), "entities"))).alias("_items")
    )

    def step(labels: Column, x: Column) -> Column:
        def named(e: Column, at: Column) -> Column:
            declared = F.try_element_at(F.filter(labels, lambda d: d.label == e.new_ref), F.lit(-1)).event
            own = F.concat(x.item.cast("string"), F.lit("#"), at.cast("string"))
            name = F.coalesce(e.candidate, F.when(e.new_ref.isNotNull(), declared).otherwise(own))
            return F.struct(name.alias("event"), (e.candidate.isNull() & e.new_ref.isNull()).alias("is_new"), e.new_label.alias("label"), e.summary.alias("summary"), e.type.alias("type"), e.standing.alias("standing"))

        return F.transform(x.ev, named)

    def status(x: Column, named: Column) -> Column:
        return F.when(x.done, "already").when(F.exists(named, lambda e: e.event.isNull()), "deferred").otherwise(x.verdict)

    def declared(labels: Column, line: Column) -> Column:
        own = F.transform(F.filter(line.events, lambda e: e.label.isNotNull()), lambda e: F.struct(e.label.alias("label"), e.event.alias("event")))
        return F.when(line.status == "written", F.concat(labels, own)).otherwise(labels)

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed once, however often it is named there."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def fold(acc: Column, x: Column) -> Column:
        line = lambda named: F.struct(x.item.alias("item"), x.occurred_at.alias("occurred_at"), status(x, named).alias("status"), named.alias("events"), x.entities.alias("entities"))
        return once(once(step(acc.labels, x), line), lambda l: F.struct(declared(acc.labels, l).alias("labels"), F.concat(acc.lines, F.array(l)).alias("lines")))

    item, entity, at = items.schema["item"].dataType.simpleString(), entities.schema["entity"].dataType.simpleString(), rows.schema["occurred_at"].dataType.simpleString()
    lines = f"array<struct<item:{item},occurred_at:{at},status:string,events:array<struct<event:string,is_new:boolean,label:string,summary:string,type:string,standing:string>>,entities:array<{entity}>>>"
    start = F.struct(F.array().cast("array<struct<label:string,event:string>>").alias("labels"), F.array().cast(lines).alias("lines"))
    return call.select("request", F.explode(F.aggregate("_items", start, fold, lambda acc: acc.lines)).alias("_l")).select("request", "_l.*")


def new_events(batch: DataFrame) -> DataFrame:
    """(event, summary, type, occurred_at) of the events that written items of ``resolved_batch`` are the first to tell."""
    told = batch.filter("status = 'written'").select("occurred_at", F.explode("events").alias("e")).filter("e.is_new")
    return told.select("e.event", "e.summary", "e.type", "occurred_at")


def new_links(batch: DataFrame, links: DataFrame) -> DataFrame:
    """(event, entity) of written items that aren't among the links."""
    told = batch.filter("status = 'written'").select("entities", F.explode("events.event").alias("event"))
    return told.select("event", F.explode("entities").alias("entity")).distinct().join(links, ["event", "entity"], "left_anti")


def new_assertions(batch: DataFrame, assertions: DataFrame) -> DataFrame:
    """(item, event, standing) of written items, the first of an item and event, that aren't there yet."""
    told = batch.filter("status = 'written'").select("item", F.posexplode("events").alias("at", "e"))
    first = told.groupBy("item", F.col("e.event").alias("event")).agg(F.min_by(F.col("e.standing"), F.col("at")).alias("standing"))
    return first.join(assertions, ["item", "event"], "left_anti")


def density_sweep(items: DataFrame, keep: Column, hour: Column, rates: Sequence[int], seeds: Sequence[str], measure: Callable[[DataFrame], DataFrame], tolerance: float = 0.05) -> DataFrame:
    """How visible pairs are when items are thinned (R06) to some rates, over all seeds.

    ``measure`` takes thinned items and gives (variant, baseline, visible), a row per pair and
    variant.  Per rate and variant: mean items an hour with any, mean, least and largest share
    of the baseline, mean share of the variant, mean gap and whether it stays within the
    tolerance.  Rates and seeds are short lists; each is a branch of one plan.
    """
    def run(rate: int, seed: str) -> DataFrame:
        kept = sampling.thinned(items, keep, hour, "item", rate, seed)
        size = kept.agg(F.count("*").alias("_n"))
        shares = measure(kept).groupBy("variant").agg(F.avg(F.col("baseline").cast("int")).alias("_b"), F.avg(F.col("visible").cast("int")).alias("_v"))
        return shares.crossJoin(F.broadcast(size)).select(F.lit(rate).alias("rate"), F.lit(seed).alias("seed"), "*")  # one row

    hours = items.agg(F.countDistinct(hour).alias("_hours"))
    runs = reduce(DataFrame.unionByName, [run(r, s) for r in rates for s in seeds]).crossJoin(F.broadcast(hours))  # one row
    gap = F.avg(F.col("_v") - F.col("_b"))
    return runs.groupBy("rate", "variant").agg(
        F.avg(F.col("_n") / F.greatest(F.col("_hours"), F.lit(1))).alias("per_hour"), F.avg("_b").alias("baseline"), F.min("_b").alias("baseline_min"),
        F.max("_b").alias("baseline_max"), F.avg("_v").alias("share"), gap.alias("gap"), (gap >= -tolerance - 1e-9).alias("within"),
    )
