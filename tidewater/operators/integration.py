"""Operators around the matching of new items to what is known: triage, candidates, ceilings and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import graph, topk

# Verdicts on a claim, and those that flag it.
VERDICTS = ("supported", "unsupported", "contradicted", "overstated", "unverifiable")
FLAGS = ("unsupported", "contradicted", "overstated")
RULE_REASONS = ("tracked_claim", "tracked_story")


def triage_by_rules(hits: DataFrame, item: str, reason: str, order: Sequence[str], rest: Sequence[str], reasons: Sequence[str] = RULE_REASONS) -> DataFrame:
    """The first hit of each item whose reason is a rule; items without one give no row."""
    ruled = hits.filter(F.col(reason).isin(list(reasons)))
    first = ruled.groupBy(item).agg(F.min_by(F.struct(reason, *rest), F.struct(*order)).alias("_h"))
    return first.select(item, f"_h.{reason}", *[f"_h.{c}" for c in rest])


def picked_entity(rows: DataFrame, request: str, wanted: str, ticker: str, kind: str, identity: str, position: str) -> DataFrame:
    """The id of the row whose ticker is the wanted one in any case, public ones first, then by position."""
    same = rows.filter(F.upper(ticker) == F.upper(wanted))
    private = F.coalesce(F.col(kind) != "PUBLIC", F.lit(True))
    return same.groupBy(request).agg(F.min_by(identity, F.struct(private, F.col(position))).alias(identity))


def candidate_pool(events: DataFrame, links: DataFrame, wanted: DataFrame, days: int = 14) -> DataFrame:
    """(request, event, occurred_at, entities): every event that a request could be matched to, uncapped.

    ``wanted`` has request, entity and at, one row per entity of the set; ``links`` has event
    and entity; ``events`` has event, occurred_at and created_at.  An event counts if it has
    one of the entities, was known before ``at`` and happened at most ``days`` days earlier.
    An empty set has no candidates.

    Dates are dealt into spans; only events and requests of one span or of neighbouring ones
    meet.  One known before it happened stands in all spans between.
    """
    sets = links.groupBy("event").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    timed = events.select("event", "occurred_at", "created_at").join(links.select("event", "entity").distinct(), "event")
    near = (F.col("occurred_at") >= F.col("at") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") < F.col("at"))
    # Two days longer than asked for, so that a change of the clock parts nothing.
    span = lambda c: F.floor(F.unix_date(F.to_date(c)) / (days + 2))
    stands = F.when(F.col("created_at") >= F.col("occurred_at"), F.array(span("occurred_at"))).otherwise(F.sequence(span("created_at"), span("occurred_at")))
    asked = wanted.select("request", "entity", "at").distinct().withColumn("_span", F.explode(F.array(span("at"), span("at") - 1)))
    met = timed.withColumn("_span", F.explode(stands)).join(asked, ["entity", "_span"]).filter(near)
    return met.select("request", "event", "occurred_at").distinct().join(sets, "event").select("request", "event", "occurred_at", "entities")


def batch_overlap(pool: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """Each request's ``cap`` events that share most entities with all of its batch, then the newest, then the largest id.

    ``pool`` is what ``candidate_pool`` gives; ``wanted`` has request and entity of any number
    of items.  Events that share nothing come last with overlap 0.
    """
    batches = wanted.groupBy("request").agg(F.collect_set("entity").alias("_wanted"))
    shared = F.size(F.array_intersect("entities", F.coalesce("_wanted", F.array()))).cast("long")
    scored = pool.join(batches, "request", "left").select("request", "event", "occurred_at", shared.alias("overlap"))
    return topk.top_k_per_key(scored, ["request"], [F.desc("overlap"), F.desc("occurred_at"), F.desc("event")], cap)


def candidate_entities(hits: DataFrame, batch: str, entity: str, cap: int = 40) -> DataFrame:
    """J44's entities: a batch's ``cap`` newest (largest) distinct entities, and ``capped`` where there were more.

    The events of the same call are ``candidate_pool`` over these, ranked by ``joins.trigram_top_k``.
    """
    found = hits.filter(F.col(entity).isNotNull()).select(batch, entity).distinct()
    more = found.groupBy(batch).agg((F.count("*") > cap).alias("capped"))
    return topk.top_k_per_key(found, [batch], [F.desc(entity)], cap).drop("rank").join(more, batch)


def outlet_ceiling(pairs: DataFrame, outlets: DataFrame, events: DataFrame) -> DataFrame:
    """(rate, events_after, multi_after): the share of events with two outlets if all duplicates were merged.

    ``pairs`` has a and b, ``outlets`` event and outlet, ``events`` event.  A cluster of k events
    becomes one; it counts once if its events have two outlets together, whether or not some had them before.
    """
    per_event = outlets.groupBy("event").agg(F.countDistinct("outlet").alias("n"))
    members = graph.connected_components(pairs, "a", "b").withColumnRenamed("id", "event")
    before = events.select("event").distinct().join(per_event, "event", "left").agg(F.count("*").alias("total"), F.count_if(F.col("n") >= 2).alias("multi"))
    merged = members.join(per_event, "event", "left").groupBy("component").agg(F.count("*").alias("size"), F.count_if(F.col("n") >= 2).alias("were"))
    union = members.join(outlets, "event").groupBy("component").agg(F.countDistinct("outlet").alias("union"))
    inside = merged.join(union, "component", "left").agg(
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("merges"), F.coalesce(F.sum("were"), F.lit(0)).alias("were"), F.count_if(F.col("union") >= 2).alias("become")
    )
    after = F.greatest(F.lit(1), F.col("total") - F.least("merges", F.greatest(F.lit(0), F.col("total") - 1)))
    counted = before.join(inside, F.lit(True)).select(after.alias("events_after"), (F.col("multi") - F.col("were") + F.col("become")).alias("multi_after"))  # one row each
    return counted.select((F.col("multi_after") / F.col("events_after")).alias("rate"), "events_after", "multi_after")


def scored_grid(results: DataFrame, keys: Sequence[str], primary: Column, floor: float = 0.03) -> DataFrame:
    """One row per cell: best_horizon, ic and hit_rate (null where unconfirmed), n, and sign_ok.

    ``sign_ok`` is yes or no in cells that were registered beforehand (``primary``) and
    confirmed, else null.  A correlation of 0 has the sign of a negative one.
    """
    right = ((F.col("ic") > 0) == (F.col("expected_sign") > 0)) & (F.abs("ic") > floor)
    verdict = F.when(primary & F.col("ic").isNotNull(), F.when(right, "yes").otherwise("no"))
    return results.select(*keys, "best_horizon", "ic", "hit_rate", F.when(F.col("ic").isNotNull(), F.col("n")).otherwise(0).alias("n"), verdict.alias("sign_ok"))


def half_split(windows: DataFrame, split: Column) -> DataFrame:
    """Complete windows of the first pass before and after an instant, by their start.

    ``windows`` has start, pass, status, items, multi, yes and asked.  Both halves have a row;
    one without windows has count 0 and null means.
    """
    done = windows.filter((F.col("pass") == 1) & (F.col("status") == "complete") & F.col("start").isNotNull())
    stats = done.groupBy(F.when(F.col("start") < split, "before").otherwise("after").alias("half")).agg(
        F.count("*").alias("windows"), F.avg("items").alias("mean_items"), F.avg("multi").alias("mean_multi"), F.sum("yes").alias("yes"), F.sum("asked").alias("asked")
    )
    halves = windows.sparkSession.createDataFrame([("before",), ("after",)], "half string")
    return halves.join(stats, "half", "left").fillna(0, ["windows", "yes", "asked"])


def last_run(runs: DataFrame, at: str, run: str) -> DataFrame:
    """The newest run, the larger id of two at one time; no row where there is none."""
    return runs.orderBy(F.col(at).desc_nulls_last(), F.desc(run)).limit(1)


def verification_report(records: DataFrame) -> DataFrame:
    """One row over all day records (date, n_claims, counts map, claims array of verdict and reason).

    Columns: days, n_claims, a total for each verdict, flagged_total, flag_rate (0 without
    claims), unreasoned_flags (flagged claims without a reason) and unreasoned_rate.
    """
    counted = [F.coalesce(F.sum(F.coalesce(F.try_element_at("counts", F.lit(v)), F.lit(0))), F.lit(0)).cast("long").alias(v) for v in VERDICTS]
    flagged = F.filter("claims", lambda c: c["verdict"].isin(list(FLAGS)))
    bare = F.filter(flagged, lambda c: F.trim(F.coalesce(c["reason"], F.lit(""))) == "")
    size = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0)).cast("long")), F.lit(0))
    rows = records.withColumn("claims", F.coalesce("claims", F.array().cast(records.schema["claims"].dataType)))
    total = rows.agg(F.count("*").alias("days"), F.coalesce(F.sum("n_claims"), F.lit(0)).cast("long").alias("n_claims"), *counted, size(flagged).alias("_f"), size(bare).alias("unreasoned_flags"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = total.withColumn("flagged_total", sum((F.col(v) for v in FLAGS), F.lit(0)))
    return total.withColumn("flag_rate", rate(F.col("flagged_total"), F.col("n_claims"))).withColumn("unreasoned_rate", rate(F.col("unreasoned_flags"), F.col("_f"))).drop("_f")


def replayed(operator: Callable[[DataFrame], DataFrame], rows: DataFrame, at: str, as_of: Column) -> DataFrame:
    """What an operator would have said at ``as_of``: it sees the rows up to that instant."""
    return operator(rows.filter(F.col(at) <= as_of))
