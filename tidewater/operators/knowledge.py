"""Operators on extractions, responses, census logs and rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import predicates, scalars
from tidewater.operators import graph, joins, topk, windows

#: What an extraction response looks like, for from_json.
EXTRACTION = """array<struct<item_id: bigint, entities: array<struct<candidate_id: string, name: string, type: string, aliases: array<string>>>,
 events: array<struct<candidate_id: string, new_ref: string, new_label: string, summary: string, type: string, commitment_state: string, standing: string>>>>"""
EVENT_TYPES = ["action", "statement", "disclosure"]


def validated_extractions(responses: DataFrame, offered: DataFrame, entity_labels: Column, event_labels: Column, json: str = "json") -> DataFrame:
    """Rows of responses (request, json) with ``reason``: null for a good row, else its first defect.

    ``offered``: (request, item_id).  Labels are arrays of what was offered.  A row may also
    refer to a label that an earlier row of its response declared, never to a later one.
    """
    rows = responses.select("request", F.posexplode_outer(F.from_json(json, EXTRACTION)).alias("pos", "row")).select("request", "pos", "row.*")
    known = offered.select("request", "item_id", F.lit(True).alias("known"))
    rows = rows.join(known, ["request", "item_id"], "left")
    declared = F.flatten(F.collect_list(F.filter(F.transform("events", lambda e: e["new_label"]), lambda x: x.isNotNull())).over(
        Window.partitionBy("request").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("earlier", declared)
    bad_entity = F.exists("entities", lambda e: (e["candidate_id"].isNotNull() & ~F.array_contains(entity_labels, e["candidate_id"])) | (e["candidate_id"].isNull() & (F.length(F.trim(F.coalesce(e["name"], F.lit("")))) == 0)))
    bad_event = F.exists("events", lambda e: (e["candidate_id"].isNotNull() & ~F.array_contains(event_labels, e["candidate_id"])) | (e["candidate_id"].isNull() & e["new_ref"].isNull() & (F.length(F.trim(F.coalesce(e["summary"], F.lit("")))) == 0)))
    orphan = F.exists("events", lambda e: e["new_ref"].isNotNull() & ~F.array_contains(F.col("earlier"), e["new_ref"]))
    bad_type = F.exists("events", lambda e: e["candidate_id"].isNull() & e["new_ref"].isNull() & ~F.coalesce(F.lower(e["type"]).isin(EVENT_TYPES), F.lit(False)))
    reason = (
        F.when(F.col("item_id").isNull(), "unreadable").when(F.col("known").isNull(), "not_offered").when(F.coalesce(bad_entity, F.lit(False)), "bad_entity")
        .when(F.coalesce(bad_event, F.lit(False)), "bad_event").when(F.coalesce(orphan, F.lit(False)), "orphan").when(F.coalesce(bad_type, F.lit(False)), "bad_type")
    )
    return rows.withColumn("reason", reason).drop("known", "earlier")


def parsed_triage(responses: DataFrame, offered: DataFrame) -> DataFrame:
    """(request, item_id, material) of offered ids with a boolean verdict; the first row of an id counts."""
    rows = responses.select("request", F.posexplode(F.from_json("json", "array<struct<id: bigint, material: boolean>>")).alias("pos", "r"))
    rows = rows.select("request", "pos", F.col("r.id").alias("item_id"), F.col("r.material").alias("material")).filter("material IS NOT NULL")
    rows = rows.join(offered, ["request", "item_id"], "left_semi")
    return rows.groupBy("request", "item_id").agg(F.min_by("material", "pos").alias("material"))


def validated_verdicts(rows: DataFrame, replies: DataFrame, labels: Column) -> DataFrame:
    """Each row's first verdict; missing or with unknown evidence it is invalid.  Unknown ids are ignored."""
    first = replies.groupBy("id").agg(F.min_by(F.struct("verdict", "evidence"), "pos").alias("v"))
    checked = predicates.evidence_verdict(predicates.enum_or_null(F.col("v.verdict"), ["triggered", "unclear", "not_triggered"]), F.coalesce("v.evidence", F.array().cast("array<string>")), labels)
    return rows.join(first, "id", "left").withColumn("verdict", F.coalesce(checked, F.lit("invalid"))).drop("v")


def section(lines: DataFrame, doc: str, text: str, heading: str) -> DataFrame:
    """The lines of each document from a heading to the next one."""
    rows = lines.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    is_head = F.col("line").rlike(r"^#{1,6}\s")
    order = Window.partitionBy(doc).orderBy("pos")
    current = F.last(F.when(is_head, F.trim(F.regexp_replace("line", r"^#+\s*", ""))), ignorenulls=True).over(order)
    return rows.withColumn("_h", current).filter((F.col("_h") == heading) & ~is_head).drop("_h")


def source_titles(lines: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, source, title) of lines under ``SOURCE:`` lines; a trailing date in brackets goes."""
    rows = lines.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(doc).orderBy("pos")
    mark = F.col("line").startswith("SOURCE: ")
    source = F.last(F.when(mark, F.substring("line", 9, 1000000)), ignorenulls=True).over(order)
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^- ", ""), r"\s*\[[^\]]*\]$", ""))
    return rows.withColumn("source", source).filter(~mark & F.col("source").isNotNull() & (F.trim("line") != "")).select(doc, "source", title.alias("title"))


def probable_misses(rows: DataFrame, block: str, event: str, outlet: str, at: str, text: str, hours: int, threshold: float) -> DataFrame:
    """Unordered event pairs that share a block, differ in outlet, lie within hours and read alike; scored once each.

    All pairs of a block count, without a cap; texts are compared once for each pair of
    distinct trigram sets, and only rows of sets so similar meet.
    """

    def pairs(own: DataFrame) -> DataFrame:
        met = joins.similar_rows(own, event, text, threshold, [block], [outlet, at])
        far = F.abs(F.unix_timestamp(f"{at}_a") - F.unix_timestamp(f"{at}_b")) > hours * 3600
        return met.filter((F.col(f"{outlet}_a") != F.col(f"{outlet}_b")) & ~far).select("a", "b", "similarity")

    return joins.once_each(rows, event, pairs, lambda p: p.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))


def naming_births(hits: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, born): the earliest item that names it, or its own creation if earlier."""
    first = hits.join(items, "item").groupBy("entity").agg(F.min("at").alias("first"))
    return entities.join(first, "entity", "left").select("entity", F.least("created", "first").alias("born"))


def daily_move(quotes: DataFrame) -> DataFrame:
    """Percent from open to close, null without a positive open."""
    return quotes.withColumn("move", F.when(F.col("open") > 0, F.round((F.col("close") - F.col("open")) / F.col("open") * 100, 2)))


def market_pulse(spine: DataFrame, pinned: DataFrame, moves: DataFrame) -> DataFrame:
    """Spine and pinned instruments (pos, asset_class, instrument, label), each once at its first place, with its move."""
    both = spine.withColumn("part", F.lit(0)).unionByName(pinned.withColumn("part", F.lit(1)))
    first = both.groupBy("asset_class", "instrument").agg(F.min(F.struct("part", "pos", "label")).alias("f"))
    return first.select("asset_class", "instrument", "f.part", "f.pos", "f.label").join(moves, ["asset_class", "instrument"], "left")


def active_until(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events of each census window up to its blind end, else its first abandon, else all."""
    abandoned = events.filter("kind = 'abandon'").groupBy("window_id").agg(F.min("at").alias("gone"))
    bounds = windows.join(abandoned, "window_id", "left").select("window_id", F.coalesce("blind_done_at", "gone").alias("until"))
    return events.join(bounds, "window_id").filter(F.col("until").isNull() | (F.col("at") <= F.col("until"))).drop("until")


def wall_start(events: DataFrame) -> DataFrame:
    """By window, the last open at or before the least of its first action and first heartbeat."""
    firsts = events.groupBy("window_id").agg(F.min(F.when(F.col("kind") == "action", F.col("at"))).alias("a"), F.min(F.when(F.col("kind") == "heartbeat", F.col("at"))).alias("h"))
    opens = events.filter("kind = 'open'").join(firsts, "window_id").filter(F.col("at") <= F.least("a", "h"))
    return opens.groupBy("window_id").agg(F.max("at").alias("start"))


def claimed_since(events: DataFrame, completions: Sequence[DataFrame]) -> DataFrame:
    """Windows opened later than the latest of all completions (each a column ``at``)."""
    stacked = completions[0].select("at")
    for c in completions[1:]:
        stacked = stacked.unionAll(c.select("at"))
    last = stacked.agg(F.max("at").alias("last"))
    return events.filter("kind = 'open'").crossJoin(F.broadcast(last)).filter(F.col("last").isNull() | (F.col("at") > F.col("last"))).select("window_id").distinct()


def next_task(windows: DataFrame) -> DataFrame:
    """The one window to work on: open first, then blind done, then pending in order; complete and abandoned never."""
    priority = F.when(F.col("status") == "open", 0).when(F.col("status") == "blind_done", 1).when(F.col("status") == "pending", 2)
    return windows.withColumn("priority", priority).filter("priority IS NOT NULL").orderBy("priority", "order_no", "window_id").limit(1)


def finished(windows: DataFrame, multi_outlet: DataFrame, window_id: int, at: Column) -> DataFrame:
    """Blind work on a window ends; without a multi-outlet group (``multi_outlet``: window_id) it is complete."""
    has = multi_outlet.select("window_id", F.lit(True).alias("_m")).distinct()
    rows = windows.join(has, "window_id", "left")
    hit = (F.col("window_id") == window_id) & (F.col("status") == "open")
    status = F.when(hit & F.col("_m").isNull(), "complete").when(hit, "blind_done").otherwise(F.col("status"))
    return rows.withColumn("blind_done_at", F.when(hit, at).otherwise(F.col("blind_done_at"))).withColumn("status", status).drop("_m")


def abandoned(windows: DataFrame, window_id: int, reason: str) -> DataFrame:
    """An abandoned window takes its repeat with it, unless that is complete."""
    own = F.col("window_id") == window_id
    repeat = (F.col("repeat_of") == window_id) & (F.col("status") != "complete")
    hit = own | F.coalesce(repeat, F.lit(False))
    return windows.withColumn("abandon_reason", F.when(hit, F.lit(reason)).otherwise(F.col("abandon_reason"))).withColumn("status", F.when(hit, "abandoned").otherwise(F.col("status")))


def claimed(queue: DataFrame, run_id: int) -> DataFrame:
    """A queued run becomes running; any other status stays."""
    return queue.withColumn("status", F.when((F.col("id") == run_id) & (F.col("status") == "queued"), "running").otherwise(F.col("status")))


def canonical_decisions(rows: DataFrame) -> DataFrame:
    """(run, item, decision): an item's decision is the set of items it shares a label with, in order."""
    shared = rows.join(rows.select("run", F.col("item").alias("other"), "label"), ["run", "label"])
    return shared.groupBy("run", "item").agg(F.array_sort(F.collect_set("other")).alias("decision"))


def run_agreement(decisions: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Of the items that all runs decided, how many each run shares with the first."""
    columns = [F.max(F.when(F.col("run") == r, F.col("decision"))).alias(f"r{k}") for k, r in enumerate(runs)]
    wide = decisions.groupBy("item").agg(*columns)
    for k in range(len(runs)):
        wide = wide.filter(F.col(f"r{k}").isNotNull())
    return wide.agg(F.count("*").alias("items"), *[F.count_if(F.col("r0") == F.col(f"r{k}")).alias(f"same_{k}") for k in range(1, len(runs))])


def visibility(placed: DataFrame, pairs: DataFrame, window: str) -> DataFrame:
    """Pairs, co-windowed pairs and pairs visible to a batch (another window or the same cluster)."""
    a = placed.select(F.col("item").alias("a"), F.col(window).alias("wa"), F.col("cluster").alias("ca"))
    b = placed.select(F.col("item").alias("b"), F.col(window).alias("wb"), F.col("cluster").alias("cb"))
    rows = pairs.join(a, "a").join(b, "b")
    together = F.col("wa") == F.col("wb")
    return rows.agg(F.count("*").alias("pairs"), F.count_if(together).alias("co_windowed"), F.count_if(~together | (F.col("ca") == F.col("cb"))).alias("visible"))


def key_visibility(rows: DataFrame, window: str, item: str, key: str, block: str, kind: str, at: str, cap: int = 8) -> DataFrame:
    """L21 for items clustered by a shared key: what ``visibility`` gives for the pairs of a block that differ in kind.

    Pairs are counted from group sizes and not made.  Only where an item stands in several rows,
    or has no window, can a pair be told twice or lost: then all goes through edges and pairs.
    """
    odd = rows.groupBy(item).agg(F.count("*").alias("n"), F.max(F.col(window).isNull()).alias("out")).filter("n > 1 OR out")
    if odd.limit(1).count():
        placed = graph.seed_star(rows.select(window, item), graph.shared_key_edges(rows, window, item, key), window, cap)
        return visibility(placed, joins.pairs_by_key(rows, block, item, kind, at).select("a", "b"), window)
    own = graph.key_stars(rows, window, item, key, cap).filter(F.col(block).isNotNull() & F.col(kind).isNotNull())
    counts = own.groupBy(block, window, "cluster", kind).agg(F.count("*").alias("n"))

    def differing(*by: str) -> DataFrame:
        alike = counts.groupBy(*by, kind).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
        return alike.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0)).cast("long").alias("c"))

    pairs, together, same = (differing(*by).withColumnRenamed("c", c) for c, by in (("pairs", [block]), ("co_windowed", [block, window]), ("same", [block, window, "cluster"])))
    one = pairs.crossJoin(together).crossJoin(same)  # one row each
    return one.select("pairs", "co_windowed", (F.col("pairs") - F.col("co_windowed") + F.col("same")).alias("visible"))


def differing_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hits (item, entity) that only one of two matchers found; exact matchers give 0."""
    signed = a.select("item", "entity", F.lit(1).alias("_n")).unionByName(b.select("item", "entity", F.lit(-1).alias("_n")))
    return signed.groupBy("item", "entity").agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("differ"))


#: Rankings by name.  One takes candidate rows and the query's column and returns (query, candidate, rank).
RANKERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def ranker(name: str) -> Callable[[Callable[[DataFrame, str], DataFrame]], Callable[[DataFrame, str], DataFrame]]:
    """Register a ranking under a name; a name is given once."""

    def register(rank: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, str], DataFrame]:
        if name in RANKERS:
            raise ValueError(f"there is a ranking {name!r} already")
        RANKERS[name] = rank
        return rank

    return register


def by_scores(*scores: Callable[[], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """A ranking by scores, the largest first, with recency and id behind them."""

    def rank(candidates: DataFrame, query: str) -> DataFrame:
        last = [F.desc(s()) for s in scores] + [F.desc("recency"), F.desc("candidate")]
        return candidates.select(query, "candidate", F.row_number().over(Window.partitionBy(query).orderBy(*last)).alias("rank"))

    rank.scores = scores
    return rank


def by_columns(*order: Callable[[], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """A ranking by order columns, with recency and id behind them."""

    def rank(candidates: DataFrame, query: str) -> DataFrame:
        last = [o() for o in order] + [F.desc("recency"), F.desc("candidate")]
        return candidates.select(query, "candidate", F.row_number().over(Window.partitionBy(query).orderBy(*last)).alias("rank"))

    return rank


def fused(*names: str) -> Callable[[DataFrame, str], DataFrame]:
    """A ranking by the reciprocal ranks of others, added up: not a sort of one column, so a ranking of its own."""

    def rank(candidates: DataFrame, query: str) -> DataFrame:
        both = [RANKERS[n](candidates, query).withColumn("s", 1.0 / (60 + F.col("rank"))).drop("rank") for n in names]
        score = both[0]
        for more in both[1:]:
            score = score.unionByName(more)
        score = score.groupBy(query, "candidate").agg(F.round(F.sum("s"), 12).alias("s"))
        return score.select(query, "candidate", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("s"), F.desc("candidate"))).alias("rank"))

    rank.fused = names
    return rank


# K05-K08.
ranker("recency")(by_scores())
ranker("overlap")(by_scores(lambda: F.size(F.array_intersect("entities", "candidate_entities"))))
ranker("tokens")(by_scores(lambda: scalars.jaccard(scalars.tokens(F.col("text")), scalars.tokens(F.col("candidate_text")))))
ranker("trigrams")(by_scores(lambda: scalars.trigram_similarity(F.col("text"), F.col("candidate_text"))))
ranker("hybrid")(fused("recency", "tokens"))


#: Candidates for each of the tasks that groups of a pool are dealt over.
POOL_PART_ROWS = 10_000


def ranked_pool(queries: DataFrame, candidates: DataFrame, query: str, on: Sequence[str], like: Sequence[str], alike: Sequence[str], rankers: Sequence[str], most: int | None = None) -> DataFrame:
    """(query, candidate, rank_{name}) of all candidates that share ``on`` with a query, by rankings of scores or fused of such.

    ``like`` and ``alike`` are the columns of queries and candidates that scores are made
    from.  Queries equal in ``on`` and ``like`` have the same ranks and are ranked once; scores
    are worked out once for each pair of distinct values; all rankings of a group go through
    one shuffle, without texts.  Candidates are put in order of recency once for all groups
    of ``on``.  Groups are dealt over as many tasks as the candidates need, for what a task
    makes grows with its queries too.  With ``most`` only rows that some ranking has within it.
    """
    base = list(dict.fromkeys([*[n for r in rankers for n in getattr(RANKERS[r], "fused", ())], *[r for r in rankers if hasattr(RANKERS[r], "scores")]]))
    own = queries.withColumn("_group", F.min(query).over(Window.partitionBy(*on, *like)))
    groups, kinds = own.filter(F.col("_group") == F.col(query)).select("_group", *on, *like).distinct(), candidates.select(*on, *alike).distinct()
    names = {f"_s{k}_{n}": s for n in base for k, s in enumerate(RANKERS[n].scores)}
    scored = groups.join(kinds, list(on)).select("_group", *on, *alike, *[s().alias(n) for n, s in names.items()])
    placed = candidates.withColumn("_age", F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("recency"), F.desc("candidate"))))
    same = [scored[c].eqNullSafe(placed[c]) if c in alike else scored[c] == placed[c] for c in (*on, *alike)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    rows = scored.join(placed, condition).select("_group", "candidate", "_age", *names).repartition(graph.parts_for(candidates, POOL_PART_ROWS), "_group")
    by = lambda *order: F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    for n in base:
        rows = rows.withColumn(f"rank_{n}", by(*[F.desc(c) for c in names if c.endswith(f"_{n}")], F.col("_age")) if RANKERS[n].scores else F.col("_age"))
    for n in (r for r in rankers if hasattr(RANKERS[r], "fused")):
        total = F.lit(0.0)
        for part in RANKERS[n].fused:
            total = total + 1.0 / (60 + F.col(f"rank_{part}"))
        rows = rows.withColumn(f"rank_{n}", by(F.desc(F.round(total, 12)), F.desc("candidate")))
    ranks = [f"rank_{n}" for n in rankers]
    if most is not None:
        rows = rows.filter(F.least(*ranks) <= most if len(ranks) > 1 else F.col(ranks[0]) <= most)
    return rows.select("_group", "candidate", *ranks).join(own.select(query, "_group"), "_group").select(query, "candidate", *ranks)


def best_of(rows: DataFrame, query: str, rankers: Sequence[str], most: int) -> DataFrame:
    """(ranker, query, candidate, rank) of each ranking's best, from rows with a rank column for each."""
    each = F.array(*[F.struct(F.lit(n).alias("ranker"), F.col(f"rank_{n}").cast("long").alias("rank")) for n in rankers])
    rows = rows.select(query, "candidate", F.explode(F.filter(each, lambda r: r["rank"] <= most)).alias("r"))
    return rows.select("r.ranker", query, "candidate", "r.rank")


def bake_off(candidates: DataFrame, query: str, rankers: Sequence[str], truth: DataFrame | None = None, most: int = 30) -> DataFrame:
    """(ranker, query, candidate, rank) of each ranking's best, all over one candidate set in one plan.

    With ``truth`` (query, candidate), instead (ranker, queries, found, share): how many
    queries have a true candidate among their best.
    """
    rows = None
    for name in rankers:
        one = RANKERS[name](candidates, query).filter(F.col("rank") <= most).select(F.lit(name).alias("ranker"), query, "candidate", F.col("rank").cast("long").alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    if truth is None:
        return rows
    asked = truth.select(query).distinct()
    hits = rows.join(truth.select(query, "candidate").distinct(), [query, "candidate"], "left_semi").select("ranker", query).distinct()
    counts = hits.groupBy("ranker").agg(F.count("*").alias("found"))
    names = asked.agg(F.count("*").alias("queries")).withColumn("ranker", F.explode(F.array(*[F.lit(n) for n in rankers])))
    return names.join(counts, "ranker", "left").select("ranker", "queries", F.coalesce("found", F.lit(0)).alias("found"), F.try_divide(F.coalesce("found", F.lit(0)), F.col("queries")).alias("share"))


def ranked(candidates: DataFrame, query: str, rankers: Sequence[str] = ("recency", "overlap", "tokens", "trigrams")) -> DataFrame:
    """Add a rank column for each ranking of a query's candidates (one row each)."""
    for name in rankers:
        own = RANKERS[name](candidates, query).withColumnRenamed("rank", f"rank_{name}")
        candidates = candidates.join(own, [query, "candidate"])
    return candidates


def batch_scores(pool: DataFrame, batch: DataFrame, marks: Callable[[Column], Column]) -> DataFrame:
    """(candidate, recency, score, rank): each candidate's best Jaccard similarity to a title of the batch.

    ``pool`` has candidate, recency and text (several texts of a candidate: several rows),
    ``batch`` text; ``marks`` gives a text's set of tokens (K11) or trigrams (K12).  Distinct
    sets meet on their marks, so only texts that share one are compared; the others score 0.
    Ties go by recency, then id, over the whole pool.
    """
    own = pool.select("candidate", "recency", F.array_sort(marks(F.coalesce("text", F.lit("")))).alias("cm"))
    left = own.select("cm").distinct().withColumn("mark", F.explode("cm"))
    right = batch.select(F.array_sort(marks(F.coalesce("text", F.lit("")))).alias("bm")).distinct().withColumn("mark", F.explode("bm"))
    shared = left.join(right, "mark").groupBy("cm", "bm").agg(F.count("*").alias("n"))
    best = shared.groupBy("cm").agg(F.max(F.round(F.col("n") / (F.size("cm") + F.size("bm") - F.col("n")), 9)).alias("s"))
    scored = own.join(best, "cm", "left").groupBy("candidate", "recency").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("score"))
    return windows.global_rank(scored, [F.desc("score"), F.desc("recency"), F.desc("candidate")])


def trend(points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Latest, mean, latest less mean, and count."""
    agg = points.groupBy(key).agg(F.max_by(value, at).alias("latest"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return agg.withColumn("delta", F.col("latest") - F.col("mean"))


def window_census(labels: DataFrame) -> DataFrame:
    """By window: items, groups of two or more, singles, unsure items, groups of two or more outlets."""
    groups = labels.filter("NOT unsure").groupBy("window_id", F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("s"), F.col("item").cast("string"))).alias("g"))
    groups = groups.agg(F.count("*").alias("k"), F.countDistinct("outlet").alias("o"))
    sums = groups.groupBy("window_id").agg(F.count_if(F.col("k") >= 2).alias("groups"), F.count_if(F.col("k") == 1).alias("singles"), F.count_if(F.col("o") >= 2).alias("multi_outlet"))
    items = labels.groupBy("window_id").agg(F.count("*").alias("items"), F.count_if("unsure").alias("unsure"))
    return items.join(sums, "window_id", "left").fillna(0)


def fitted_intervals(rows: DataFrame, interval: str, budget_per_day: float) -> DataFrame:
    """scale all intervals when their polls a day exceed the budget."""
    total = rows.agg(F.sum(1440 / F.col(interval)).alias("_t"))
    scale = F.greatest(F.lit(1.0), F.col("_t") / budget_per_day)
    return rows.crossJoin(F.broadcast(total)).withColumn("fitted", F.bround(F.col(interval) * scale, 0).cast("long")).drop("_t")


def tone_score(reply: Column) -> Column:
    """The first number of a reply, held to [-1, 1]; null without a number."""
    number = F.regexp_extract(reply, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number)))


def transcript_means(calls: DataFrame, segments: str = "segments") -> DataFrame:
    """(ticker, date, value): each call's mean sentiment without boilerplate, dated by its quarter."""
    own = predicates.without_boilerplate(F.col(segments))
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["sentiment"])
    return calls.select("ticker", scalars.quarter_anchor(F.col("quarter")).alias("date"), F.try_divide(total, F.size(own)).alias("value"))


def annotated(signals: DataFrame, bundles: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals with the sentiment of their ticker and the tags of their source; both null or default where unknown."""
    rows = signals.withColumn("_t", scalars.normalize_ticker(F.col("ticker")))
    b = bundles.select(F.col("ticker").alias("_t"), "sentiment")
    s = sources.select("source_id", F.col("kind").alias("_k"), F.col("perspective").alias("_p"))
    rows = rows.join(b, "_t", "left").join(s, "source_id", "left").drop("_t")
    return rows.withColumn("kind", F.coalesce("_k", F.lit("unknown"))).withColumn("perspective", F.coalesce("_p", F.lit("unknown"))).drop("_k", "_p")


def topic_context(passages: DataFrame, muted: DataFrame, focused: DataFrame) -> DataFrame:
    """Each topic's best passages: three where it is in focus, else two, none where it is muted; excerpts of 500 characters.

    Excerpts are cut and each task keeps its three best of a topic before anything is dealt out.
    """
    excerpts = passages.withColumn("text", F.left("text", F.lit(500)))
    best = topk.top_k_per_key(excerpts, ["topic"], [F.desc("score"), F.col("passage_id")], 3)
    rows = best.join(muted.select("topic").distinct(), "topic", "left_anti")
    rows = rows.join(focused.select("topic", F.lit(True).alias("_f")).distinct(), "topic", "left")
    return rows.filter(F.col("rank") <= F.when(F.col("_f"), 3).otherwise(2)).drop("_f", "rank")


def daily_digest(book: DataFrame, today: Column) -> DataFrame:
    """Positions opened today and open now, by class."""
    return book.groupBy("asset_class").agg(F.count_if(F.col("entry_date") == today).alias("opened"), F.count_if(F.col("status") == "open").alias("open"))


def gate_history(history: DataFrame, performance: DataFrame, week: Column) -> DataFrame:
    """A row for each class and week; a week written again takes the place of the old one."""
    new = performance.filter("dimension = 'asset_class'").select(week.alias("week"), F.col("value").alias("asset_class"), "mean_edge")
    return history.join(new, ["week", "asset_class"], "left_anti").unionByName(new)


def qualified(performance: DataFrame, least: int) -> DataFrame:
    """Dimensions with enough trades."""
    return performance.filter((F.col("n") >= least) & (F.col("dimension") != "all"))


def negative_pairs(pairs: DataFrame, least_days: int, text_a: str, text_b: str) -> DataFrame:
    """R05's counterpart: pairs far apart in time with their similarity."""
    far = F.abs(F.unix_timestamp("ta") - F.unix_timestamp("tb")) >= least_days * 86400
    return pairs.filter(far).withColumn("similarity", scalars.trigram_similarity(F.col(text_a), F.col(text_b)))


def pending(items: DataFrame, verdicts: DataFrame, version: int, now: Column, horizon_days: int = 14, attempts: int = 3) -> DataFrame:
    """Items without a verdict at the version, or failed with attempts left, and whether they are stale.

    The version stands in the join's condition, so an item judged at another version is pending.
    """
    v = verdicts.filter(F.col("version") == version).select("item", "verdict", "attempts")
    rows = items.join(v, "item", "left").filter(F.col("verdict").isNull() | ((F.col("verdict") == "failed") & (F.col("attempts") < attempts)))
    seen = F.coalesce("published_at", "created_at")
    return rows.withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp(seen) > horizon_days * 86400)


def at_risk(verdicts: DataFrame, attempts: int = 3) -> DataFrame:
    """Rows given up on, and rows one failure away from it."""
    return verdicts.agg(F.count_if(F.col("attempts") >= attempts).alias("gave_up"), F.count_if(F.col("attempts") == attempts - 1).alias("at_risk"))


def resolved_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Offered labels as ids; ``unknown`` marks a label that was not offered, which counts as new."""
    known = labels.select("request", "label", F.col("id").alias("resolved"))
    out = rows.join(known, ["request", "label"], "left")
    return out.withColumn("unknown", F.col("label").isNotNull() & F.col("resolved").isNull())
