"""Join operators: bands, as-of, intervals, similarity pairs, best matches.

Keys, times and tolerances are parameters.  As-of joins are a union and one window by key,
so they cost one shuffle and no range join; ties take the rule each docstring states.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import trigrams
from tidewater.operators.graph import parts_for, written


def pairs_by_key(rows: DataFrame, key: str, item: str, outlet: str, at: str, max_gap_seconds: float | None = None) -> DataFrame:
    """Distinct unordered pairs (a, b) of items that share a key and differ in outlet, a < b."""
    a = rows.select(F.col(key).alias("k"), F.col(item).alias("a"), F.col(outlet).alias("oa"), F.col(at).alias("ta"))
    b = rows.select(F.col(key).alias("k"), F.col(item).alias("b"), F.col(outlet).alias("ob"), F.col(at).alias("tb"))
    joined = a.join(b, "k").filter((F.col("a") < F.col("b")) & (F.col("oa") != F.col("ob")))
    if max_gap_seconds is not None:
        joined = joined.filter(F.abs(F.unix_timestamp("ta") - F.unix_timestamp("tb")) <= max_gap_seconds)
    return joined.select("a", "b", "ta", "tb").distinct()


def anti_count(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner, counted."""
    return left.join(right, list(on), "left_anti").agg(F.count("*").alias("n"))


def with_later(rows: DataFrame, events: DataFrame, key: str, at: str, event_at: str) -> DataFrame:
    """Rows whose key has a later event; only each key's last event is joined."""
    last = events.groupBy(key).agg(F.max(event_at).alias("_last"))
    return rows.join(last, key).filter(F.col("_last") > F.col(at)).drop("_last")


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, value: str, tolerance: int | None = None, out: str = "value") -> DataFrame:
    """The last right row at or before the left row's time; of equal times the largest value.

    ``tolerance`` is in the unit of the times (days for dates, seconds for timestamps);
    beyond it the match is null.
    """
    best = right.groupBy(*keys, F.col(right_at).alias(at)).agg(F.max(value).alias("_v"))
    stacked = left.withColumn("_v", F.lit(None).cast(best.schema["_v"].dataType)).withColumn("_side", F.lit(1)).unionByName(
        best.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    seen = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    struct = F.last(F.when(F.col("_side") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(seen)
    rows = stacked.withColumn("_m", struct).filter("_side = 1")
    gap = _gap(left.schema[at].dataType.simpleString(), F.col(at), F.col("_m.t"))
    hit = F.lit(True) if tolerance is None else gap <= tolerance
    return rows.select(*left.columns, F.when(hit, F.col("_m.t")).alias(f"{out}_at"), F.when(hit, F.col("_m.v")).alias(out))


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, tolerance: int) -> DataFrame:
    """Add ``snapped``, the first right time at or after the left row's, null beyond the tolerance.

    Each time of a key is looked up once, however many left rows have it.  The window runs
    backwards: its frame grows from the start, where one up to the partition's end would be
    worked out anew for every row.
    """
    times = right.select(*keys, F.col(right_at).alias(at)).distinct().withColumn("_side", F.lit(1))
    stacked = left.select(*keys, at).distinct().withColumn("_side", F.lit(0)).unionByName(times)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    rows = stacked.withColumn("_m", F.last(F.when(F.col("_side") == 1, F.col(at)), ignorenulls=True).over(ahead)).filter("_side = 0")
    gap = _gap(left.schema[at].dataType.simpleString(), F.col("_m"), F.col(at))
    found = rows.select(*keys, at, F.when(gap <= tolerance, F.col("_m")).alias("snapped"))
    return left.join(found, [*keys, at], "left").select(*left.columns, "snapped")


def _gap(kind: str, later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) if kind == "date" else F.unix_timestamp(later) - F.unix_timestamp(earlier)


def live_at(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, bucket_seconds: int = 86400) -> DataFrame:
    """Spans with first <= at <= last; both sides meet by key and time bucket, not by range alone."""
    cell = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    p = points.withColumn("_cell", cell(F.col(at)))
    s = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(first)), cell(F.col(last)))))
    return p.join(s, [key, "_cell"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("_cell")


def overlap_share(polls: DataFrame, spans: DataFrame, key: str = "source", at: str = "at", item: str = "hash") -> DataFrame:
    """Of what was live at a poll, the share still live at the next; null for an empty window."""
    order = Window.partitionBy(key).orderBy(at)
    pairs = polls.select(key, F.col(at), F.lead(at).over(order).alias("next")).filter("next IS NOT NULL")
    live = live_at(pairs, spans, key, at, "first_seen", "last_seen")
    counts = live.groupBy(key, at, "next").agg(F.count(item).alias("window"), F.count_if(F.col("last_seen") >= F.col("next")).alias("stayed"))
    return pairs.join(counts, [key, at, "next"], "left").withColumn("overlap", F.try_divide("stayed", "window"))


def text_classes(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(cls, grams, n), the distinct trigram sets of the texts with a number for each, and (text, cls); texts without trigrams have none."""
    sets = written(texts.select(text).distinct().select(text, F.array_sort(trigrams(F.col(text))).alias("grams")), "texts").filter(F.size("grams") > 0)
    classes = written(sets.select("grams").distinct().select(F.monotonically_increasing_id().alias("cls"), "grams", F.size("grams").alias("n")), "classes")
    return classes, sets.join(classes, "grams").select(text, "cls")


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(c1, c2, similarity): ordered pairs of classes (cls, grams, n) whose Jaccard similarity reaches the threshold, a class with itself too.

    Exact prefix filter: with trigrams in one global order, two sets can only be so similar
    if their first n - ceil(t n) + 1 trigrams share one, rarest first.  Only these meet.
    """
    c = lambda k: classes.select(*[F.col(a).alias(f"{b}{k}") for a, b in (("cls", "c"), ("grams", "g"), ("n", "n"))])
    if threshold <= 0:
        met = c(1).crossJoin(c(2))
    else:
        each = classes.select("cls", "n", F.explode("grams").alias("gram"))
        counts = each.groupBy("gram").agg(F.count("*").alias("df"))
        place = F.row_number().over(Window.partitionBy("cls").orderBy("df", "gram"))
        prefix = each.join(counts, "gram").withColumn("_r", place).filter(F.col("_r") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
        a, b = prefix.select("gram", F.col("cls").alias("c1"), F.col("n").alias("n")), prefix.select("gram", F.col("cls").alias("c2"), F.col("n").alias("m"))
        close = a.join(b, "gram").filter(F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9).select("c1", "c2").distinct()
        met = close.join(c(1), "c1").join(c(2), "c2")
    shared = F.size(F.array_intersect("g1", "g2"))
    return met.withColumn("similarity", shared / (F.col("n1") + F.col("n2") - shared)).filter(F.col("similarity") >= threshold).select("c1", "c2", "similarity")


#: Tasks that the pairs of two classes are dealt over.
PAIR_PARTS = 16
#: Rows for each of the tasks that meet their partners: what a task makes is far more than it reads.
PAIRED_ROWS = 10_000
#: Rows of a class that travel as one and that a row meets one after the other.
BLOCK_ROWS = 256


def similar_rows(rows: DataFrame, item: str, text: str, threshold: float, on: Sequence[str] = (), values: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(on, a, b, similarity, {value}_a, {value}_b): pairs of rows, a < b, that share ``on`` and read alike.

    Texts are compared once for each pair of distinct trigram sets, and their similarity is
    rounded there; rows meet only through classes so similar.  What grows with the pairs is
    the answer alone: it is made by the last join and not dealt out again.  That join takes
    the rows b of a class in sorted blocks, and all rows a pass a block before the next one
    comes: a page of the written answer holds one block over and over and packs well.
    """
    classes, of_text = text_classes(rows, text)
    members = rows.join(of_text, text).select(*on, F.col(item).alias("_i"), "cls", *values)
    side = lambda k: members.select(*on, F.col("_i").alias("ab"[k]), F.col("cls").alias(f"c{k + 1}"), *[F.col(v).alias(f"{v}_{'ab'[k]}") for v in values])
    alike = similar_classes(classes, threshold)
    if digits is not None:
        alike = alike.withColumn("similarity", F.round("similarity", digits))
    left = side(0).join(alike, "c1").drop("c1").withColumn("_part", F.pmod(F.xxhash64("a"), F.lit(PAIR_PARTS)))
    ranged = side(1).repartitionByRange(*on, "c2", "b").withColumn("_at", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*on, "c2", "_at").orderBy("b"))
    packed = F.sort_array(F.collect_list(F.struct("b", *[f"{v}_b" for v in values])))
    blocks = ranged.withColumn("_n", F.floor((place - 1) / BLOCK_ROWS)).groupBy(*on, "c2", "_at", "_n").agg(packed.alias("_bs"), F.max("b").alias("_last"))
    blocks = blocks.drop("_at", "_n").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_PARTS - 1).cast("long"))))
    keys = [*on, "c2", "_part"]
    dealt = lambda x: x.repartition(parts, *keys)
    parts = parts_for(rows, PAIRED_ROWS)
    met = dealt(blocks).join(dealt(left).hint("merge"), keys).filter("a < _last")  # blocks stream by
    pairs = met.select(*on, "a", *[f"{v}_a" for v in values], "similarity", F.inline("_bs")).filter("a < b")
    return pairs.select(*on, "a", "b", "similarity", *[f"{v}_{x}" for v in values for x in "ab"])


def once_each(rows: DataFrame, item: str, pairs_of: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs_of`` the rows, ``merged`` where an item stands in several rows; without such items nothing can repeat, and the pairs stay where they are."""
    repeated = rows.groupBy(item).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count()
    return merged(pairs_of(rows)) if repeated else pairs_of(rows)


def similar_pairs(rows: DataFrame, item: str, text: str, threshold: float, digits: int | None = None) -> DataFrame:
    """Pairs a < b whose trigram similarity reaches the threshold, each once."""
    return once_each(rows, item, lambda r: similar_rows(r, item, text, threshold, digits=digits).select("a", "b", "similarity"), lambda p: p.distinct())


#: Similarities that a top-k search asks for in turn; a query leaves when it has k candidates so similar.
TOP_K_STEPS = (0.3, 0.0)
#: Among so few candidates common trigrams cost less than a step of their own: all are let meet at once.
FEW_CANDIDATES = 100_000


def _prefix(sets: DataFrame, grams: str, ranks: DataFrame, threshold: float) -> DataFrame:
    """Rows (grams, gram): the rarest trigrams, as many as two sets so similar must share one of."""
    each = sets.select(grams, F.explode(grams).alias("gram"))
    if threshold <= 0:
        return each
    each = each.join(ranks, "gram")
    keep = F.size(grams) - F.ceil(F.lit(threshold) * F.size(grams)) + 1
    place = F.row_number().over(Window.partitionBy(grams).orderBy("df", "gram"))
    return each.withColumn("_r", place).filter(F.col("_r") <= keep).select(grams, "gram")


def trigram_top_k(queries: DataFrame, candidates: DataFrame, query_id: str, candidate_id: str, k: int) -> DataFrame:
    """Each query's k best candidates by (trigram similarity of ``text``, ``recency``, id), a total order.

    Equal texts are scored once, and only the k newest candidates of a text can be among the
    best.  The search asks for high similarities first: sets so similar share one of their
    rarest trigrams and have like sizes, so common trigrams seldom meet.  A query that has k
    candidates at a step is done, for all others are less similar; only the rest go on to the
    next step, the last of which lets all trigrams meet.  A query with fewer than k alike is
    filled up with the newest of the others, of which the k newest candidates of all are
    enough.  Null text has no trigrams and a similarity of 0.
    """
    grams = F.array_sort(trigrams(F.coalesce("text", F.lit(""))))
    asked = queries.select(query_id, grams.alias("qg"))
    newest = [F.desc("recency"), F.desc(candidate_id)]
    known = candidates.select(candidate_id, "recency", grams.alias("cg"))
    first = written(known.withColumn("_r", F.row_number().over(Window.partitionBy("cg").orderBy(*newest))).filter(F.col("_r") <= k).drop("_r"))
    sets = first.groupBy("cg").agg(F.count("*").alias("copies"))
    ranks = sets.select(F.explode("cg").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    # A trigram that no candidate has is the rarest of all, and meets nobody.
    wanted = asked.select("qg").distinct()
    every = wanted.select(F.explode("qg").alias("gram")).distinct().join(ranks, "gram", "left").select("gram", F.coalesce("df", F.lit(0)).alias("df"))
    ranks = ranks.unionByName(every).groupBy("gram").agg(F.max("df").alias("df"))
    left, found = wanted, []
    for step in TOP_K_STEPS if first.count() > FEW_CANDIDATES else TOP_K_STEPS[-1:]:
        q, c = _prefix(left, "qg", ranks, step), _prefix(sets, "cg", ranks, step)
        n, m = F.size("qg"), F.size("cg")
        pairs = q.join(c, "gram").filter((F.least(n, m) >= step * F.greatest(n, m))).select("qg", "cg").distinct()
        shared = F.size(F.array_intersect("qg", "cg"))
        exact = shared / (n + m - shared)
        scored = pairs.withColumn("_s", exact).filter(F.col("_s") >= step).select("qg", "cg", F.round("_s", 9).alias("score"))
        if step == TOP_K_STEPS[-1]:
            found.append(scored)
            break
        scored = written(scored.join(sets, "cg"))
        full = scored.groupBy("qg").agg(F.sum("copies").alias("_n")).filter(F.col("_n") >= k).select("qg")
        found.append(scored.join(full, "qg", "left_semi").drop("copies"))
        left = left.join(full, "qg", "left_anti")
    alike = found[0]
    for more in found[1:]:
        alike = alike.unionByName(more)
    met = alike.join(first, "cg").select("qg", candidate_id, "recency", "score")
    fill = wanted.crossJoin(F.broadcast(known.orderBy(*newest).limit(k).select(candidate_id, "recency")))  # k rows
    every = met.unionByName(fill.withColumn("score", F.lit(0.0))).groupBy("qg", candidate_id, "recency").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qg").orderBy(F.desc("score"), *newest)
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return asked.join(ranked, "qg").drop("qg")


def lookup_with_default(rows: DataFrame, table: DataFrame, on: str, value: str, default: str, out: str) -> DataFrame:
    """A lookup by a unique key; unknown keys get the default.  Spark broadcasts the table if it knows it to be small."""
    return rows.join(table.select(on, F.col(value).alias("_v")), on, "left").withColumn(out, F.coalesce("_v", F.lit(default))).drop("_v")


def best_match_by_keys(rows: DataFrame, keys: Column, table: DataFrame, table_keys: Column, order: Sequence[Column], row_id: str) -> DataFrame:
    """Match on any of several derived keys; the first by ``order`` wins."""
    left = rows.withColumn("_k", F.explode(keys))
    right = table.withColumn("_k", F.explode(table_keys))
    first = Window.partitionBy(row_id).orderBy(*order)
    return left.join(right, "_k").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_k")


def tiered(rows: DataFrame, tiers: Sequence[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """The first tier (table, key, value) that knows a row's key."""
    values = []
    for k, (table, key, value) in enumerate(tiers):
        rows = rows.join(table.select(key, F.col(value).alias(f"_t{k}")), key, "left")
        values.append(F.col(f"_t{k}"))
    return rows.withColumn(out, F.coalesce(*values)).drop(*[f"_t{k}" for k in range(len(tiers))])


#: Items whose hits one task holds.
ITEMS_OF_A_TASK = 50_000


def dictionary_hits(items: DataFrame, forms: DataFrame, item: str = "item", text: str = "text", entity: str = "entity", form: str = "form") -> DataFrame:
    """Distinct (item, entity) where a form stands in the text as a run of whole words (lower case).

    Forms of one word meet the distinct words of a text.  Longer ones meet texts by their
    first word; the run is then compared, so common first words cost a comparison, not a
    wrong hit.  An item's hits come together in one of as many tasks as the items need.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    texts = items.select(F.col(item).alias("item"), words(F.col(text)).alias("words"))
    listed = forms.select(F.col(entity).alias("entity"), words(F.col(form)).alias("run")).filter(F.size("run") > 0).withColumn("first", F.col("run")[0])
    one = listed.filter(F.size("run") == 1).select("entity", "first").distinct()
    hits = texts.select("item", F.explode(F.array_distinct("words")).alias("first")).join(one, "first").select("item", "entity")
    several = listed.filter(F.size("run") > 1)
    if several.limit(1).count():
        at = texts.select("item", "words", F.posexplode("words").alias("pos", "first"))
        found = at.join(several, "first").filter(F.slice("words", F.col("pos") + 1, F.size("run")) == F.col("run"))
        hits = hits.unionByName(found.select("item", "entity"))
    return hits.repartition(parts_for(items, ITEMS_OF_A_TASK), "item").distinct()


def state_changes(now: DataFrame, before: DataFrame, key: str, digest: str, strength: str) -> DataFrame:
    """``alert`` where the digest is new or the strength rose, ``stale`` keys that are gone, else ``same``."""
    n = now.select(key, F.col(digest).alias("d"), F.col(strength).alias("s"))
    b = before.select(key, F.col(digest).alias("bd"), F.col(strength).alias("bs"))
    action = F.when(F.col("d").isNull(), "stale").when(~F.col("d").eqNullSafe(F.col("bd")) | (F.col("s") > F.coalesce("bs", F.lit(-1))), "alert").otherwise("same")
    return n.join(b, key, "full_outer").withColumn("action", action)


def arm_changes(now: DataFrame, armed: DataFrame, key: str, verdict: str) -> DataFrame:
    """Fire on a crossing while armed, re-arm when it stops, leave unknown alone."""
    state = F.coalesce("is_armed", F.lit(True))
    action = F.when((F.col(verdict) == "fired") & state, "fire").when((F.col(verdict) == "not") & ~state, "rearm").otherwise("keep")
    return now.join(armed, key, "left").withColumn("action", action)


def nearest_in_time(anchors: DataFrame, rows: DataFrame, key: str, at: str, row_at: str, row_id: str, n: int) -> DataFrame:
    """Each anchor's n nearest rows of its key by distance in time, then id."""
    near = Window.partitionBy(key, "anchor").orderBy(F.abs(F.unix_timestamp(at) - F.unix_timestamp(row_at)), row_id)
    return anchors.join(rows, key).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= n)


def windowed_items(items: DataFrame, outlets: DataFrame, on: Column, at: str, until: Column, hours: int) -> DataFrame:
    """Items of the hours up to a time, with their outlet; the time itself counts, the far end doesn't."""
    near = items.filter((F.col(at) > until - F.make_dt_interval(hours=F.lit(hours))) & (F.col(at) <= until))
    return near.join(outlets, on)


def day_bucket_counts(items: DataFrame, outlet: str, at: str, now: Column) -> DataFrame:
    """(outlet, ago, n): items by outlet and whole days before now."""
    ago = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)
    return items.groupBy(F.col(outlet).alias("outlet"), ago.alias("ago")).agg(F.count("*").alias("n"))


def pair_list(pairs: DataFrame, rows: DataFrame, item: str, values: Sequence[str]) -> DataFrame:
    """Pairs (a, b) with both sides' values, as ``{value}_a`` and ``{value}_b``; a pair with an unknown side goes."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col(item).alias(side), *[F.col(v).alias(f"{v}_{side}") for v in values]), side)
    return pairs


def aligned(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """Two series of a key where both have the day."""
    return left.join(right, [key, at])


def latest_with_default(base: DataFrame, rows: DataFrame, key: str, order: Sequence[str], value: str, default: str) -> DataFrame:
    """Each base row with its key's last value, or the default where there is none; rows of one order tie by their value."""
    last = rows.groupBy(key).agg(F.max_by(value, F.struct(*order, value)).alias("_v"))
    return base.join(last, key, "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def of_top_keys(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the k keys with most rows, the smaller key first on a tie."""
    top = rows.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(k)
    return rows.join(F.broadcast(top.select(key)), key, "left_semi")  # k rows
