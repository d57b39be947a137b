"""Statistics: rank correlation, agreement, recall, intervals.  Undefined is null, never NaN."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import windows
from tidewater.operators.graph import cut, parts_for, written


def pearson(rows: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "r") -> DataFrame:
    """By moments; 0 without variance or with fewer than two rows."""
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    both = F.stddev_pop(x) * F.stddev_pop(y)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.try_divide(cov, F.when(both > 1e-12, both)), F.lit(0.0)).alias(out))


def rank_ic(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's rank correlation with mean ranks for ties.  What is ranked is written once (``windows.average_ranks``)."""
    return _ic_of(written(rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))), keys, "_x", "_y")


def _ic_of(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``rank_ic`` of rows whose values are the same at every reading."""
    ranked = windows.ranks_by_value(windows.ranks_by_value(rows, keys, x, "_rx"), keys, y, "_ry")
    return pearson(ranked, keys, "_rx", "_ry", "ic")


def yearly_ic(rows: DataFrame, at: str, x: str, y: str) -> DataFrame:
    """(year, n, ic): rank correlation by calendar year."""
    return rank_ic(rows.withColumn("year", F.year(at)), ["year"], x, y)


def hit_rate(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Share of pairs with equal signs, over pairs without a zero; null if there are none."""
    real = (F.col(x) != 0) & (F.col(y) != 0)
    return rows.groupBy(*keys).agg(F.avg(F.when(real, (F.signum(x) == F.signum(y)).cast("int"))).alias("hit_rate"), F.count_if(real).alias("n"))


def backtest(signal: DataFrame, prices: DataFrame, key: str, at: str, value: str, close: str, horizons: Sequence[int], share: float = 0.5) -> DataFrame:
    """Rank IC and hit rate by horizon and part (discovery, holdout) of the pooled pairs in time order."""
    scored = windows.zscores(signal, key, value)
    pairs = scored.join(windows.forward_returns(prices, key, at, close, horizons), [key, at])
    by = ["horizon", "part"]
    parts = written(windows.temporal_split(pairs, ["horizon"], [at, key], share).select(*by, "z", "forward"))
    return _ic_of(parts, by, "z", "forward").join(hit_rate(parts, by, "z", "forward").withColumnRenamed("n", "n_signed"), by)


def confirmed_groups(rows: DataFrame, group: str, item: str, outlet: str, event: str) -> DataFrame:
    """(group, confirms): some pair of items of different outlets shares an event."""
    shared = rows.groupBy(group, event).agg(F.countDistinct(outlet).alias("n"), F.countDistinct(item).alias("items"))
    return shared.groupBy(group).agg(F.max((F.col("n") >= 2) & (F.col("items") >= 2)).alias("confirms"))


def pooled_share(rows: DataFrame, group: str, item: str, outlet: str, event: str) -> DataFrame:
    """Confirmed groups over groups of two or more outlets."""
    many = rows.groupBy(group).agg(F.countDistinct(outlet).alias("n")).filter("n >= 2")
    found = many.join(confirmed_groups(rows, group, item, outlet, event), group)
    return found.agg(F.count("*").alias("groups"), F.count_if("confirms").alias("confirmed"), F.avg(F.col("confirms").cast("int")).alias("share"))


def pair_recall(rows: DataFrame, links: DataFrame, group: str, item: str, outlet: str) -> DataFrame:
    """Cross-outlet pairs of a group that share an event directly, over all such pairs.  ``links``: (item, event).

    All pairs are counted from the sizes of groups, items and outlets.  Linked ones are
    counted where the pairs of small groups meet those of events of few items
    (``_small_links``), by lookup in large groups and by classes at hot events.
    """
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(outlet).alias("o")).filter("g IS NOT NULL AND item IS NOT NULL AND o IS NOT NULL")
    links = links.select("item", "event").filter("item IS NOT NULL AND event IS NOT NULL")
    large, hot = _large(own, "g", LARGE_GROUP_ROWS), _large(links, "event", HOT_EVENT_ITEMS)
    # An item with several outlets in a group differs from any other there: its outlet is null.
    one = F.when(F.min("o") == F.max("o"), F.min("o")).alias("o")
    items = lambda x: x.groupBy("g", "item").agg(one)
    differ = lambda x, y: F.coalesce(x.o != y.o, F.lit(True))
    small = _rest(own, large, "g").distinct()
    pairs, members = [_outlet_pairs(small)], items(small)
    found = [_small_links(items(small), links, hot, lambda n: F.lit(1.0), differ).agg(F.sum("w").cast("long").alias("linked"))]
    if large is not None:
        big = own.join(large, "g", "left_semi").distinct()
        pairs, members = [*pairs, _outlet_pairs(big)], items(own)
        found += [x.agg(F.count_if(F.coalesce(F.col("o") != F.col("o2"), F.lit(True))).alias("linked")) for x in _large_links(items(big), links, hot)]
    if hot is not None:
        found.append(_class_pairs(members.join(_hot_of(links, hot), "item")))
    linked = reduce(DataFrame.unionByName, found).agg(F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"))
    pairs = reduce(DataFrame.unionByName, pairs).agg(F.sum("pairs").alias("pairs"))
    return pairs.crossJoin(linked).withColumn("recall", F.try_divide("linked", "pairs"))  # one row each


#: An event of more rows is hot: its pairs are counted from classes of items, never written as rows.
HOT_EVENT_ITEMS = 200
#: A group of more rows is large: items that share an event are looked up in it.
LARGE_GROUP_ROWS = 200
#: An item of more large groups meets its partner's groups by a join; fewer travel as an array.
MANY_GROUPS = 1000
#: An item of more rows meets its partners pair by pair, not in one task.
BUSY_ITEM_ROWS = 100_000
#: Rows of groups and events that a task takes.
PART_ROWS = 200_000


def _large(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """The keys of more than ``most`` rows; None where there are none."""
    found = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key))
    return None if found.isEmpty() else found


def _rest(rows: DataFrame, large: DataFrame | None, key: str) -> DataFrame:
    """Rows of the other keys, those of a key in one task: they are few."""
    return (rows if large is None else rows.join(large, key, "left_anti")).repartition(key)


def _outlet_pairs(own: DataFrame) -> DataFrame:
    """One row, ``pairs``: of the rows (g, item, o) of a group those that differ in item and outlet."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sizes = own.groupBy("g", "item").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    sums = sizes.agg(total(F.col("n") * F.col("n") - F.col("s") + F.col("n")).alias("every"))
    same = own.groupBy("g", "o").agg(F.count("*").alias("n")).agg(total(F.col("n") * F.col("n")).alias("same"))
    return sums.crossJoin(same).select(((F.col("every") - F.col("same")) / 2).cast("long").alias("pairs"))  # one row each


def _hot_of(links: DataFrame, hot: DataFrame) -> DataFrame:
    """Each item's hot events."""
    return links.join(hot, "event").groupBy("item").agg(F.array_sort(F.collect_set("event")).alias("hot"))


def _without_hot(met: DataFrame, links: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The pairs i, j that share no hot event."""
    if hot is None:
        return met
    side = lambda x: _hot_of(links, hot).select(F.col("item").alias(x), F.col("hot").alias(f"hot_{x}"))
    both_hot = F.arrays_overlap(F.coalesce("hot_i", F.array()), F.coalesce("hot_j", F.array()))
    return met.join(side("i"), "i", "left").join(side("j"), "j", "left").filter(~both_hot).drop("hot_i", "hot_j")


def _partners(members: str, differ: Callable[[Column, Column], Column] | None = None) -> Column:
    """(i, js) of each element of a sorted array of (item, ..): the items of later ones, of those that differ."""

    def later(x: Column, k: Column) -> Column:
        after = F.slice(members, k + 2, F.size(members))
        return F.transform(F.filter(after, lambda y: differ(x, y)) if differ else after, lambda y: y.item)

    return F.explode(F.transform(members, lambda x, k: F.struct(x.item.alias("i"), later(x, k).alias("js"))))


def _small_links(own: DataFrame, links: DataFrame, hot: DataFrame | None, weight: Callable[[Column], Column], differ: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(i, j, w): pairs of small groups, i < j, that share an event but no hot one, with the weights of their groups, taken of a group's size.

    ``own`` (g, item, ..) has a group's rows in one task.  An item travels with its later
    partners in a group or event as one row, to the task that makes and counts all its
    pairs; the pairs of a busy item are counted before they travel.
    """
    rest = [c for c in own.columns if c not in ("g", "item")]
    groups = own.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("item", *rest))).alias("m")).select(weight(F.size("m")).alias("w"), _partners("m", differ).alias("x"))
    events = _rest(links, hot, "event").groupBy("event").agg(F.array_sort(F.collect_set(F.struct("item"))).alias("m")).select(F.lit(None).cast("double").alias("w"), _partners("m").alias("x"))
    sets = groups.unionByName(events).select("x.i", "x.js", "w").filter(F.size("js") > 0)

    def counted(x: DataFrame) -> DataFrame:
        met = x.select("i", F.explode("js").alias("j"), "w").groupBy("i", "j").agg(F.sum("w").alias("w"), F.bool_or(F.col("w").isNull()).alias("met"))
        return met.filter("met AND w IS NOT NULL").drop("met")

    parts, busy = parts_for(links, PART_ROWS), _large(links, "item", BUSY_ITEM_ROWS)
    if busy is None:
        met = counted(sets.repartition(parts, "i"))
    else:
        busy = F.broadcast(busy.withColumnRenamed("item", "i"))  # one for so many rows
        met = counted(sets.join(busy, "i", "left_anti").repartition(parts, "i")).unionByName(counted(sets.join(busy, "i", "left_semi")))
    return _without_hot(met, links, hot)


def _large_links(rows: DataFrame, links: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs of items of a large group (rows: g, item, o) that share an event but no hot one, with g, o and o2.

    The first are those of items of few groups, whose groups travel as arrays; in the others
    one has many: the one with fewer groups is looked up in the groups of the other.
    """
    cold = _rest(links.join(rows.select("item").distinct(), "item", "left_semi"), hot, "event")
    a, b = cold.select("event", F.col("item").alias("i")), cold.select("event", F.col("item").alias("j"))
    met = _without_hot(a.join(b, "event").filter("i < j").select("i", "j").distinct(), links, hot)
    at = lambda x, o: rows.select("g", F.col("item").alias(x), F.col("o").alias(o))
    degrees = rows.groupBy("item").agg(F.count("*").alias("d"))
    few = rows.join(degrees.filter(F.col("d") <= MANY_GROUPS), "item").groupBy("item").agg(F.collect_set("g").alias("gs"))
    side = lambda x: few.select(F.col("item").alias(x), F.col("gs").alias(f"g{x}"))
    common = met.join(side("i"), "i").join(side("j"), "j").select("i", "j", F.explode(F.array_intersect("gi", "gj")).alias("g"))
    light = common.join(at("i", "o"), ["g", "i"]).join(at("j", "o2"), ["g", "j"])
    di, dj = F.col("di"), F.col("dj")
    both = met.join(degrees.select(F.col("item").alias("i"), F.col("d").alias("di")), "i").join(degrees.select(F.col("item").alias("j"), F.col("d").alias("dj")), "j").filter(F.greatest(di, dj) > MANY_GROUPS)
    both = both.select(F.when(di <= dj, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(di <= dj, F.col("j")).otherwise(F.col("i")).alias("j"))
    heavy = both.join(at("i", "o"), "i").join(at("j", "o2"), ["g", "j"])
    return light.select("g", "o", "o2"), heavy.select("g", "o", "o2")


def _class_pairs(rows: DataFrame) -> DataFrame:
    """One row, ``linked``: pairs of items of a group and of different outlets there that share a hot event.  Rows: g, item, o, hot.

    Items of a group with the same hot events and the same outlet are one class with a count.
    """
    classes = rows.groupBy("g", "hot", "o").agg(F.count("*").alias("n"))
    left = classes.withColumn("event", F.explode("hot"))
    right = left.select("g", "event", F.col("hot").alias("hot2"), F.col("o").alias("o2"), F.col("n").alias("n2"))
    pairs = left.join(right, ["g", "event"]).groupBy("g", "hot", "o", "n", "hot2", "o2", "n2").agg(F.lit(1).alias("_x"))
    same = (F.col("hot") == F.col("hot2")) & F.col("o").eqNullSafe(F.col("o2"))
    differ = F.coalesce(F.col("o") != F.col("o2"), F.lit(True))
    # Ordered pairs of classes count each pair of items twice.
    met_twice = F.when(same, F.when(F.col("o").isNull(), F.col("n") * (F.col("n") - 1)).otherwise(0)).when(differ, F.col("n") * F.col("n2")).otherwise(0)
    return pairs.agg((F.coalesce(F.sum(met_twice), F.lit(0)) / 2).cast("long").alias("linked"))


def bcubed_recall(rows: DataFrame, links: DataFrame, group: str, item: str) -> DataFrame:
    """The mean over items of the share of their group, themselves included, that they are linked to directly.  ``links``: (item, event).

    The shares are added up by pairs: each linked pair gives one over the group's size to
    both.  The pairs are found as in ``pair_recall``.
    """
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("item")).filter("g IS NOT NULL AND item IS NOT NULL")
    links = links.select("item", "event").filter("item IS NOT NULL AND event IS NOT NULL")
    large, hot = _large(own, "g", LARGE_GROUP_ROWS), _large(links, "event", HOT_EVENT_ITEMS)
    members = _rest(own, large, "g").distinct()
    shares = [_small_links(members, links, hot, lambda n: 2.0 / n).agg(F.sum("w").alias("s"))]
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    if large is not None:
        big = own.join(large, "g", "left_semi").distinct()
        big_sizes = big.groupBy("g").agg(F.count("*").alias("size"))
        members, sizes = own.distinct(), sizes.unionByName(big_sizes)
        shares += [x.groupBy("g").agg(F.count("*").alias("n")).join(big_sizes, "g").agg(F.sum(2.0 * F.col("n") / F.col("size")).alias("s")) for x in _large_links(big.withColumn("o", F.lit(None)), links, hot)]
    if hot is not None:
        classes = members.join(_hot_of(links, hot), "item").groupBy("g", "hot").agg(F.count("*").alias("n"))
        left = classes.select("g", "hot", "n", F.explode("hot").alias("event"))
        right = classes.select("g", F.col("hot").alias("hot2"), F.col("n").alias("n2"), F.explode("hot").alias("event"))
        near = left.join(right, ["g", "event"]).select("g", "hot", "n", "hot2", "n2").distinct().groupBy("g", "hot", "n").agg((F.sum("n2") - 1).alias("others"))
        shares.append(near.join(sizes, "g").agg(F.sum(F.col("n") * F.col("others") / F.col("size")).alias("s")))
    total = reduce(DataFrame.unionByName, shares).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    counts = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("items"))
    return counts.crossJoin(total).select("items", F.try_divide(F.col("groups") + F.col("s"), F.col("items")).alias("recall"))  # one row each


def _contingency(rows: DataFrame, a: str, b: str, item: str) -> DataFrame:
    """Null labels are clusters of their own."""
    alone = lambda c: F.coalesce(F.concat(F.lit("g"), F.col(c).cast("string")), F.concat(F.lit("s"), F.col(item).cast("string")))
    return rows.select(alone(a).alias("a"), alone(b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def _choose2(c) -> F.Column:
    return F.col(c) * (F.col(c) - 1) / 2


def agreement(rows: DataFrame, a: str, b: str, item: str) -> DataFrame:
    """Pairwise precision, recall and F1 of ``b`` against ``a``, and the adjusted Rand index.

    From cluster sizes; pairs are never expanded.  The index is 1 where chance alone fixes
    it and null for no rows.
    """
    cells = _contingency(rows, a, b, item)
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_choose2("n")).alias(f"s{c}"))
    sums = cells.agg(F.sum(_choose2("n")).alias("sab"), F.sum("n").alias("n")).crossJoin(side("a")).crossJoin(side("b"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), _choose2("n"))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.col("n").isNull(), None).when(F.coalesce(most == expected, F.lit(True)), 1.0).otherwise(F.try_divide(F.col("sab") - expected, most - expected))
    precision, recall = F.try_divide("sab", "sb"), F.try_divide("sab", "sa")
    f1 = F.try_divide(2 * F.col("sab"), F.col("sa") + F.col("sb"))
    return sums.select(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ari.alias("ari"))


def bootstrap_interval(rows: DataFrame, item: str, value: str, reps: int = 2000, seed: str = "20260928", least: int = 100) -> DataFrame:
    """Percentile interval of the mean over resamples of the rows.

    Each row is drawn a Poisson(1) number of times in each repeat, by hash, so a repeat is
    one aggregation without a collected sample; null with fewer than ``least`` rows.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(item).cast("string"), F.col("rep").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        steps.append(total)
        term /= k
    times = F.lit(0)
    for s in steps:
        times = times + F.when(u >= s, 1).otherwise(0)
    drawn = rows.filter(F.col(value).isNotNull()).select(item, value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("times", times)
    means = drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col(value) * F.col("times")), F.sum("times")).alias("m"), F.count("*").alias("n"))
    edges = means.filter("m IS NOT NULL").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.max("n").alias("n"))
    return edges.select(F.when(F.col("n") >= least, F.col("low")).alias("low"), F.when(F.col("n") >= least, F.col("high")).alias("high"))


def design_effect_mde(rows: DataFrame, m: str, rho: float, d: float = 0.5) -> DataFrame:
    """Smallest difference that clusters of these sizes can show, with the design effect 1 + (m (1 + cv^2) - 1) rho."""
    effect = 1 + (F.avg(m) * (1 + F.coalesce(F.try_divide(F.var_pop(m), F.avg(m) * F.avg(m)), F.lit(0.0))) - 1) * rho
    return rows.agg(effect.alias("effect"), (2.8 * F.sqrt(2 * d * (1 - d) * effect / F.sum(m))).alias("mde"))


def clustered_interval(rows: DataFrame, cluster: str, hit: str, t: float = 2.0) -> DataFrame:
    """Pooled share and its interval by the variance between clusters, clipped to 0 and 1."""
    per = rows.groupBy(cluster).agg(F.sum(F.col(hit).cast("int")).alias("y"), F.count("*").alias("m"))
    sums = per.agg(F.sum("y").alias("sy"), F.sum("m").alias("sm"), F.count("*").alias("k"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("y") * F.col("m")).alias("ym"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    p = F.try_divide("sy", "sm")
    rest = F.col("yy") - 2 * p * F.col("ym") + p * p * F.col("mm")
    se = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("k") * rest, F.col("k") - 1))) / F.col("sm")
    return sums.select(p.alias("share"), F.greatest(F.lit(0.0), p - t * se).alias("low"), F.least(F.lit(1.0), p + t * se).alias("high"))


def go_no_go(rows: DataFrame, groups: str, minutes: str, least_mean: float = 8, most_median: float = 80) -> DataFrame:
    """L15."""
    return rows.agg(F.avg(groups).alias("mean_groups"), F.median(minutes).alias("median_minutes")).withColumn("go", (F.col("mean_groups") >= least_mean) & (F.col("median_minutes") <= most_median))


def paired_interval(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mean difference plus and minus 1.96 standard errors (sample deviation)."""
    d = F.col(x) - F.col(y)
    half = 1.96 * F.try_divide(F.stddev_samp(d), F.sqrt(F.count(d)))
    return rows.agg(F.avg(d).alias("mean"), (F.avg(d) - half).alias("low"), (F.avg(d) + half).alias("high"))


def simplest_within(rows: DataFrame, order: str, share: str, tolerance: float = 0.05) -> DataFrame:
    """The first variant by ``order`` whose share lies within the tolerance of the best."""
    best = rows.agg(F.max(share).alias("_best"))
    return rows.crossJoin(F.broadcast(best)).filter(F.col(share) >= F.col("_best") - tolerance).agg(F.min_by(F.struct(order, share), F.col(order)).alias("v")).select("v.*")


def replay_decision(agree_same, agree_other, drop_same, drop_other, batches, tolerance: float = 0.05, least: int = 30) -> F.Column:
    """Accept another run if agreement and drops stay within the tolerance, on enough batches."""
    return F.when(batches < least, "too_few").when((agree_same - agree_other <= tolerance) & (drop_other - drop_same <= tolerance), "accept").otherwise("reject")
