"""URL filtering by association rules.

Explicit rules (host, path) judge the urls they fit; the others are judged by rules mined
from labelled urls.  A url's tokens are its host's labels, its path's parts (numbers as one
token) and its parameters' names.  Spark's FP-growth finds token sets that are frequent
together with a block or allow label; rules whose confidence and support reach the bounds
stay.  Mined rules meet urls through an inverted index: a rule stands under its rarest
token, a url looks up its own tokens, and a rule matches if the url has all of its tokens.
The number of rules is bounded by their support, and the index is broadcast only below a
checked number of rules.

Only DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut

#: Explicit rules (verdict, host, path); the longest that fits wins.  Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.6
#: A rule must have been seen at least so often, whatever the share.
MIN_COUNT = 5
#: Rules up to this number are broadcast with the index; more are joined by shuffle.
BROADCAST_RULES = 20_000

_LABEL = "label="


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, in lower case (A-Z); else empty."""
    rest = F.substring_index(_after_scheme(url), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    rest = _after_scheme(url)
    plain = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    at = F.locate("/", plain)
    return F.when(at > 0, F.substring(plain, at, F.length(plain))).otherwise(F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url: d: host labels, p: path parts, q: parameters, f: a fragment."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    query = F.substring_index(F.regexp_extract(url, r"\?([^#]*)", 1), "#", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tagged = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("d:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("q:"), x)),
        F.when(F.locate("#", url) > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(tagged)


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules (tokens array<string>, verdict, n, confidence) from rows (tokens, bad boolean).

    A rule's confidence is the share of its label among urls with its tokens; it must also
    beat the label's share of all urls, or the tokens say nothing.  Rules with a subset of their
    tokens, the same verdict and no less confidence are dropped as redundant.
    """
    from pyspark.ml.fpm import FPGrowth

    label = F.when(F.col("bad"), F.lit(f"{_LABEL}block")).otherwise(F.lit(f"{_LABEL}allow"))
    baskets = labelled.filter(F.size("tokens") > 0).select(F.array_append("tokens", label).alias("items"))
    counts = {r.bad: r.n for r in labelled.filter(F.size("tokens") > 0).groupBy("bad").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    empty = labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, n long, confidence double")
    if not total:
        return empty
    support = max(min_support, min_count / total)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=1.0).fit(baskets).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    is_label = lambda x: x.startswith(_LABEL)
    with_label = sets.filter(F.exists("items", is_label)).select(
        F.filter("items", lambda x: ~is_label(x)).alias("tokens"),
        F.substring(F.get(F.filter("items", is_label), 0), len(_LABEL) + 1, 10).alias("verdict"),
        "n",
    )
    plain = sets.filter(~F.exists("items", is_label)).select(F.col("items").alias("tokens"), F.col("n").alias("all"))
    every = with_label.filter(F.size("tokens") > 0).join(plain, "tokens")
    every = cut(every.select("tokens", "verdict", "n", (F.col("n") / F.col("all")).alias("confidence"), F.size("tokens").alias("k")))
    # The best confidence of any subset goes up one token at a time, through sets that fail the bounds as well.
    level = every.filter("k = 1").withColumn("below", F.lit(0.0))
    judged = level
    for k in range(2, (every.agg(F.max("k")).first()[0] or 1) + 1):
        known = level.select(F.col("tokens").alias("sub"), "verdict", F.greatest("confidence", "below").alias("of_sub"))
        own = every.filter(F.col("k") == k)
        subs = own.select("tokens", "verdict", F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))).alias("sub"))
        below = subs.join(known, ["sub", "verdict"]).groupBy("tokens", "verdict").agg(F.max("of_sub").alias("below"))
        level = cut(own.join(below, ["tokens", "verdict"]))
        judged = judged.unionByName(level)
    overall = F.when(F.col("verdict") == "block", counts.get(True, 0) / total).otherwise(counts.get(False, 0) / total)
    kept = judged.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") > overall) & (F.col("below") < F.col("confidence")))
    return kept.select("tokens", "verdict", "n", "confidence")


def token_classes(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens that stand in exactly the same rows (tokens, ...) are one item, named by the first of them.

    Every set of such tokens has the support of one of them, so 2**n sets say what one item
    says.  Sets of rows are told apart by their size, ends and two 64-bit sums.
    """
    rows = cut(labelled.select("tokens", F.monotonically_increasing_id().alias("at")))
    each = rows.select("at", F.explode("tokens").alias("token"))
    told = each.groupBy("token").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.bit_xor(F.xxhash64(F.lit(1), "at")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(2), "at")).alias("s2")
    )
    told = cut(told)
    key = ["n", "first", "last", "s1", "s2"]
    return cut(told.join(told.groupBy(*key).agg(F.min("token").alias("item")), key).select("token", "item"))


def as_items(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """(key, tokens): each row's items instead of its tokens; a token without a class, and a row without any, goes."""
    each = rows.select(key, F.explode("tokens").alias("token")).join(classes, "token")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("tokens"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, tokens of the best rule, verdict) for rows (row, tokens) that a mined rule matches.

    Best: most confident, then most tokens, then most seen, then block, then the first tokens.
    """
    token_counts = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    listed = rules.withColumn("rule_id", F.xxhash64("tokens", "verdict"))
    keyed = (
        listed.select("rule_id", F.explode("tokens").alias("token"))
        .join(token_counts, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("uses", "token")).alias("rare"))
        .select("rule_id", F.col("rare.token").alias("token"))
    )
    index = listed.join(keyed, "rule_id").select("token", F.col("tokens").alias("rule_tokens"), "verdict", "n", "confidence")
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    looked = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = looked.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    rank = F.struct("confidence", F.size("rule_tokens").alias("k"), "n", (F.col("verdict") == "block").alias("b"), F.col("rule_tokens").alias("t"), "verdict")
    return hits.groupBy("row").agg(F.max(rank).alias("best")).select("row", F.col("best.t").alias("mined_rule"), F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"))


def judge(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_key: Column | None = None, rules=RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule (tokens, where one decided; one stands for all that the same labelled pages have).

    ``labels`` has quality and toxic by ``label_id``, which ``label_key`` (an expression on
    ``pages``, its id by default) refers to; a page of quality 0 or toxic 1 is
    a bad example, null counts as good.  Pages without a rule of either kind are allowed.
    A null url, or one without ://, has an empty host and path and no tokens.  Rows that
    share an id are judged each; rows of ``labels`` that share an id count as bad if any is.
    Empty tables give no rules and no rows.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    key = F.col(id_col) if label_key is None else label_key
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), key.alias("label_key"))
    rows = rows.select("page_id", "label_key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.groupBy(F.col(label_id).alias("label_key")).agg(F.max(bad).alias("bad"))
    labelled = cut(rows.join(marks, "label_key").select("tokens", "bad", F.monotonically_increasing_id().alias("at")))
    classes = token_classes(labelled)
    mined = cut(mine(as_items(labelled, "at", classes).join(labelled.select("at", "bad"), "at"), min_support, min_confidence))
    # Only classes that a rule names can decide anything; there are no more items in rules than tokens.
    classes = cut(classes.join(mined.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi"))
    # Urls with the same tokens get the same answer: match the distinct token sets.
    sets = rows.filter(explicit_rule(F.col("host"), F.col("path"), rules).isNull()).select(F.array_sort("tokens").alias("tokens")).distinct()
    found = match(as_items(sets.withColumn("row", F.col("tokens")), "row", classes), mined).withColumnRenamed("verdict", "mined_verdict").drop("confidence")
    rows = rows.withColumn("row", F.array_sort("tokens")).withColumn("own", explicit_rule(F.col("host"), F.col("path"), rules))
    judged = rows.join(found, "row", "left")
    return judged.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.col("mined_verdict"), F.lit("allow")).alias("verdict"),
        F.when(F.col("own.rule").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )
