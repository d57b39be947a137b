"""How filters interact: what each one takes out in every order of all of them.

A document's failures are one mask of bits.  Documents are counted by part and mask, so
what follows grows with the distinct masks and not with the corpus.  Each mask cell meets
every order's steps; a running bit-or over a cell's steps tells what failed earlier, and
sums over conditions give the figures of a step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, text_of

#: White space of the word rule (fixed value).
SPACES = "[ \\t-\\r]+"
LEAST_WORDS = 200


def text_failures(text: str | Column) -> dict[str, Column]:
    """The filters' failure conditions that a text alone decides, by letter; null is empty."""
    t = text_of(text)
    words = F.array_remove(F.split(t, SPACES), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, failures: Mapping[str, Column], copies: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask: bit k of the mask is the k-th letter's failure, the last bit is ``copies``.

    ``copies`` fails a document whose text a smaller id has anywhere in the table.  Texts are
    told apart by SHA-256 and length; the smallest id of a text is joined back, which Spark
    splits where one text has very many rows.  Rows without an id and rows that share the
    smallest id pass.  A null part is ''.
    """
    if copies in failures:
        raise ValueError(f"{copies} is another filter's letter")
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    t = text_of(text_col)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(part_col).alias("part"), mask.alias("mask"), F.unhex(F.sha2(t, 256)).alias("_digest"), F.octet_length(t).alias("_size")))
    least = rows.groupBy("_digest", "_size").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1 AND _least IS NOT NULL").drop("_n")
    again = F.col("doc_id") > F.col("_least")
    both = rows.join(least, ["_digest", "_size"], "left")
    return both.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(again, 1 << len(failures)).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """part, mask, n, n_good, n_toxic.  A document is good (toxic) if a label row of its id says so; no label is neither."""
    flags = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    known = masks.join(flags, "doc_id", "left")
    return known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("_good").alias("n_good"), F.count_if("_toxic").alias("n_toxic"))


def audit(cells: DataFrame, letters: Sequence[str], orders: Sequence[str] | None = None) -> DataFrame:
    """A row for each part, order and step, zeros included.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost count documents of the part;
    shapley sums the step's filter's ``removed`` over the part's orders.  ``orders`` are words
    of the letters, each once; by default all permutations.  No cells give no rows.
    """
    orders = list(orders) if orders is not None else ["".join(p) for p in permutations(letters)]
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    if any(sorted(o) != sorted(letters) for o in orders):
        raise ValueError("an order names each filter once")
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.array(*[F.lit(bit[x]) for x in o]).alias("bits")) for o in orders])
    steps = cells.select("*", F.explode(table).alias("_o")).select("part", "mask", "n", "n_good", "n_toxic", "_o.filter_order", F.posexplode("_o.bits").alias("_k", "_bit"))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_fails", F.col("mask").bitwiseAND(F.col("_bit")))
    steps = steps.withColumn("_before", F.coalesce(F.bit_or("_fails").over(earlier), F.lit(0)))
    fails, free = F.col("_fails") != 0, F.col("_before") == 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    rows = steps.groupBy("part", "filter_order", (F.col("_k") + 1).alias("step"), "_bit").agg(
        total(free & ~fails).alias("kept"),
        total(free & fails).alias("removed"),
        total(~free & fails).alias("redundant"),
        total(F.col("mask") == F.col("_bit")).alias("unique_fails"),
        total(free & fails, "n_good").alias("good_lost"),
        total(free & fails, "n_toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_bit"))).drop("_bit")


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters A to E over whole texts, by language."""
    failures = text_failures("text")
    return audit(mask_cells(masked(docs, failures, "E"), labels), [*failures, "E"])
