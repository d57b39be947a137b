"""Exact dedup by deterministic block naming.

Each text is cut into fixed-size blocks of its UTF-8 bytes.  Equal blocks are sorted
together and get one integer name.  Then adjacent names are paired, equal pairs get one
name, and so on, until each document has a single name.  Names stand for contents, never
for hashes, so the identity (number of blocks, last name) has no collisions.

Only DataFrame functions; hashes serve to find hot keys, never to decide equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, hot_hashes, least_id_by_key, text_of, written

BLOCK_BYTES = 4096


def block_identities(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, rid, text_sha256, n_blocks, name``.

    Two rows have the same (n_blocks, name) if and only if their texts are equal.  Null
    text counts as empty, which has one empty block.  ``rid`` is unique per row, also
    where ids repeat: ``row_col``, if the rows have such a number.  An empty table gives an empty result.
    """
    raw = text_of(text_col).cast("binary")
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = df.select(F.col(id_col).alias("doc_id"), raw.alias("t"), number.alias("rid")).select(
        "doc_id",
        "t",
        "rid",
        F.greatest(F.lit(1), F.ceil(F.octet_length("t") / block_bytes)).cast("int").alias("n_blocks"),
        F.sha2("t", 256).alias("sha"),
    )
    starts = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    slices = F.transform(starts, lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = (
        rows.select("doc_id", "rid", "n_blocks", "sha", F.posexplode(slices).alias("i", "block"))
        .withColumn("sha", F.when(F.col("i") == 0, F.col("sha")))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    hot = hot_hashes(blocks.select(F.xxhash64("block").alias("h")))
    named = cut(least_id_by_key(blocks, ["block"], "uid", "name", hot).drop("uid"))

    whole = []
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    width = 1
    while width < most:
        whole.append(named.filter(F.col("n_blocks") <= width))
        pairs = (
            named.filter(F.col("n_blocks") > width)
            .groupBy("doc_id", "rid", "n_blocks", F.floor(F.col("i") / 2).cast("int").alias("i2"))
            .agg(
                F.max("sha").alias("sha"),
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
                F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right"),
            )
            .withColumnRenamed("i2", "i")
        )
        pairs = cut(pairs.withColumn("uid", F.monotonically_increasing_id()))
        hot = hot_hashes(pairs.select(F.xxhash64("left", "right").alias("h")))
        named = cut(least_id_by_key(pairs, ["left", "right"], "uid", "name", hot).drop("uid"))
        width *= 2
    whole.append(named)
    columns = ["doc_id", "rid", F.col("sha").alias("text_sha256"), "n_blocks", "name"]
    return reduce(DataFrame.unionByName, [w.select(*columns) for w in whole])


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; of rows that also share the id,
    exactly one does.  A null id counts as smaller than any other and then keep_id may be
    null.  Other columns of ``df`` are not read.
    """
    return _judged(block_identities(df, id_col, text_col, block_bytes)).drop("rid")


def _judged(identities: DataFrame) -> DataFrame:
    ids = cut(identities)
    groups = cut(
        ids.groupBy("n_blocks", "name").agg(
            F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")
        )
    )
    # Both sides are plain exchanges, so a group of a third of all rows is split at run time.
    joined = ids.join(groups, ["n_blocks", "name"])
    return joined.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
        "rid",
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with their columns, that exact_dedup keeps."""
    # Written once, so that the numbers are the same wherever they are read.
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")
    own = rows.select("row", F.col("doc")[id_col].alias("doc_id"), F.col("doc")[text_col].alias("text"))
    kept = _judged(block_identities(own, "doc_id", "text", BLOCK_BYTES, "row")).filter("kept").select(F.col("rid").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
