"""Quotation linking: conversations in reply order, without their quotes.

A quoted line begins with one or more ``>``; their number is its level.  Neighbouring lines
of one level form a passage.  A passage and its paragraphs are normalised (lower case, white
space as one blank) and hashed, and so are the unquoted lines, paragraphs and whole bodies
of all messages.  A passage goes to the first message of its conversation that has it
unquoted, or else to the first of all other messages.  The message that a reply answers is
the latest one its lowest level leads to; a message's thread is the turn its chain of replies
starts at.  Sorted by thread and turn, replies follow what they answer.

Only DataFrame functions.  Originals are reduced to two conversations a hash before they meet
the quotes, so common lines and long conversations stay small; chains of replies halve in
length each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, text_of

QUOTED = r"^\s*>"
#: Introduces a quote and goes with it.
ATTRIBUTION = r"^\s*(On .*wrote|Am .*schrieb.*|Le .*a écrit|El .*escribió)\s*:\s*$"


def level_of(line: Column) -> Column:
    """How many > stand before a line's text (blanks may stand between)."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), r"[^>]", ""))


def without_mark(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]*>)+[ \t]?", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hash_of(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text).cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def unquoted(text: Column) -> Column:
    """The text without quoted lines and their attributions, blank lines at its ends cut off."""
    own = F.filter(_lines(text), lambda x: ~x.rlike(QUOTED) & ~x.rlike(ATTRIBUTION))
    return F.when(text.rlike(r"(?m)" + QUOTED), F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, at, passage) of messages (mid, conv_id, turn, text) that quote."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)" + QUOTED))
    lines = quoting.select("mid", "conv_id", "turn", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.select("mid", "conv_id", "turn", "at", level_of(F.col("line")).alias("level"), without_mark(F.col("line")).alias("line"))
    in_order = Window.partitionBy("mid").orderBy("at")  # the lines of one message
    lines = lines.withColumn("begins", F.when(F.col("level") == F.lag("level").over(in_order), 0).otherwise(1))
    lines = lines.withColumn("part", F.sum("begins").over(in_order)).filter("level > 0")
    found = lines.groupBy("mid", "conv_id", "turn", "level", "part").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return found.select("mid", "conv_id", "turn", "level", "at", text.alias("passage"))


def _pieces(text: Column, lines: bool) -> Column:
    """The hashes of a text, its paragraphs and, if wanted, its lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), _lines(text) if lines else F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: F.length(F.trim(x)) > 0), hash_of))


def links(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(mid, level, at, source_conv, source_turn): each passage's original, null where there is none."""
    hashes = quoted.select("mid", "conv_id", "turn", "level", "at", F.explode(_pieces(F.col("passage"), True)).alias("hash"))
    wanted = hashes.select("hash").distinct()
    originals = messages.select("conv_id", "turn", F.explode(_pieces(unquoted(F.col("text")), True)).alias("hash"))
    here = originals.join(wanted, "hash", "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    here = cut(here)
    # Two conversations for each hash: a quoting one that has it itself, but later, still finds another's.
    of = F.min(F.struct(F.col("conv_id").alias("conv"), F.col("here").alias("turn")))
    first = cut(here.groupBy("hash").agg(of.alias("first")))
    second = here.join(first, "hash").filter(F.col("conv_id") != F.col("first.conv")).groupBy("hash").agg(of.alias("second"))
    first = cut(first.join(second, "hash", "left"))
    found = hashes.join(here, ["conv_id", "hash"], "left").join(first, "hash", "left")
    near = F.when(F.col("here") < F.col("turn"), F.struct(F.col("conv_id").alias("conv"), F.col("here").alias("turn")))
    far = F.when(F.coalesce(F.col("first.conv") != F.col("conv_id"), F.lit(True)), F.col("first")).otherwise(F.col("second"))
    found = found.withColumn("source", F.coalesce(near, far)).withColumn("is_near", near.isNotNull())
    # The conversation's own message comes first, then the latest turn.
    best = F.max(F.when(F.col("source").isNotNull(), F.struct("is_near", "source.turn", "source.conv")))
    out = found.groupBy("mid", "level", "at").agg(best.alias("best"))
    return out.select("mid", "level", "at", F.col("best.conv").alias("source_conv"), F.col("best.turn").alias("source_turn"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) for rows (conv_id, turn, reply_to): where a chain of replies starts, and how long it is; reply_to < turn."""
    rows = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = rows.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("over"), F.col("depth").alias("more"))
        joined = cut(rows.join(above, ["conv_id", "thread"], "left"))
        if joined.filter("over IS NOT NULL").isEmpty():
            return rows
        rows = joined.select("conv_id", "turn", F.coalesce("over", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), reply_to, thread, depth, quote_levels, n_quotes, n_linked.

    Sorted by conv_id, thread and turn, a conversation is in reply order.  ``reply_to`` is a
    turn of the same conversation, null where nothing quoted is found there; ``thread`` is the
    turn at the start of the chain and ``depth`` the number of replies from there.  Null text
    counts as empty.  Messages that share conversation and turn share their reply.  A
    message without a conversation or a turn links to nothing.  Quotes alone leave an empty
    text; a quote of a blank line has no passage.  An empty table gives no rows.
    """
    messages = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text_of(text_col).alias("text")
    )
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn")], F.coalesce(F.length("role").cast("string"), F.lit("-")), F.coalesce("role", F.lit("")), "text")
    messages = messages.withColumn("mid", F.unhex(F.sha2(told, 256)))
    quoted = cut(passages(messages.select("mid", "conv_id", "turn", "text").distinct()))
    rows = messages.withColumn("own", unquoted(F.col("text")))
    if not quoted.limit(1).count():
        return rows.select(
            "conv_id", "turn", "role", F.col("own").alias("text"), F.lit(None).cast("long").alias("reply_to"),
            F.col("turn").alias("thread"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("quote_levels"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"),
        )
    found = cut(links(messages, quoted))
    own = quoted.join(found, ["mid", "level", "at"], "left")
    here = F.when(F.col("source_conv") == F.col("conv_id"), F.struct((-F.col("level")).alias("level"), F.col("source_turn").alias("turn")))
    summary = cut(
        own.groupBy("mid", "conv_id", "turn").agg(
            F.max(here).alias("best"), F.max("level").alias("quote_levels"), F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked")
        ).withColumn("reply_to", F.col("best.turn")).drop("best")
    )
    replies = summary.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to")).filter("reply_to IS NOT NULL")
    replies = cut(replies.join(threads(replies), ["conv_id", "turn"]))
    rows = rows.join(summary.drop("conv_id", "turn", "reply_to"), "mid", "left").join(replies, ["conv_id", "turn"], "left")
    return rows.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("quote_levels", F.lit(0)).alias("quote_levels"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
