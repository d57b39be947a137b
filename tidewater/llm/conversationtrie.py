"""Prefix trie of conversations.

Turns travel as digests.  Conversations with equal turns become one path with a count.
Paths are dealt into buckets by a hash of their first turn, and each bucket's tries are
built in one task: nodes are numbers, a dictionary leads from (parent, turn) to the child,
and subtree totals come from an iterative postorder.  A first turn with more rows than a
task's share is taken out first: the run of turns that all its paths have in common (its
spine) is made by aggregation, and its paths are dealt again by the next turn, round by
round, until no group is oversized.  Totals of what was dealt again go back up the rounds.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, shuffle_parts, text_of

#: Rows (turns) of paths with one first turn that a task takes, whatever the number of tasks.
MOST_GROUP_ROWS = 100_000
#: Groups of fewer rows (some 100 KB) are never dealt again: a round of shuffles costs far more than they do.
LEAST_GROUP_ROWS = 1000
#: Ids in one block of a list that is hashed in order; a list of no more is hashed as it is.
ID_BLOCK = 4096

_WORD = "[^ \\t-\\r]+"
_NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, key: str, order: list[Column], most: int = MOST_GROUP_ROWS) -> DataFrame:
    """Add ``pos``: a row's place (from 0) among the rows of its key.

    A key with over ``most`` rows is no single task's: such rows are sorted over range
    partitions, and the key starts in each where the one before it ended.
    """
    spark = rows.sparkSession
    large = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    if large.isEmpty():
        return rows.withColumn("pos", place.cast("long"))
    by = [F.col(key)] + order
    some = rows.join(large, key, "left_semi").repartitionByRange(shuffle_parts(spark), *by).sortWithinPartitions(*by)
    placed = cut(some.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = placed.join(parts, [key, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_skip")).drop("_at", "_part", "_first", "_skip")
    return rows.join(large, key, "left_anti").withColumn("pos", place.cast("long")).unionByName(placed)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, pos, digest, words: turns in order (null first; equal turn numbers by digest).  Rows without conv_id belong to none."""
    role, text = text_of("role"), text_of("text")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    return numbered(cut(rows), "conv", [F.col("turn").asc_nulls_first(), F.col("digest")]).select("conv", "pos", "digest", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each took the first h turns of another: h = crc32(id) mod ``heads``, the other is id - id % ``every``.

    At most ``2 * every`` conversations take from one, ``heads`` - 1 turns each.
    conversations: conv, size (turns after that).
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("long")
    # At most heads - 1 turns of each conversation that others take from.
    firsts = turns.filter((F.col("pos") < heads - 1) & (F.col("conv") % every == 0)).groupBy(F.col("conv").alias("other")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("firsts"))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("other")).join(firsts, "other", "left")
    convs = cut(convs.select("conv", "own", "h", F.slice(F.coalesce("firsts", F.array()), F.lit(1), F.col("h").cast("int")).alias("firsts")))
    taken = F.size("firsts").cast("long")
    head = convs.select("conv", F.explode("firsts").alias("t")).select("conv", "t.pos", "t.digest", "t.words")
    own = turns.withColumn("h", h).filter("pos >= h").join(convs.select("conv", taken.alias("taken")), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return convs.select("conv", (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), head.unionByName(own)


def paths_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, steps): conversations with equal turns as one path, and the turns of each path once.

    classes: path (its smallest conversation), n, size (turns), ``top`` (first turn, null if
    there is none), ends (hash of the members' ids).  A path is told by its length, its first
    turn and three 64-bit sums over SHA-256 digests and places.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "digest")).alias(f"_m{seed}") for seed in range(3)]
    told = turns.groupBy("conv").agg(F.count("*").alias("size"), F.min_by("digest", "pos").alias("top"), *marks)
    nothing = convs.filter("size = 0").select("conv", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("top"), *[F.lit(0).cast("long").alias(f"_m{s}") for s in range(3)])
    told = cut(told.unionByName(nothing))
    keys = ["size", "top", "_m0", "_m1", "_m2"]
    classes = cut(told.groupBy(*keys).agg(F.min("conv").alias("path"), F.count("*").alias("n")))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    members = cut(told.alias("t").join(cut(classes.filter("n > 1")).alias("m"), same).select("m.path", "t.conv", "m.n"))
    ends = id_list_sha256(members, "path", "conv")
    alone = F.when(F.col("n") == 1, F.sha2(F.col("path").cast("string").cast("binary"), 256))
    classes = cut(classes.join(ends, "path", "left").select("path", "n", "size", "top", F.coalesce(alone, "sha256").alias("ends")))
    steps = turns.join(classes.withColumnRenamed("path", "conv"), "conv").select(
        F.col("conv").alias("path"), "pos", "digest", "words", "n", F.hex("top").alias("grp"), F.when(F.col("pos") == F.col("size") - 1, F.col("ends")).alias("ends")
    )
    return classes, cut(steps)


def id_list_sha256(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, sha256): hash of the key's ids as decimals, ascending, with commas.  Rows: key, id, n (ids of the key).

    Long lists are put together in blocks wherever they lie; only the hashing of a key's
    blocks, which has an order, is one task's, a block at a time.
    """
    joined = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    short = rows.filter(F.col("n") <= ID_BLOCK).groupBy(key).agg(F.sha2(joined(F.sort_array(F.collect_list(id_col))).cast("binary"), 256).alias("sha256"))
    long_lists = rows.filter(F.col("n") > ID_BLOCK).select(key, id_col)
    if long_lists.isEmpty():
        return short
    ids = joined(F.sort_array(F.collect_list(id_col))).alias("_ids")
    blocks = numbered(long_lists, key, [F.col(id_col)]).groupBy(key, F.expr(f"pos div {ID_BLOCK}").alias("_block")).agg(ids)

    def run(frames):
        now, sha = None, None
        for frame in frames:
            done = []
            for k, ids in zip(frame[key], frame["_ids"]):
                if sha is None or k != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[key, "sha256"])
        if sha is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=[key, "sha256"])

    hashed = blocks.repartition(shuffle_parts(rows.sparkSession), key).sortWithinPartitions(key, "_block").select(key, "_ids").mapInPandas(run, f"{key} long, sha256 string")
    return short.unionByName(hashed)


_NODES = "grp string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _tries(frame: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of one bucket; rows (grp, parent, path, pos, digest, words, n, ends)."""
    frame = frame.sort_values(["path", "pos"], kind="stable")
    child: dict[tuple, int] = {}
    up, grp, depth, words, convs, least, outer, children, ends = [], [], [], [], [], [], [], [], []
    path_now, node = None, -1
    for g, parent, path, pos, digest, w, n, end in zip(*(frame[c].tolist() for c in ("grp", "parent", "path", "pos", "digest", "words", "n", "ends"))):
        if path != path_now:
            path_now, node = path, -1
        key = (node, digest) if node >= 0 else (-1, g)
        at = child.get(key)
        if at is None:
            at = child[key] = len(up)
            up.append(node)
            grp.append(g)
            depth.append(pos + 1)
            words.append(w)
            convs.append(0)
            least.append(path)
            outer.append(parent)
            children.append(0)
            ends.append(_NO_IDS)
            if node >= 0:
                children[node] += 1
        convs[at] += n
        least[at] = min(least[at], path)
        if isinstance(end, str):
            ends[at] = end
        node = at
    leaves = [int(c == 0) for c in children]
    saved = [(c - 1) * w for c, w in zip(convs, words)]
    # A child's number is larger than its parent's: going down the numbers is a postorder.
    for at in range(len(up) - 1, -1, -1):
        if up[at] >= 0:
            leaves[up[at]] += leaves[at]
            saved[up[at]] += saved[at]
    parents = [least[u] if u >= 0 else o for u, o in zip(up, outer)]
    return pd.DataFrame({"grp": grp, "top": [u < 0 for u in up], "conv_id": least, "depth": depth, "parent_conv_id": parents, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def _spine(big: DataFrame) -> DataFrame:
    """The turns that all paths of a group have in common: grp, pos, words, convs, least, parent, base, last, ends.

    big: grp, parent, base, path, pos, digest, words, n, ends; pos >= base.  ``ends`` is that
    of the one path which may end with the spine.
    """
    shared = cut(
        big.groupBy("grp", "pos").agg(
            F.count("*").alias("_paths"), F.min("digest").alias("_a"), F.max("digest").alias("_b"), F.max("words").alias("words"), F.max("ends").alias("ends"),
            F.sum("n").alias("convs"), F.min("path").alias("least"), F.min("parent").alias("parent"), F.min("base").alias("base"),
        )
    )
    groups = cut(shared.filter("pos = base").select("grp", F.col("_paths").alias("paths")))
    common = (F.col("_paths") == F.col("paths")) & (F.col("_a") == F.col("_b"))
    judged = shared.join(groups, "grp").withColumn("_common", common)
    last = cut(judged.groupBy("grp").agg((F.coalesce(F.min(F.when(~F.col("_common"), F.col("pos"))), F.max("pos") + 1) - 1).alias("last")))
    return cut(shared.join(last, "grp").filter("pos <= last").select("grp", "pos", "words", "convs", "least", "parent", "base", "last", "ends"))


def _spine_nodes(spine: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of spines; below: grp, n_children, below_leaves, below_saved of what follows a spine.

    A node's saved tokens run from it to the end of the spine and on; sums go by blocks of
    places, so a spine of any length is no single task's.
    """
    rows = spine.withColumn("_block", F.expr("pos div 4096")).withColumn("_own", (F.col("convs") - 1) * F.col("words"))
    down = Window.partitionBy("grp", "_block").orderBy(F.desc("pos"))
    blocks = rows.groupBy("grp", "_block").agg(F.sum("_own").alias("_sum"))
    later = Window.partitionBy("grp").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("_later", F.coalesce(F.sum("_sum").over(later), F.lit(0))).drop("_sum"))
    rows = rows.withColumn("_here", F.sum("_own").over(down)).join(blocks, ["grp", "_block"]).join(below, "grp", "left")
    end, none = F.col("pos") == F.col("last"), F.lit(0).cast("long")
    return rows.select(
        "grp", (F.col("pos") == F.col("base")).alias("top"), F.col("least").alias("conv_id"), (F.col("pos") + 1).alias("depth"),
        F.when(F.col("pos") == F.col("base"), F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(end, F.coalesce("n_children", none)).otherwise(1).alias("n_children"),
        F.coalesce("below_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("_here") + F.col("_later") + F.coalesce("below_saved", none)).alias("saved_tokens"),
        F.coalesce(F.when(end, F.col("ends")), F.lit(_NO_IDS)).alias("ends_sha256"),
    )


def trie_nodes(classes: DataFrame, steps: DataFrame, group_rows: int | None = None) -> DataFrame:
    """One row for each node of the trie of the paths.

    ``group_rows``: above so many rows a group is dealt again; by default a task's share of
    all rows, at least LEAST_GROUP_ROWS and at most MOST_GROUP_ROWS.  Rounds go by the next
    turn after what a group has in common, so each of them splits a group or ends it.
    """
    spark, parts = classes.sparkSession, shuffle_parts(classes.sparkSession)
    whole = classes.agg(F.sum("n").alias("n"), F.min("path").alias("least"), F.sum("size").alias("rows"), F.max(F.when(F.col("size") == 0, F.col("ends"))).alias("ends")).first()
    if whole["n"] is None:
        return spark.createDataFrame([], _NODES).drop("grp", "top")
    limit = group_rows or max(LEAST_GROUP_ROWS, min(MOST_GROUP_ROWS, whole["rows"] // parts))
    buckets = max(2 * parts, -(-whole["rows"] // MOST_GROUP_ROWS))
    sizes = cut(classes.filter("top IS NOT NULL").groupBy(F.hex("top").alias("grp")).agg(F.sum("size").alias("_rows"), F.lit(None).cast("string").alias("_from")))
    now = steps.withColumns({"parent": F.lit(whole["least"]), "base": F.lit(0).cast("long")})
    smalls, rounds, firsts = [], [], sizes
    while True:
        large = cut(sizes.filter(F.col("_rows") > limit).select("grp"))
        if large.isEmpty():
            smalls.append(now)
            break
        smalls.append(now.join(large, "grp", "left_anti"))
        big = now.join(large, "grp", "left_semi")
        spine = _spine(big)
        marked = big.join(spine.filter("pos = last").select("grp", F.col("least").alias("_least"), "last"), "grp").filter("pos > last")
        turn = marked.filter(F.col("pos") == F.col("last") + 1).select("path", F.sha2(F.concat(F.col("grp").cast("binary"), "digest"), 256).alias("_next"))
        now = cut(marked.join(turn, "path").select("path", "pos", "digest", "words", "n", "ends", F.col("_next").alias("grp"), F.col("grp").alias("_from"), F.col("_least").alias("parent"), (F.col("last") + 1).alias("base")))
        sizes = cut(now.groupBy("grp", "_from").agg(F.count("*").alias("_rows")))
        now = now.drop("_from")
        rounds.append((spine, sizes.select("_from", "grp")))
    wanted = ["grp", "parent", "path", "pos", "digest", "words", "n", "ends"]
    rows = smalls[0].select(*wanted)
    for more in smalls[1:]:
        rows = rows.unionByName(more.select(*wanted))
    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets))
    nodes = cut(rows.select(bucket.alias("bucket"), *wanted).groupBy("bucket").applyInPandas(lambda frame: _tries(frame), _NODES))
    totals = ["grp", "n_leaves", "saved_tokens"]
    tops, made = nodes.filter("top").select(*totals), [nodes]
    for spine, links in reversed(rounds):
        below = links.join(tops, "grp").groupBy(F.col("_from").alias("grp")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
        made.append(cut(_spine_nodes(spine, cut(below))))
        tops = tops.unionByName(made[-1].filter("top").select(*totals))
    sums = (tops.join(firsts.select("grp"), "grp", "left_semi") if rounds else tops).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    root = (None, False, whole["least"], 0, None, whole["n"], sums["n"], sums["leaves"] or 1, sums["saved"] or 0, whole["ends"] or _NO_IDS)
    out = spark.createDataFrame([root], _NODES)
    for part in made:
        out = out.unionByName(part)
    return out.drop("grp", "top")


def conversation_trie(conversations: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations (``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  The root (depth 0) has every conversation as a member.  Null
    role or text is empty; a null turn comes first; equal turn numbers go by the digest of
    role and text; repeated rows are turns of their own; rows without conv_id are left out.
    An empty table gives no rows; other columns don't matter.
    """
    convs, turns = rebuilt(cut(turn_rows(conversations)))
    return trie_nodes(*paths_of(convs, cut(turns)), group_rows)
