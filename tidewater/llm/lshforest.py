"""N-gram Jaccard join through a MinHash LSH forest.

A text is the set of its runs of ``n`` words (white-space words, lower case).  Texts with
the same set form a class; one row stands for it.  Each class has a MinHash signature, cut
into one label for each tree of a forest: ``longest`` minima in order.  A tree is a prefix
trie kept as a sorted list, so classes with a common prefix stand side by side.

How long a prefix neighbours must share is found for each row.  It begins with the whole
label and is shortened as far as the classes that share it can all be compared, and at most
to the length at which a pair at the threshold shares it in some tree with the target recall.
A crowded bucket, one with more than LEADERS classes unlike each other, is compared at
longer prefixes only; what that costs is added up over the trees of a row, and rows whose
recall falls below the target meet by exact prefix filtering on their rarest runs instead.

In a bucket, classes are compared by 128-bit sketches with leaders: a class is covered by
the first leader much like it and leads otherwise.  Differing bits obey the triangle
inequality, so two linked classes are both like the leader that covers one of them; no pair
in a bucket is skipped, and a bucket of near copies has few leaders.  A bucket that lies
across tasks sends only its leaders to meet each other.

The components of the candidate edges are what is verified: inside a component, all pairs of
sets are compared exactly, block by block, and only counts and one edge per member leave the
task.  So a group of many near copies costs no rows for its pairs, loses no link, and no task
holds more than two blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, resident, text_of, written
from tidewater.llm.words import slices
from tidewater.operators.graph import connected_components

N_WORDS = 5
THRESHOLD = 0.8
TREES = 40
MAX_DEPTH = 10
TARGET_RECALL = 0.99999
#: Sketch similarity from which two classes of a bucket become candidates; among leaders of different tasks, each up to
#: 1 - COVER_SPREAD from what it covers, less is asked for.
LEAST_SKETCH, LEAST_LEADERS = 0.4, 0.3
#: A class this much like a leader is covered by it: in a bucket of one task, and in one across tasks.
COVER, COVER_SPREAD = 0.8, 0.9
SKETCH_BITS = 128
#: Leaders of a bucket; one that needs more is crowded.
LEADERS = 1024
#: Rows of one bucket that a task holds at a time.
HOLD = 500_000
#: Buckets up to this size are compared pair by pair, all of them together.
SMALL = 4
#: Shingles in a block of a component.
BLOCK_SHINGLES = 300_000
SEED = 7

_P = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, longest: int = MAX_DEPTH) -> int:
    """The longest prefix, from ``longest`` downwards, with which a pair at the threshold meets in some tree with the recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, n: int = N_WORDS) -> list[np.ndarray]:
    """Sorted 64-bit fingerprints of the runs of n words; a text with fewer words has one run of them all, none has none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy()
    flat = lists.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    real = pc.not_equal(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    out = []
    for a, b in zip(np.append(0, ends), ends):
        words = hashes[a:b]
        if not len(words):
            out.append(np.zeros(0, np.uint64))
            continue
        size = max(1, len(words) - n + 1)
        mixed = np.zeros(size, np.uint64)
        for k in range(min(n, len(words))):
            mixed = mixed * _P + words[k : k + size]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        out.append(np.unique(mixed))
    return out


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _families(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(SEED))
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minima for each set, which must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    multiply, add = _families(k)
    out = np.empty((len(sets), k), np.uint64)
    for j in range(k):
        value = flat ^ add[j]
        value *= multiply[j]
        out[:, j] = np.minimum.reduceat(value, starts)
    return out


def _signed(docs: DataFrame, n: int, trees: int, depth: int, longest: int) -> DataFrame:
    """row, doc_id, key (null: no words), size, highs and lows (each tree's label: the first ``depth`` minima, the others), sketch_a, sketch_b."""
    high_bits, low_bits = 60 // depth, min(8, 31 // max(1, longest - depth))

    def packed(signs: np.ndarray, first: int, last: int, bits: int) -> np.ndarray:
        """Some bits of the minima first to last of each tree, in order."""
        out = np.zeros((len(signs), trees), np.uint64)
        for d in range(first, last):
            out = out << np.uint64(bits) | (signs[:, d * trees : (d + 1) * trees] * _P) >> np.uint64(64 - bits)
        return out

    def run(batches):
        resident("forest", lambda: None)  # frees what an operator before this one left in the worker
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), n)
                keys = [set_key(s) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                highs, lows = [None] * len(sets), [None] * len(sets)
                a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if full:
                    signs = signatures([sets[i] for i in full], max(trees * longest, SKETCH_BITS))
                    bits = ((signs[:, :SKETCH_BITS] * _P) >> np.uint64(63)).astype(np.uint8)
                    both = np.packbits(bits, axis=1).view(np.int64)
                    a[full], b[full] = both[:, 0], both[:, 1]
                    for i, high, low in zip(full, packed(signs, 0, depth, high_bits).view(np.int64), packed(signs, depth, longest, low_bits).astype(np.int32)):
                        highs[i], lows[i] = high, low
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(highs, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int32())), pa.array(a), pa.array(b),
                    ],
                    ["row", "doc_id", "key", "size", "highs", "lows", "sketch_a", "sketch_b"],
                )

    schema = "row long, doc_id long, key binary, size long, highs array<long>, lows array<int>, sketch_a long, sketch_b long"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def cover(sketches: np.ndarray, least: float, enough: float, most: int | None, all_leaders: bool) -> tuple[list[tuple[int, int]], list[int], bool]:
    """(edges, leaders, whether ``most`` leaders were enough) for the sketches (n x 2 words) of a bucket's classes.

    The edges join all classes that a chain of pairs with a sketch similarity of ``least``
    between a leader and another class holds together.  Without ``all_leaders`` the search
    ends as soon as all are joined.
    """
    n = len(sketches)
    group, free = np.arange(n), np.ones(n, bool)
    edges, leaders, at = [], [], 0
    groups = n
    while (rest := np.flatnonzero(free[at:])).size and (all_leaders or groups > 1):
        if len(leaders) == most:
            return edges, leaders, False
        lead = at + int(rest[0])
        at = lead + 1
        leaders.append(lead)
        if at == n:
            break
        alike = 1 - np.bitwise_count(sketches[at:] ^ sketches[lead]).sum(axis=1, dtype=np.int64) * (2 / SKETCH_BITS)
        free[at:] &= alike < enough
        near = at + np.flatnonzero(alike >= least)
        met, first = np.unique(group[near], return_index=True)
        other = met != group[lead]
        if other.any():
            edges.extend((lead, k) for k in near[first[other]].tolist())
            group[np.isin(group, met)] = group[lead]
            groups -= int(other.sum())
    return edges, leaders, True


_BUCKET = ["tree", "high", "sub"]
_FOUND = "kind int, src binary, dst binary, tree int, high long, sub int, sketch_a long, sketch_b long"
_EDGE, _LEADER, _CROWDED = range(3)


def _found(kind: int, src: pa.Array, dst: pa.Array | None = None, bucket=None, sketches: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(src)
    none = lambda t: pa.nulls(n, t)
    tree, high, sub = bucket if bucket is not None else (none(pa.int32()), none(pa.int64()), none(pa.int32()))
    a, b = (pa.array(sketches[:, k].view(np.int64)) for k in (0, 1)) if sketches is not None else (none(pa.int64()), none(pa.int64()))
    columns = [pa.array(np.full(n, kind, np.int32)), src, dst if dst is not None else none(pa.binary()), pa.array(tree), pa.array(high), pa.array(sub), a, b]
    return pa.RecordBatch.from_arrays(columns, ["kind", "src", "dst", *_BUCKET, "sketch_a", "sketch_b"])


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("sketch_a", "sketch_b")], axis=1).view(np.uint64)


def _compared(rows: DataFrame, most: int | None) -> DataFrame:
    """Edges, leaders of buckets that may lie across tasks, and crowded buckets, from rows (tree, high, sub, low, key, sketch_a, sketch_b)."""
    # By key in a bucket, so that the trees of a group of near copies choose the same leaders and give the same edges.
    hold, order = HOLD, [*_BUCKET, "key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(table: pa.Table, open_first: bool, open_last: bool):
        """What whole buckets give; the first and the last may go on in other tasks."""
        n = table.num_rows
        names = [table.column(c).to_numpy() for c in _BUCKET]
        key, sketch = table.column("key").combine_chunks(), _sketches(table)
        fresh = np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0))
        begins = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begins, n))
        spread = np.zeros(len(begins), bool)
        spread[0] |= open_first
        spread[-1] |= open_last
        small = (sizes <= SMALL) & ~spread
        is_small, bucket = np.repeat(small, sizes), np.cumsum(fresh)
        src, dst = [], []
        for back in range(1, SMALL):
            b = back + np.flatnonzero((bucket[back:] == bucket[:-back]) & is_small[back:]) if n > back else np.zeros(0, np.int64)
            alike = 1 - np.bitwise_count(sketch[b - back] ^ sketch[b]).sum(axis=1, dtype=np.int64) * (2 / SKETCH_BITS)
            b = b[alike >= LEAST_SKETCH]
            src.append(b - back)
            dst.append(b)
        leaders, crowded = [], []
        for k in np.flatnonzero(~small).tolist():
            a = int(begins[k])
            wide = bool(spread[k])
            edges, lead, done = cover(sketch[a : a + sizes[k]], LEAST_SKETCH, COVER_SPREAD if wide else COVER, most, wide)
            if edges:
                pairs = a + np.array(edges)
                src.append(pairs[:, 0])
                dst.append(pairs[:, 1])
            if not done:
                crowded.append(a)
            elif wide:
                leaders.extend(a + x for x in lead)
        src, dst = np.concatenate(src), np.concatenate(dst)
        if len(src):
            yield _found(_EDGE, key.take(pa.array(src)), key.take(pa.array(dst)))
        for kind, at in ((_LEADER, leaders), (_CROWDED, crowded)):
            if at:
                yield _found(kind, key.take(pa.array(at)), None, [x[at] for x in names], sketch[at])

    def run(batches):
        held, first = [], True
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            names = [batch.column(c).to_numpy() for c in _BUCKET]
            last = np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))
            inside = 0 if not len(last) else int(last[-1]) + 1  # where the batch's last bucket begins
            if inside:
                table = pa.Table.from_batches(held).combine_chunks()
                yield from compare(table.slice(0, size - batch.num_rows + inside), first, False)
                held, size, first = [batch.slice(inside)], batch.num_rows - inside, False
            elif size > hold:
                yield from compare(pa.Table.from_batches(held).combine_chunks(), True, True)
                held, size, first = [], 0, True
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks(), first, True)

    return cut(rows.mapInArrow(run, _FOUND))


def _among_leaders(found: DataFrame) -> DataFrame:
    """Edges among the leaders that the tasks of one bucket found: at most LEADERS for each task it lies in."""

    def meet(table: pa.Table) -> pa.Table:
        edges, _, _ = cover(_sketches(table), LEAST_LEADERS, COVER_SPREAD, None, False)
        key, pairs = table.column("src").combine_chunks(), np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"src": key.take(pa.array(pairs[:, 0])), "dst": key.take(pa.array(pairs[:, 1]))})

    leaders = found.filter(F.col("kind") == _LEADER)
    many = leaders.groupBy(*_BUCKET).count().filter("count > 1").drop("count")
    return leaders.join(many, _BUCKET, "left_semi").groupBy(*_BUCKET).applyInArrow(meet, "src binary, dst binary")


def forest_edges(classes: DataFrame, depth: int, trees: int = TREES, longest: int = MAX_DEPTH, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidate edges (src, dst) between keys, keys whose recall is below the target).  ``classes``: key, highs, lows, sketches."""
    most = LEADERS if most is None else most
    low_bits = min(8, 31 // max(1, longest - depth))
    rows = classes.select("key", "sketch_a", "sketch_b", F.posexplode(F.arrays_zip("highs", "lows")).alias("tree", "label"))
    rows = rows.select(F.col("tree").cast("int").alias("tree"), F.col("label.highs").alias("high"), F.lit(0).alias("sub"), F.col("label.lows").alias("low"), "key", "sketch_a", "sketch_b")
    edges, missed = [], None
    for length in range(depth, longest + 1):
        found = _compared(rows, most)
        edges += [found.filter(F.col("kind") == _EDGE).select("src", "dst"), _among_leaders(found)]
        crowded = found.filter(F.col("kind") == _CROWDED).select(*_BUCKET).distinct()
        if not crowded.limit(1).count():
            break
        # Crowded at this length: the classes in it are compared at a longer one, and meet so much less often.
        rows = rows.join(crowded, _BUCKET, "left_semi")
        if length < longest:
            rows = rows.withColumn("sub", F.shiftright("low", low_bits * (longest - length - 1)))
        rows = cut(rows)
        meets = threshold ** (length + 1) if length < longest else 0.0
        factor = float(np.log1p(-meets) - np.log1p(-(threshold**length)))  # of the chance to miss, in this tree
        step = rows.groupBy("key").agg((F.count("*") * F.lit(factor)).alias("more"))
        missed = step if missed is None else missed.unionByName(step)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    if missed is None:
        return out.distinct(), classes.select("key").limit(0)
    base = trees * float(np.log1p(-(threshold**depth)))
    goal = max(float(np.log1p(-recall)), base)
    low = missed.groupBy("key").agg(F.sum("more").alias("more")).filter(F.col("more") + base > goal + 1e-9)
    return out.distinct(), low.select("key")


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components as ``edges``, little more than one for each vertex.

    A class meets one leader in each tree, and the trees' leaders differ.  Edges are dealt by
    the class they lead to; a task keeps those that join what it has not joined yet.
    """
    hold = HOLD

    def run(batches):
        number, parent = {}, []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            if len(parent) > hold:
                number, parent = {}, []
            keep = []
            for k, ends in enumerate(zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist())):
                for v in ends:
                    if v not in number:
                        number[v] = len(parent)
                        parent.append(number[v])
                a, b = (root(number[v]) for v in ends)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    keep.append(k)
            if keep:
                yield batch.take(pa.array(keep))

    return edges.select("src", "dst").repartition(F.col("dst")).mapInArrow(run, "src binary, dst binary")


def exact_edges(docs: DataFrame, few: DataFrame, n: int, threshold: float) -> DataFrame:
    """Candidate edges (src, dst) among the classes ``few`` (key, row, sketch_a, sketch_b): all pairs that share one of the
    rarest runs that a pair at the threshold cannot do without."""
    texts = docs.select("row", "text").join(few, "row")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), n)
                at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                columns = [part.column(c).take(pa.array(at)) for c in ("key", "sketch_a", "sketch_b")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(sets).view(np.int64))], ["key", "sketch_a", "sketch_b", "high"])

    runs = cut(texts.mapInArrow(run, "key binary, sketch_a long, sketch_b long, high long"))
    uses = runs.groupBy("high").agg(F.count("*").alias("uses"))
    own = Window.partitionBy("key")  # the runs of one text
    ranked = runs.join(uses, "high").withColumn("at", F.row_number().over(own.orderBy("uses", "high"))).withColumn("size", F.count("*").over(own))
    rare = ranked.filter((F.col("at") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1) & (F.col("uses") > 1))
    rows = rare.select(F.lit(0).alias("tree"), "high", F.lit(0).alias("sub"), F.lit(0).alias("low"), "key", "sketch_a", "sketch_b")
    found = _compared(rows, None)
    return found.filter(F.col("kind") == _EDGE).select("src", "dst").unionByName(_among_leaders(found)).distinct()


def _compare(left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of sets with Jaccard similarity of at least the threshold, through the right side's inverted lists."""
    sizes = np.array([len(s) for s in right])
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out_a, out_b = [], []
    for i, s in enumerate(left):
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(right))
        hit = np.flatnonzero(common >= threshold * (len(s) + sizes - common) - 1e-9)
        hit = hit[hit > i] if same else hit
        out_a.append(np.full(len(hit), i))
        out_b.append(hit)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's group."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key, n_links, root) parts from all pairs inside components.  ``members``: key, row (of one of its texts), copies, size, component."""
    totals = members.groupBy("component").agg(F.sum("size").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = cut(members.join(_large(totals), "component").withColumn("blocks", blocks).drop("total", "size"))
    texts = docs.select("row", "text").join(_large(members), "row").select("key", "copies", "component", "blocks", "text")

    def shingled(batches):
        for batch in batches:
            for part in slices(batch):
                arrays = pa.array([s.tobytes() for s in shingle_sets(part.column("text"), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "copies", "component", "blocks")), arrays], ["key", "copies", "component", "blocks", "shingles"])

    rows = texts.mapInArrow(shingled, "key binary, copies long, component binary, blocks int, shingles binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        keys, copies = group["key"].tolist(), group["copies"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        block = group["block"].to_numpy()
        if low == high:
            a, b = _compare(sets, sets, threshold, True)
        else:
            own, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
            a, b = _compare([sets[i] for i in own], [sets[i] for i in other], threshold, False) if len(own) and len(other) else (own[:0], own[:0])
            a, b = own[a], other[b]
        links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
        root = _roots(len(keys), a, b)
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"key": [keys[i] for i in some], "n_links": links[some].astype(np.int64), "root": [keys[root[i]] for i in some]})

    return paired.groupBy("component", "low", "high").applyInPandas(verify, "key binary, n_links long, root binary")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``row`` of its own for each row."""
    # Written once, so that the numbers are the same wherever they are read.
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _large(df: DataFrame) -> DataFrame:
    """A side that grows with the documents: joined by shuffle at every size, never broadcast."""
    return df.hint("merge")


def _joined(docs: DataFrame, n: int, threshold: float, trees: int, recall: float, longest: int) -> DataFrame:
    """(row, doc_id, class, class_id, n_links, n_copies) for numbered rows (row, doc_id, text).

    ``class`` is a key, null for a text without words; ``class_id`` the smallest id in the class.
    """
    depth = depth_for(threshold, trees, recall, longest)
    signed = cut(_signed(docs, n, trees, depth, longest))
    label = ("highs", "lows", "sketch_a", "sketch_b")
    sums = (F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"))
    classes = cut(signed.filter(F.col("key").isNotNull()).groupBy("key").agg(*sums))
    stands = signed.select("row", "key", *label).join(_large(classes.select("row")), "row", "left_semi")
    edges, few = forest_edges(stands, depth, trees, longest, threshold, recall)
    few = cut(few)
    if few.limit(1).count():
        edges = edges.unionByName(exact_edges(docs, stands.join(few, "key").select("key", "row", "sketch_a", "sketch_b"), n, threshold))
    components = connected_components(spanning(edges))
    members = components.withColumnRenamed("id", "key").join(_large(classes.drop("doc_id")), "key")
    parts = cut(_verified(docs, members, n, threshold))
    linked = connected_components(parts.filter("key <> root").select(F.col("key").alias("src"), F.col("root").alias("dst")))
    sums = parts.groupBy("key").agg(F.sum("n_links").alias("links"))
    known = classes.select("key", "doc_id", "copies").join(_large(linked.withColumnRenamed("id", "key")), "key", "left").join(_large(sums), "key", "left")
    known = known.withColumn("class", F.coalesce("component", "key"))
    least = known.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    known = cut(known.join(_large(least), "class").select("key", "class", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = signed.select("row", "doc_id", "key").join(_large(known), "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return own.select("row", "doc_id", "class", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL,
    longest: int = MAX_DEPTH,
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies.

    ``n_links`` counts the other rows whose similarity is at least the threshold, copies
    included; ``n_copies`` the rows with the same set, the row itself included.  ``class_id``
    is the smallest id among all rows that links lead to, the row's own id if none do; it is
    null where none of them has an id.  A text without words (null counts as empty) has no
    links and is a class alone; one with fewer than ``n`` words has a single run.  Rows are
    told apart by a number of their own, so rows that share an id, or have none, count each.
    An empty table gives no rows.
    """
    docs = _numbered(df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")))
    return _joined(docs, n, threshold, trees, recall, longest).select("doc_id", "class_id", "n_links", "n_copies")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: that with the smallest id; of rows that share it, one.

    A null id comes after all others.  A text without words stays.
    """
    rows = _numbered(docs.select(F.struct("*").alias("doc")))
    own = rows.select("row", F.col("doc")[id_col].cast("long").alias("doc_id"), text_of(F.col("doc")[text_col]).alias("text"))
    joined = cut(_joined(own, N_WORDS, THRESHOLD, TREES, TARGET_RECALL, MAX_DEPTH).filter(F.col("class").isNotNull()).select("row", "doc_id", "class"))
    stays = joined.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    gone = joined.join(_large(stays.select(F.col("best.row").alias("row"))), "row", "left_anti")
    return rows.join(_large(gone.select("row")), "row", "left_anti").select("doc.*")
