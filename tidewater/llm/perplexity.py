"""Quality rules: word counts, and bands of n-gram perplexity for each language.

The model is an interpolated modified Kneser-Ney model over characters, counted by Spark
over all texts.  Letters are lower-cased, digits are one symbol, white space is one symbol,
and code points above a bound share classes, so a 5-gram packs into 50 bits.  Tasks count
their own 5-grams, Spark adds the counts, and the lower orders, their continuation counts,
discounts and probabilities are joins and sums over the table of distinct grams.

The tables keep each gram and context by its exact key, sorted by a one-to-one hash of it, so
their size follows the number of distinct grams.  Every text that is judged was counted, so each of its 5-grams has a log
probability of its own and scoring needs no back-off.  Up to BROADCAST_GRAMS of these are
broadcast; beyond that, texts are dealt into slices and each slice fetches its own grams' values by a join.

Verdict: a document stays if its log perplexity lies in the band of its language.  Chance
moves a short text further from the middle than a long one, so the band is the language's
median plus ``width`` and minus ``lower`` robust deviations over the root of the document's
word count, at least ``least``.  A deviation is 1.4826 times the median distance from the
middle, times the root of the word count, of the texts on that side: passages that very many
texts share draw those texts down, and so widen the lower side alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewater.llm.common import cut, resident, text_of, written
from tidewater.llm.words import slices

ORDER = 5
SYMBOL_BITS = 10
#: Distinct 5-grams that are broadcast to score texts (about 24 bytes each in a worker); more are joined, slice by slice.
BROADCAST_GRAMS = 2_000_000
#: Text that fetches its grams' values together.
SLICE_TEXT = 8 << 20
#: Code points below this have a symbol of their own; the others share the remaining symbols.
OWN_POINTS = 768
FLUSH_GRAMS = 1_000_000
#: Text that is turned into arrays at a time; a longer text is worked on in parts.
PART_CHARS = 1 << 18
#: The band above and below the middle in robust deviations, and at least (nats a character).
WIDTH = 5.0
LOWER = 8.0
LEAST_HALF_BAND = 0.04
NO_LANGUAGE = "und"
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"

_MASK = (1 << SYMBOL_BITS) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The symbol of each code point below 0x3000; 0 is kept for the start of a text."""
    out = np.zeros(0x3000, np.int64)
    for p in range(1, len(out)):
        c = chr(p)
        low = c.lower()
        p = ord(low) if len(low) == 1 else p
        if c.isspace():
            p = 32
        elif c.isdigit():
            p = 48
        out[ord(c)] = p if p < OWN_POINTS else OWN_POINTS + p % (_MASK + 1 - OWN_POINTS)
    return out


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    table = _symbols()
    high = points >= len(table)
    out = table[np.where(high, 0, points)]
    if high.any():
        out[high] = OWN_POINTS + points[high] % (_MASK + 1 - OWN_POINTS)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character, texts on end, and where each text begins."""
    coded = [symbols(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(flat)) - begin
    key = flat.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(flat)
        earlier[back:] = flat[:-back] if back < len(flat) else 0
        earlier[place < back] = 0
        key |= earlier << (SYMBOL_BITS * back)
    return key, offsets


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, where each part of a text begins, which text it is of), about PART_CHARS characters at a time.

    A part of a long text is read with the ORDER - 1 characters before it, whose grams are dropped.
    """
    held: list[tuple[int, str, int]] = []
    size = 0

    def made():
        keys, offsets = grams([t for _, t, _ in held])
        skip = np.array([n for _, _, n in held])
        if skip.any():
            keys = np.concatenate([keys[a + n : b] for a, b, n in zip(offsets, offsets[1:], skip)])
            offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - skip)])
        return keys, offsets, np.array([k for k, _, _ in held])

    for k, text in enumerate(texts):
        for at in range(0, len(text), PART_CHARS):
            before = min(at, ORDER - 1)
            held.append((k, text[at - before : at + PART_CHARS], before))
            size += len(held[-1][1])
            if size >= PART_CHARS:
                yield made()
                held, size = [], 0
    if held:
        yield made()


class Lookup:
    """Distinct keys sorted by a one-to-one hash, their values, and where each leading part of the hash begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = _mixed(keys)
        order = np.argsort(hashes)
        self.shift = np.uint64(64 - max(1, (2 * len(keys)).bit_length()))
        # The last entry ends every search.
        self.hashes = np.append(hashes[order], ~np.uint64(0))
        self.values = np.append(values[order].astype(np.float32), np.float32(np.nan))
        self.begins = np.searchsorted(hashes[order] >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys; nan for a key that isn't there."""
        hashes = _mixed(keys)
        at = self.begins[hashes >> self.shift]
        left = np.flatnonzero(self.hashes[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] < hashes[left]]
        return np.where(self.hashes[at] == hashes, self.values[at], np.nan)


def _mixed(keys: np.ndarray) -> np.ndarray:
    out = keys.astype(np.uint64) * _MIX
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): the ORDER-grams of all texts."""

    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            return key, n

        def out(key, n):
            for a in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 200_000]), pa.array(n[a : a + 200_000])], ["gram", "n"])

        for batch in batches:
            texts = (t for part in slices(batch) for t in parts(part.column("text").to_pylist()))
            for found, _, _ in texts:
                found.sort()
                first = np.flatnonzero(np.diff(found, prepend=-1))
                keys.append(found[first])
                counts.append(np.diff(np.append(first, len(found))))
                held += len(first)
                if held > FLUSH_GRAMS:
                    key, n = merged()
                    keys, counts, held = [key], [n], len(key)
                    if held > FLUSH_GRAMS // 2:
                        yield from out(key, n)
                        keys, counts, held = [], [], 0
        if held:
            yield from out(*merged())

    own = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "gram long, n long")
    return own.groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(top: DataFrame) -> DataFrame:
    """(order, kind, gram, value): log probabilities (kind p) and back-off weights of contexts (kind b)."""
    below = lambda order: (1 << (SYMBOL_BITS * order)) - 1
    counts = {ORDER: cut(top)}  # each order is written before the next is made from it, so texts are read once
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit(below(order)))
        counts[order] = cut(counts[order + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")))
    pieces = []
    lower = None
    for order in range(1, ORDER + 1):
        table = counts[order]
        have = {r.n: r.k for r in table.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
        n1, n2, n3, n4 = (have.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        cuts_ = [
            min(max(d, 0.0), i) if m else 0.5
            for i, d, m in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5, n1), (2, 2 - 3 * y * n3 / n2 if n2 else 0.5, n2), (3, 3 - 4 * y * n4 / n3 if n3 else 0.5, n3))
        ]
        n = F.col("n")
        discount = F.when(n == 1, cuts_[0]).when(n == 2, cuts_[1]).otherwise(cuts_[2])
        context = F.shiftrightunsigned("gram", SYMBOL_BITS)
        of = Window.partitionBy("context")  # at most 2 ** SYMBOL_BITS rows each
        rows = table.withColumn("context", context).withColumn("d", discount)
        rows = rows.withColumn("total", F.sum("n").over(of)).withColumn("spare", F.sum("d").over(of) / F.col("total"))
        own = (F.col("n") - F.col("d")) / F.col("total")
        if lower is None:
            rows = rows.withColumn("p", own + F.col("spare") / float(1 << SYMBOL_BITS))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(below(order - 1))))
            rows = rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
            rows = rows.withColumn("p", own + F.col("spare") * F.col("q"))
        rows = cut(rows.select("gram", "context", "n", "spare", "p"))
        pieces.append(rows.select(F.lit(order).alias("order"), F.lit("p").alias("kind"), "gram", "n", F.log("p").alias("value")))
        weights = rows.groupBy("context").agg(F.first("spare").alias("spare"), F.sum("n").alias("n"))
        pieces.append(weights.select(F.lit(order - 1).alias("order"), F.lit("b").alias("kind"), F.col("context").alias("gram"), "n", F.log("spare").alias("value")))
        lower = rows
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Model:
    """Grams and their values by (kind, order)."""

    arrays: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]

    @cached_property
    def tables(self) -> dict[tuple[str, int], Lookup]:
        return {key: Lookup(*own) for key, own in self.arrays.items()}

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        tables = self.tables
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = keys[left] & ((1 << (SYMBOL_BITS * order)) - 1)
            table = tables.get(("p", order))
            found = table(own) if table is not None else np.full(len(own), np.nan)
            seen = ~np.isnan(found)
            out[left[seen]] += found[seen]
            left, own = left[~seen], own[~seen]
            if not len(left):
                return out
            if ("b", order - 1) in tables:
                weight = tables["b", order - 1](own >> SYMBOL_BITS)
                out[left] += np.where(np.isnan(weight), 0.0, weight)
        out[left] -= SYMBOL_BITS * np.log(2)
        return out

    def text_scores(self, texts: list[str]) -> np.ndarray:
        """Log perplexity a character; nan for an empty text."""
        total, sizes = np.zeros(len(texts)), np.zeros(len(texts))
        for keys, offsets, owner in parts(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.log_probabilities(keys))])[offsets]
            np.add.at(total, owner, np.diff(sums))
            np.add.at(sizes, owner, np.diff(offsets))
        return np.where(sizes > 0, -total / np.maximum(sizes, 1), np.nan)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all texts and gather all orders at the driver, for texts that weren't counted."""
    rows = kneser_ney(count_grams(docs, text_col))
    return _model(rows.select("order", "kind", "gram", F.col("value").cast("float").alias("value")))


def _model(rows: DataFrame) -> Model:
    table = rows.withColumn("kind", F.col("kind") == "b").toArrow()
    order, back, gram, value = (table.column(c).to_numpy() for c in ("order", "kind", "gram", "value"))
    arrays = {}
    for o in range(ORDER + 1):
        for k in ("p", "b"):
            own = (order == o) & (back == (k == "b"))
            if own.any():
                arrays[k, o] = (gram[own], value[own])
    return Model(arrays)


def _repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the words inside 3-word windows that it has twice or more."""
    n_docs, n = len(offsets) - 1, len(codes)
    out = np.zeros(n_docs, np.int64)
    if n < 3:
        return out
    owner = np.repeat(np.arange(n_docs), np.diff(offsets))
    here = np.flatnonzero(owner[2:] == owner[:-2])
    if not len(here):
        return out
    bits = max(1, int(codes.max()).bit_length())
    a, b, c, d = (x.astype(np.int64) for x in (codes[here], codes[here + 1], codes[here + 2], owner[here]))
    if 3 * bits + max(1, n_docs.bit_length()) <= 62:
        key = (((d << bits | a) << bits | b) << bits) | c
    else:
        pair = np.unique(d << 31 | a, return_inverse=True)[1].astype(np.int64)
        triple = np.unique(pair << 31 | b, return_inverse=True)[1].astype(np.int64)
        key = triple << 31 | c
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    found = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[here[found] + k] = True
    return np.bincount(owner[covered], minlength=n_docs)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    symbol, char = np.zeros(256, np.int64), np.ones(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    char[0x80:0xC0] = 0
    char[list(SPACE)] = 0
    return symbol, char


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text (null: none)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(texts)
    at = words.offsets.to_numpy()
    flat = words.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    n_words = np.bincount(owner[real], minlength=len(texts)).astype(np.int64)
    codes = pc.dictionary_encode(flat).indices.to_numpy()[real] if len(flat) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(n_words)])
    strings = texts.to_pylist()
    symbol, char = _tables()
    n_symbols, word_chars, dup = (np.zeros(len(texts), np.int64) for _ in range(3))
    for k, text in enumerate(strings):
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        hist = np.bincount(data, minlength=256)
        n_symbols[k], word_chars[k] = hist @ symbol, hist @ char
        lines = text.split("\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            seen: set[str] = set()
            for line in lines:
                if line in seen:
                    dup[k] += bool(line.strip(" \t\n\x0b\x0c\r"))
                else:
                    seen.add(line)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": _repeats(codes, offsets)}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored_schema(docs: DataFrame) -> StructType:
    return StructType([*docs.schema, *(StructField(c, LongType()) for c in COUNTS), StructField("log_perplexity", DoubleType())])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the counts and log_perplexity (null for empty text) of its column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = _scored_schema(docs)

    def run(batches):
        resident("model", lambda: None)  # frees what an operator before this one left in the worker
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                yield _with_scores(part, own, schema.names)

    return docs.mapInArrow(run, schema)


def _with_scores(part: pa.RecordBatch, model: Model, names: list[str]) -> pa.RecordBatch:
    text = part.column("text")
    base = base_counts(text)
    score = model.text_scores([t or "" for t in text.to_pylist()])
    return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(base[c]) for c in COUNTS), pa.array(score, mask=np.isnan(score))], names)


def _scored_by_slices(docs: DataFrame, table: DataFrame) -> DataFrame:
    """As ``scored``, for texts all of whose grams are in ``table`` (gram, value).

    Texts are dealt into slices of bounded size, the distinct grams of a slice fetch their
    values by a join, and each slice is scored with the part of the model that it needs; so
    nothing that grows with the corpus is broadcast, and what moves is at most the texts and
    the distinct grams of each slice.
    """
    schema = _scored_schema(docs)

    def dealt(batches):
        partition = TaskContext.get().partitionId() << 32
        for k, part in enumerate(p for b in batches for p in slices(b, most=SLICE_TEXT)):
            yield part.append_column("slice", pa.array(np.full(part.num_rows, partition + k)))

    # Written once, so that the numbers are the same wherever they are read.
    rows = written(docs.mapInArrow(dealt, StructType([*docs.schema, StructField("slice", LongType())])), "slices")

    def own_grams(batches):
        for batch in batches:
            text, number = batch.column("text").to_pylist(), batch.column("slice").to_numpy()
            for a, b in zip(*_runs(number)):
                found = [np.unique(keys) for keys, _, _ in parts([t or "" for t in text[a:b]])]
                keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number[a])), pa.array(keys)], ["slice", "gram"])

    wanted = rows.select("slice", "text").mapInArrow(own_grams, "slice long, gram long").distinct()
    values = wanted.join(table, "gram").select("slice", "gram", "value")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model({("p", ORDER): (right.column("gram").to_numpy(), right.column("value").to_numpy())})
        texts = left.drop_columns("slice").combine_chunks().to_batches()
        return pa.Table.from_batches([_with_scores(p, model, schema.names) for b in texts for p in slices(b)], left.drop_columns("slice").schema if not texts else None)

    return rows.groupBy("slice").cogroup(values.groupBy("slice")).applyInArrow(judge, schema)


def _runs(numbers: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of one number begin and end."""
    edges = np.flatnonzero(np.diff(numbers)) + 1
    return [0, *edges.tolist()][: len(numbers)], [*edges.tolist(), len(numbers)]


def scorer(docs: DataFrame, text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Count the texts of ``docs``; what is returned scores rows whose texts are among them, as ``scored`` does."""
    top = kneser_ney(count_grams(docs, text_col)).filter((F.col("order") == ORDER) & (F.col("kind") == "p"))
    top = cut(top.select("order", "kind", "gram", F.col("value").cast("float").alias("value")))
    if top.count() > BROADCAST_GRAMS:
        return lambda rows: _scored_by_slices(rows, top.select("gram", "value"))
    model = _model(top)
    return lambda rows: scored(rows, model)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scores: DataFrame) -> DataFrame:
    """(language, middle, up, down): the median log perplexity, and the deviations of a text of one word on either side.

    From all documents that pass the base rules.
    """
    rows = scores.filter(~base_failed() & F.col("log_perplexity").isNotNull())
    middle = rows.groupBy("language").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    apart = (F.col("log_perplexity") - F.col("middle")) * F.sqrt("n_words")
    spread = rows.join(F.broadcast(middle), "language").groupBy("language")  # a row for each language
    side = lambda x: F.coalesce(1.4826 * F.percentile_approx(F.when(x > 0, x), 0.5, 10000), F.lit(0.0))
    return spread.agg(F.first("middle").alias("middle"), side(apart).alias("up"), side(-apart).alias("down"))


def _scores(docs: DataFrame, text_col: str, lang_col: str | None, keep: list[str]) -> tuple[DataFrame, list[Column]]:
    """(rows with language, counts and log_perplexity, written once; the columns ``keep`` of ``docs`` in them)."""
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no name of ours clashes
    name = dict(zip(docs.columns, own.columns))
    language = F.coalesce(F.col(name[lang_col]).cast("string"), F.lit(NO_LANGUAGE)) if lang_col else F.lit(NO_LANGUAGE)
    text = F.col(name[text_col]).cast("string")
    others = [name[c] for c in keep if c != text_col or docs.schema[c].dataType != StringType()]
    rows = own.select(*others, text.alias("text"), language.alias("language"))
    done = scorer(own, name[text_col])(rows)
    rows = written(done if text_col in keep else done.drop("text"), "scores")
    columns = [F.col(name[c] if name[c] in others else "text").alias(c) for c in keep]
    return rows, columns


def _judged(rows: DataFrame, limits: list[Row], width: float, lower: float, least: float) -> DataFrame:
    """Add low and high, the document's band, and kept.  ``limits``: a row for each language."""
    of = {k: F.lit(None).cast("double") for k in ("middle", "up", "down")}
    for r in limits:
        of = {k: F.when(F.col("language") == r.language, r[k]).otherwise(v) for k, v in of.items()}
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    low = of["middle"] - F.greatest(F.lit(least), lower * of["down"] / root)
    high = of["middle"] + F.greatest(F.lit(least), width * of["up"] / root)
    rows = rows.withColumn("low", low).withColumn("high", high)
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return rows.withColumn("kept", ~base_failed() & F.coalesce(inside, F.lit(False)))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", width: float = WIDTH, lower: float = LOWER, least: float = LEAST_HALF_BAND
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, low, high (its band), kept.

    Words are runs of anything but ASCII white space.  Null text counts as empty, has no
    words and fails the base rules.  Null languages share a band.  Equal rows are judged
    each.  An empty table gives no rows.  No column but these three is read.
    """
    rows, columns = _scores(docs, text_col, lang_col, [id_col])
    judged = _judged(rows, bands(rows).collect(), width, lower, least)
    return judged.select(columns[0].alias("doc_id"), *COUNTS, base_failed().alias("base_failed"), "log_perplexity", "low", "high", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", width: float = WIDTH, lower: float = LOWER, least: float = LEAST_HALF_BAND) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; each text is counted once and scored once."""
    rows, columns = _scores(docs, text_col, lang_col, docs.columns)
    return _judged(rows, bands(rows).collect(), width, lower, least).filter("kept").select(*columns)
