"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone.  An n-gram
of letters is bound by permuting (rotating) the vectors by their place and multiplying
them; a document's vector is the sum (bundle) of its n-grams' vectors.  A language's
prototype is the bundle of its learning documents, each scaled to length one.  The mean of
all prototypes, which says nothing about a language, is taken off, and a document goes to
the prototype with the largest cosine.

The filter's threshold is learned too.  A text of n n-grams has about sqrt(n / (n + CHANCE_GRAMS))
of the cosine that a long text of its language has, so the cosine over that root, a text's fit,
can be compared between short and long texts.  A text goes if its fit is below FIT_SHARE of the
FIT_QUANTILE of the learning documents of the language it was put in.

Prototypes are sums of fixed-size vectors: tasks add their own, Spark adds those of all
tasks, and one row for each language reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewater.llm.common import resident, text_of, written
from tidewater.llm.words import slices

DIMENSIONS = 1024
NGRAM = 3
#: n-grams whose vectors a worker remembers before it starts afresh (DIMENSIONS bytes each).
MEMO_GRAMS = 20_000
#: n-grams that are summed at a time, so that their vectors stay in the processor's cache.
CHUNK_GRAMS = 256
BLOCK_GRAMS = 2048
#: A table of counts is worth its zeros if at least one in so many entries isn't one.
DENSE = 16
#: Texts that are profiled at a time.
TEXTS = 512
SEED = 20240817
UNKNOWN = "und"
#: n-grams at which chance takes the cosine of a text down to the root of a half.
CHANCE_GRAMS = 300
#: The filter drops texts below this share of that quantile of the learning documents' fits.
FIT_SHARE, FIT_QUANTILE = 0.5, 0.05

_CODE_BITS = 21


def letter_vector(point: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=[SEED, point]))
    return (rng.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


class Profiler:
    """Vectors of texts, with a bounded memo of n-gram vectors."""

    def __init__(self):
        self._fresh()

    def _fresh(self) -> None:
        self.points = np.zeros(0, np.int64)  # letters, sorted, and their vectors rotated for each place
        self.letters = np.zeros((NGRAM, 0, DIMENSIONS), np.int8)
        self.keys = np.zeros(0, np.int64)  # n-grams, sorted, and where their vectors are
        self.places = np.zeros(0, np.int64)
        self.vectors = np.zeros((1024, DIMENSIONS), np.int8)

    def _learn(self, keys: np.ndarray) -> None:
        """Keep the vectors of new, distinct n-grams."""
        parts = [(keys >> (_CODE_BITS * (NGRAM - 1 - k))) & ((1 << _CODE_BITS) - 1) for k in range(NGRAM)]
        fresh = np.setdiff1d(np.concatenate(parts), self.points)
        if len(fresh):
            own = np.array([letter_vector(p) for p in fresh.tolist()])
            rotated = np.stack([np.roll(own, NGRAM - 1 - k, axis=1) for k in range(NGRAM)])
            self.points = np.concatenate([self.points, fresh])
            order = np.argsort(self.points)
            self.points, self.letters = self.points[order], np.concatenate([self.letters, rotated], axis=1)[:, order]
        first, n = len(self.keys), len(keys)
        while first + n > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        own = self.vectors[first : first + n]
        own[:] = 1
        for k in range(NGRAM):
            own *= self.letters[k][np.searchsorted(self.points, parts[k])]
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every)
        self.keys, self.places = every[order], np.concatenate([self.places, np.arange(first, first + n)])[order]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return known

    def _prepare(self, keys: np.ndarray) -> None:
        """See that the vectors of distinct n-grams, at most MEMO_GRAMS, are there."""
        new = keys[~self._known(keys)]
        if len(self.keys) + len(new) > MEMO_GRAMS:
            self._fresh()
            new = keys
        if len(new):
            self._learn(new)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of the lower-cased letters, words apart by one blank, and their counts."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        points = _letters(points)
        blank = points == 32
        points = points[~(blank & np.append(False, blank[:-1]))]
        if len(points) < NGRAM or not (points != 32).any():
            points = np.concatenate([[32], points, [32] * (NGRAM - 1)]) if (points != 32).any() else points[:0]
        key = np.zeros(max(0, len(points) - NGRAM + 1), np.int64)
        for k in range(NGRAM):
            key = key << _CODE_BITS | points[k : k + len(key)]
        return np.unique(key, return_counts=True)

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, the sum of its n-grams' vectors, and how many n-grams it has; new n-grams are learned together."""
        out, sizes = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), np.int64)
        found = [self.grams(t) for t in texts]
        every = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.int64)
        together = len(every) <= MEMO_GRAMS
        if together:
            self._prepare(every)
        sizes[:] = [counts.sum() for _, counts in found]
        n_keys = np.array([len(k) for k, _ in found])
        if together and DENSE * n_keys.sum() >= len(texts) * len(every):
            # Texts with many n-grams in common: a table of their counts times the vectors, some n-grams at a time.
            columns = np.searchsorted(every, np.concatenate([k for k, _ in found]))
            order = np.argsort(columns, kind="stable")
            columns, rows = columns[order], np.repeat(np.arange(len(texts)), n_keys)[order]
            counts = np.concatenate([c for _, c in found])[order]
            at = self.places[np.searchsorted(self.keys, every)]
            for a in range(0, len(every), BLOCK_GRAMS):
                lo, hi = np.searchsorted(columns, [a, a + BLOCK_GRAMS])
                table = np.zeros((len(texts), min(BLOCK_GRAMS, len(every) - a)), np.float32)
                table[rows[lo:hi], columns[lo:hi] - a] = counts[lo:hi]
                out += table @ self.vectors[at[a : a + BLOCK_GRAMS]].astype(np.float32)
            return out, sizes
        for row, (keys, counts) in enumerate(found):
            weights = counts.astype(np.float32)
            for a in range(0, len(keys), CHUNK_GRAMS):
                some = keys[a : a + CHUNK_GRAMS]
                if not together:
                    self._prepare(some)
                at = self.places[np.searchsorted(self.keys, some)]
                out[row] += weights[a : a + CHUNK_GRAMS] @ self.vectors[at].astype(np.float32)
        return out, sizes


def _groups(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most TEXTS rows at a time."""
    for a in range(0, part.num_rows, TEXTS):
        yield part.slice(a, TEXTS)


def _letters(points: np.ndarray) -> np.ndarray:
    """The code points with everything but letters as a blank."""
    out = _KIND[np.minimum(points, len(_KIND) - 1)]
    high = points >= len(_KIND)
    if high.any():
        out = out.copy()
        out[high] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
    return np.where(out == -1, points, 32) if not high.any() else np.where(out == -1, points, out)


_KIND = np.array([-1 if chr(p).isalpha() else 32 for p in range(0x3000)], np.int64)


def _profiler() -> Profiler:
    return resident("profiler", Profiler)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A vector for each language from rows (text, lang) without nulls in lang."""
    schema = "lang string, bundle array<double>"

    def run(batches):
        own, sums = _profiler(), {}
        for part in (g for batch in batches for p in slices(batch) for g in _groups(p)):
            vectors, _ = own.bundles(part.column("text").to_pylist())
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors /= np.maximum(length, 1e-12)
            langs = np.array(part.column("lang").to_pylist())
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0.0) + vectors[langs == lang].sum(axis=0, dtype=float)
        sums = {k: v for k, v in sums.items() if v.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = docs.mapInArrow(run, schema).select("lang", F.posexplode("bundle").alias("at", "value"))
    # Decimal sums, so that the order of tasks doesn't show in the last bits.
    whole = parts.groupBy("lang", "at").agg(F.sum(F.col("value").cast("decimal(28,9)")).cast("double").alias("value"))
    rows = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("bundle")).collect()
    return {r.lang: np.array([x.value for x in r.bundle]) for r in rows}


def learnable(id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def predicted(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred, score and fit of its column ``text``."""
    langs = sorted(learned)
    profile = np.array([learned[k] / max(np.linalg.norm(learned[k]), 1e-12) for k in langs]).reshape(len(langs), DIMENSIONS)
    middle = profile.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    centred = profile - middle
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("fit", DoubleType())])

    def run(batches):
        own = _profiler()
        for part in (g for batch in batches for p in slices(batch) for g in _groups(p)):
            vectors, sizes = own.bundles([t or "" for t in part.column("text").to_pylist()])
            vectors = vectors.astype(float)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            vectors -= middle
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            judged = (sizes > 0) & bool(langs)
            cosine = vectors @ centred.T if langs else np.zeros((len(sizes), 1))
            best = cosine.argmax(axis=1)
            top = np.where(judged, cosine.max(axis=1), 0.0)
            names = [langs[k] if j else UNKNOWN for k, j in zip(best.tolist(), judged.tolist())]
            score = np.where(judged, np.clip((1 + top) / 2, 0, 1), 0.0)
            fit = top * np.sqrt(1 + CHANCE_GRAMS / np.maximum(sizes, 1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(fit)], schema.names)

    return docs.mapInArrow(run, schema)


def _learning(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.filter(learnable(id_col) & F.col(lang_col).isNotNull())
    return rows.select(text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1, half of 1 + cosine).

    ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned.  Equal cosines go to the language first in the alphabet.  A null id is hashed
    as empty.  Rows that share an id are judged each; an empty table gives no rows.
    """
    learned = prototypes(_learning(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (~learnable(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predicted(rows, learned).drop("text", "fit")


def least_fits(judged: DataFrame, share: float = FIT_SHARE) -> dict[str, float]:
    """The least fit by language, from all learning documents (lang, lang_pred, fit) that are put in their own language."""
    own = judged.filter(F.col("lang_pred") == F.col("lang"))
    rows = own.groupBy("lang").agg(F.percentile_approx("fit", FIT_QUANTILE, 10000).alias("fit")).collect()  # a row for each language
    return {r.lang: share * r.fit for r in rows}


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", share: float = FIT_SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that fit a learned language at least as ``least_fits`` says.

    A language none of whose learning texts was recognised has no limit.  Where nothing can
    be learned (no row names a language), only texts without a letter go.
    """
    learned = prototypes(_learning(docs, id_col, text_col, lang_col))
    if not learned:
        return docs.filter(text_of(text_col).rlike(r"\p{L}"))
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no name of ours clashes
    name = dict(zip(docs.columns, own.columns))
    is_text = docs.schema[text_col].dataType == StringType()
    others = [c for c in own.columns if c != name[text_col] or not is_text]
    language = F.when(learnable(name[id_col]), F.col(name[lang_col]).cast("string"))
    # Written once, so that each text is judged once for both the limits and the verdict.
    rows = written(predicted(own.select(*others, F.col(name[text_col]).cast("string").alias("text"), language.alias("lang")), learned), "languages")
    least = F.lit(None).cast("double")
    for lang, fit in least_fits(rows, share).items():
        least = F.when(F.col("lang_pred") == lang, fit).otherwise(least)
    kept = rows.filter((F.col("lang_pred") != UNKNOWN) & F.coalesce(F.col("fit") >= least, F.lit(True)))
    return kept.select(*(F.col(name[c] if name[c] in others else "text").alias(c) for c in docs.columns))
