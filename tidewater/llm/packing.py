"""Packing of token sequences by non-negative least squares over the length histogram.

Documents are cut into pieces of at most the window.  Lengths are rounded up to units and
counted.  All combinations of up to three lengths that fill a window exactly are columns of
a least-squares problem whose unknowns, the repeat counts, may not be negative; the counts
are rounded down, and what is left of the histogram is packed greedily, largest first, as
patterns with repeat counts.  The histogram and the patterns are bounded by the number of
units; only they reach the driver.  Pieces find their places by their rank among the pieces
of their length, and ranks come from counts by (length, salt), so one very common length is
dealt over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, text_of
from tidewater.llm.words import coder, slices

WINDOW = 4096
UNIT = 16
#: Parts that a length's pieces are dealt over to be ranked.
SALTS = 512
DEPTH = 3


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ascending tuples of at most ``depth`` positive lengths whose sum is ``units``."""

    def parts(left: int, least: int, k: int) -> Iterator[tuple[int, ...]]:
        if left >= least:
            yield (left,)
        if k > 1:
            for a in range(least, left // 2 + 1):
                yield from ((a, *rest) for rest in parts(left - a, a, k - 1))

    return list(parts(units, 1, depth))


def solve_nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1.0, np.abs(b).max(initial=0.0)) * max(1.0, a.max(initial=0.0))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= least:
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            own = a[:, cols]
            z = np.linalg.lstsq(own.T @ own, own.T @ b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            step = (x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300)).min()
            x[cols] += step * (z - x[cols])
            gone = cols[(x[cols] <= 1e-12) | ((z <= 0) & (x[cols] <= 1e-9))]
            if not len(gone):
                gone = cols[low][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """Patterns (length in units: how many) with their repeat counts; together they hold the histogram exactly."""
    left = np.zeros(units + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    patterns: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], repeats: int) -> None:
        if repeats > 0:
            patterns.append((pattern, repeats))
            for length, n in pattern.items():
                left[length] -= n * repeats

    present = {k for k, n in histogram.items() if n}
    combos = [c for c in combinations(units, depth) if present.issuperset(c)]
    if combos:
        a = np.zeros((units + 1, len(combos)))
        for j, combo in enumerate(combos):
            for length in combo:
                a[length, j] += 1
        x = solve_nnls(a, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1 - 1e-6:
                break
            lengths, n = np.unique(combos[j], return_counts=True)
            pattern = dict(zip(lengths.tolist(), n.tolist()))
            take(pattern, min([int(x[j] + 1e-6), *(int(left[k]) // c for k, c in pattern.items())]))
    while left.any():
        pattern, room = {}, units
        for length in np.flatnonzero(left)[::-1].tolist():
            if n := min(int(left[length]), room // length):
                pattern[length] = n
                room -= n * length
        take(pattern, min(int(left[k]) // n for k, n in pattern.items()))
    return patterns


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the ids of each text, cut every ``window`` ids."""

    def run(batches):
        code, tail = coder(tokenizer), np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch):
                ids, at = code.encode(part.column("text"))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at, at[1:]):
                    own = np.concatenate([ids[a:b], tail]).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        rows.append((doc, s, len(piece), zlib.crc32(piece), len(own)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assign(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, start and length (1 to ``window``)."""
    units = window // unit
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / unit).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    )
    counts = cut(pieces.groupBy("bin", "salt").agg(F.count("*").alias("n")))
    histogram = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most ``units`` rows
    patterns = plan(histogram, units)

    # For each length: from which rank on which pattern takes its pieces, how many a sequence.
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    filled, first = dict.fromkeys(histogram, 0), 0
    for pattern, repeats in patterns:
        for slot, (length, n) in enumerate(sorted(pattern.items(), reverse=True)):
            table.setdefault(length, []).append((filled[length], first, n, slot))
            filled[length] += n * repeats
        first += repeats
    lookup = {k: tuple(np.array(v, np.int64).T) for k, v in table.items()}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins, ranks = frame["bin"].to_numpy(), frame["rank"].to_numpy()
            sequence, slot = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for b in np.unique(bins):
                own = bins == b
                begins, firsts, each, slots = lookup[int(b)]
                k = np.searchsorted(begins, ranks[own], side="right") - 1
                inside = ranks[own] - begins[k]
                sequence[own] = firsts[k] + inside // each[k]
                slot[own] = slots[k] * window + inside % each[k]
            yield frame.drop(columns=["bin", "rank"]).assign(sequence_id=sequence, slot=slot)

    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(own) - 1).join(bases, ["bin", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at")).drop("base", "at", "salt")
    fields = [f for f in ranked.schema.fields if f.name not in ("bin", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, slot long"
    placed = ranked.mapInPandas(place, schema)
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0))).drop("slot")


def pack_documents(
    df: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and has the end id alone.  Rows that share an id are packed each.
    An empty table gives no rows.  Only the id and the text are read.
    """
    pieces = cut(token_pieces(df, tokenizer, end_id, window, id_col, text_col))
    return assign(pieces, window, unit)
