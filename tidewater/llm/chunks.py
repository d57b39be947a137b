"""Encoding by content-defined chunks.

A rolling hash over the bytes of a text marks where chunks end, so a passage that texts
share gives the same chunks in each of them.  A mark moves to the next white space, which
no token crosses; where a run without white space is too long for that, the chunk is cut at
the mark itself.  Each distinct chunk is encoded once and its ids are reused.  Where chunks
meet inside a word the ids on both sides are taken back to the word's ends and the word is
encoded again, so the result agrees with the whole text's.

Texts travel to tasks by a sketch (the least of their chunks' hashes), so copies and texts
with much in common meet in a task and share its chunks; a sketch that very many texts have
is split over tasks (rebalance).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of
from tidewater.llm.words import WordCoder, coder, slices

HASH_WINDOW = 32
#: A mark every so many bytes on average (a power of two).
MEAN_BYTES = 512
#: A chunk is cut inside a word if white space is further away than this.
REACH_BYTES = 2048
#: Ids that a worker keeps of chunks before it starts afresh.
MEMO_IDS = 8_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the HASH_WINDOW bytes that end there (polynomial, modulo 2**64)."""
    n, w = len(data), HASH_WINDOW
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_MULTIPLIER, n), dtype=np.uint64)
    inside = sums.copy()
    inside[w:] -= sums[:-w]
    mixed = inside * _powers(_INVERSE, n)
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin in texts on end (bytes ``data``, text k at offsets[k]), and which begin inside a word.

    The window may reach back over a text's first byte, so the first HASH_WINDOW bytes of a
    text have no marks; all others depend on the text alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    hits = np.flatnonzero(_window_hashes(data) < np.uint64((1 << 64) // MEAN_BYTES))
    owner = np.searchsorted(offsets, hits, side="right") - 1
    fits = hits - offsets[owner] >= HASH_WINDOW
    hits, ends = hits[fits] + 1, offsets[owner[fits] + 1]
    spaces = np.append(np.flatnonzero(_SPACES[data]), n)
    space = spaces[np.searchsorted(spaces, hits)]
    near = space - hits <= REACH_BYTES
    char = hits.copy()  # not inside a character
    for _ in range(3):
        inner = (char < n) & ((data[np.minimum(char, n - 1)] & 0xC0) == 0x80)
        char[inner] += 1
    begin = np.where(near, space, char)
    keep = begin < ends
    begin, forced = begin[keep], ~near[keep] & ~_SPACES[data[begin[keep]]] & ~_SPACES[data[begin[keep] - 1]]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    every = np.concatenate([firsts, begin])
    inside = np.concatenate([np.zeros(len(firsts), bool), forced])
    order = np.lexsort((inside, every))
    every, inside = every[order], inside[order]
    once = np.append(True, np.diff(every) > 0)
    return every[once], inside[once]


class ChunkCoder:
    """Encodes arrays of texts through a memo of chunks."""

    def __init__(self, words: WordCoder):
        self.words = words
        self.encoded = self.met = 0
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def _learn(self, chunks: list[bytes]) -> None:
        texts = pa.array([c.decode("utf-8") for c in chunks], pa.large_string())
        ids, at = self.words.encode(texts)
        for k, chunk in enumerate(chunks):
            self.memo[chunk] = len(self.parts)
            self.parts.append(ids[at[k] : at[k + 1]].astype(np.uint32, copy=True))
        self.held += len(ids)
        self.encoded += len(chunks)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        begins, inside = cuts(data, offsets)
        flat = data.tobytes()
        ends = np.append(begins[1:], len(flat))
        chunks = [flat[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        self.met += len(chunks)
        if self.held > MEMO_IDS:
            self._fresh()
        fresh = list(dict.fromkeys(c for c in chunks if c not in self.memo))
        if fresh:
            self._learn(fresh)
        ids = [self.parts[self.memo[c]] for c in chunks]
        self._repair(chunks, inside, ids)
        first = np.searchsorted(begins, offsets)
        empty = np.zeros(0, np.uint32)
        return [np.concatenate(ids[a:b]) if b > a else empty for a, b in zip(first, first[1:])]

    def _repair(self, chunks: list[bytes], inside: np.ndarray, ids: list[np.ndarray]) -> None:
        """Encode again the word around each join inside a word; the ids of its parts go."""
        k = 0
        for j in np.flatnonzero(inside).tolist():
            if j < k:
                continue
            k = j + 1
            while k < len(chunks) and inside[k] and not any(b in b" \t\n\r\x0b\x0c" for b in chunks[k - 1]):
                k += 1
            # chunks j - 1 to k - 1 hold the word: a tail, whole middles, a head
            tail = _tail(chunks[j - 1])
            head = _head(chunks[k - 1])
            middles = b"".join(chunks[j : k - 1])
            word = self.words.encode_one((tail + middles + head).decode("utf-8"))
            n_tail = len(self.words.encode_one(tail.decode("utf-8")))
            n_head = len(self.words.encode_one(head.decode("utf-8")))
            left = ids[j - 1]
            ids[j - 1] = np.concatenate([left[: len(left) - n_tail], word])
            for m in range(j, k - 1):
                ids[m] = ids[m][:0]
            ids[k - 1] = ids[k - 1][n_head:]


def _tail(chunk: bytes) -> bytes:
    at = max(chunk.rfind(bytes([b])) for b in b" \t\n\r\x0b\x0c")
    return chunk[at + 1 :]


def _head(chunk: bytes) -> bytes:
    at = [p for p in (chunk.find(bytes([b])) for b in b" \t\n\r\x0b\x0c") if p >= 0]
    return chunk[: min(at)] if at else chunk


def sketch(texts: pa.Array) -> np.ndarray:
    """For each text the least hash of its chunks; a text without a mark has the hash of its first bytes."""
    out = np.zeros(len(texts), np.int64)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return out
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begins, _ = cuts(data, offsets)
    # A chunk is told by the window that ends it; its hash takes no further pass over the bytes.
    hashes = _window_hashes(data)
    ends = np.append(begins[1:], len(data)) - 1
    owner = np.searchsorted(offsets, begins, side="right") - 1
    least = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    whole = ends - offsets[owner] >= HASH_WINDOW
    np.minimum.at(least, owner[whole], hashes[ends[whole]])
    return least.view(np.int64)


def by_sketch(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt so that texts with the same sketch share a task, hot sketches over several."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sketch(part.column("text")))], ["doc_id", "text", "route"])

    return df.mapInArrow(run, "doc_id long, text string, route long").hint("rebalance", "route").drop("route")


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded: each text's ids by chunks, and the text decoded from them.

    Null text is empty.  Rows that share an id are encoded each.  An empty table gives no rows.
    """

    def rows(doc_ids, coded, words):
        ids = pa.array([i.astype(np.int32) for i in coded], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([doc_ids, ids, pa.array([words.decode(i) for i in coded], pa.string())], ["doc_id", "ids", "decoded"])

    return _over_chunks(df, tokenizer, id_col, text_col, rows, "doc_id long, ids array<int>, decoded string")


def encode_decode_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_decode gives, without moving the ids."""

    def rows(doc_ids, coded, words):
        sha = lambda data: hashlib.sha256(data).hexdigest()
        columns = [
            pa.array([len(i) for i in coded], pa.int64()),
            pa.array([sha(i.astype("<u4")) for i in coded], pa.string()),
            pa.array([sha(words.decode(i).encode("utf-8")) for i in coded], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over_chunks(df, tokenizer, id_col, text_col, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _over_chunks(df, tokenizer, id_col, text_col, rows, schema) -> DataFrame:
    def run(batches):
        words = coder(tokenizer)
        chunks = ChunkCoder(words)
        for batch in batches:
            for part in slices(batch):
                yield rows(part.column("doc_id"), chunks.encode(part.column("text")), words)

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return by_sketch(texts).mapInArrow(run, schema)
