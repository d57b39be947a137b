"""Tokenizer ids of whole texts, word by word.

The word-level tokenizer drops white space and never builds a token across it, so a
text's ids are its words' ids in order.  Each distinct word goes through the tokenizers
library once per worker; texts are then put together with array operations.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tidewater.llm.common import resident

#: When a worker remembers more words than this it starts afresh; bounds its memory.
MEMO_WORDS = 300_000
#: Words of more characters are encoded whole, by themselves.
MEMO_WORD_CHARS = 64

#: The tokenizer's own pattern for pieces of a word (fixed value, from its file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters lower-case one to one and are composed already.
PLAIN = regex.compile(r"[!-~¡-¬®-įı-ňŊ-ž]+")
SPECIAL = "<|"


class WordCoder:
    """Ids for arrays of texts, with a bounded memo of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False),
            ]
        )
        n = self.pieces.get_vocab_size(with_added_tokens=True)
        names = [self.pieces.id_to_token(i) or "" for i in range(n)]
        self.n_vocab = n
        self.token_text = np.array(names, dtype=object)
        self.ends_piece = np.array([t.endswith("</w>") for t in names])
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[str, int] = {}  # pieces of words
        self.known = pa.array([], pa.large_string())  # words, and where their ids are
        self.known_place = np.zeros(0, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.entries = self.used = 0

    @functools.cached_property
    def whole(self):
        """The tokenizer as it is, for words that aren't plain; most workers never load it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def encode_one(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keep runs of ids; returns the place of the first."""
        n = len(lengths)
        while self.entries + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        first, self.entries = self.entries, self.entries + n
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        return first

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Many pieces in one library call; each ends with the one token that has the end mark."""
        parts = [pieces[at : at + 500] for at in range(0, len(pieces), 500)]
        for some, coded in zip(parts, self.pieces.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) == len(some):
                first = self._store(ids, np.diff(ends, prepend=0))
                self.memo.update(zip(some, range(first, first + len(some))))
            else:
                for x in some:
                    own = self.encode_one(x)
                    self.memo[x] = self._store(own, np.array([len(own)]))

    def _learn(self, words: list[str]) -> np.ndarray:
        """The places of words that aren't known yet."""
        memo, place = self.memo, np.zeros(len(words), np.int64)
        single: list[tuple[int, str]] = []
        several: list[tuple[int, list[str]]] = []
        fresh: set[str] = set()
        for k, w in enumerate(words):
            if len(w) > MEMO_WORD_CHARS or not ((w.isascii() and w.isprintable()) or PLAIN.fullmatch(w)) or SPECIAL in w:
                own = self.encode_one(w)
                place[k] = self._store(own, np.array([len(own)]))
                continue
            low = w.lower()
            if low.isalpha():
                single.append((k, low))
                fresh.add(low)
                continue
            head, last = low[:-1], low[-1:]
            parts = [head, last] if last in ".,;:!?" and head.isalpha() else PIECES.findall(low)
            several.append((k, parts))
            fresh.update(parts)
        self._learn_pieces([x for x in fresh if x not in memo])
        place[[k for k, _ in single]] = [memo[low] for _, low in single]
        if several:
            at = np.array([memo[x] for _, parts in several for x in parts], np.int64)
            n = self.lengths[at]
            ends = np.cumsum(n)
            ids = self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            sums = np.append(0, ends)[np.append(0, np.cumsum([len(parts) for _, parts in several]))]
            first = self._store(ids, np.diff(sums))
            place[[k for k, _ in several]] = np.arange(first, first + len(several))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, offsets: text k has ids[offsets[k]:offsets[k + 1]]); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode() if len(texts) else None
        if coded is None or not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) > MEMO_WORDS:
            self._fresh()
        words = coded.dictionary
        found = pc.index_in(words, self.known)
        place = np.zeros(len(words), np.int64)
        is_new = found.is_null().to_numpy(zero_copy_only=False)
        place[~is_new] = self.known_place[found.drop_null().to_numpy()]
        if is_new.any():
            new = words.filter(pa.array(is_new))
            place[is_new] = self._learn(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.known_place = np.concatenate([self.known_place, place[is_new]])
        starts, lengths, flat = self.starts[place], self.lengths[place], self.flat
        index = coded.indices.to_numpy()
        n = lengths[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[bounds - bounds[0]]

    def decode(self, ids: np.ndarray) -> str:
        """As the library does with this file, which names no decoder: the tokens with a space between."""
        return " ".join(self.token_text[ids].tolist())


def coder(path: str) -> WordCoder:
    """One coder per worker process and file."""
    return resident(path, lambda: WordCoder(path))


#: Bytes of text that are worked on at a time.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch of about ``most`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
