"""Token counts of a byte-level tokenizer, by pieces between boundaries that no token crosses.

The tokenizer's own pattern splits a text before its merges, and no match of that pattern
holds a non-space character followed by white space.  So a place where a letter, digit, mark
or sign stands before white space is a boundary of every encoding of every text around it:
what stands before it doesn't change what follows, and the other way round.  The same holds
between a letter and a following full stop, comma and the like.  These places are called
stable here.

Short texts are split at stable places and each distinct piece is encoded once a worker.
Texts of over ``chunk_bytes`` are cut into chunks that overlap, and the chunks, not the texts,
are dealt over tasks.  Each chunk is encoded with offsets; neighbours are spliced at the first
stable place in their overlap that is a token boundary in both.  Where an overlap has none it
is widened, at last to the whole next chunk; where that has none either, the chunks are
encoded as one.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, resident, text_of
from tidewater.llm.words import slices

#: Texts of more bytes are cut into chunks of this size.
CHUNK_BYTES = 32_768
#: Bytes that a chunk shares with the next, before it is widened.
OVERLAP_BYTES = 1024
#: An overlap that had no common boundary becomes so many times as wide.
WIDEN = 8
#: Common boundaries that a chunk offers for each of its overlaps; one is enough.
OFFERS = 32
#: Pieces that a worker remembers before it starts afresh, and the longest of them in characters.
MEMO_PIECES = 400_000
MEMO_CHARS = 64

_BEFORE_SPACE = r"([\p{L}\p{N}\p{P}\p{S}])([ \n])"
_MARK = "\x00"
#: A stable place lies after the first character of a match.
_STABLE = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}](?=[ \t\n\r])|[A-Za-zÀ-ÖØ-öø-ÿぁ-ゖァ-ヺ一-龥가-힣](?=[.,;:!?。，、；：！？])")


class PieceCounter:
    """Counts tokens of arrays of texts, with a bounded memo of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[str, int] = {}

    @functools.cached_property
    def token_bytes(self) -> np.ndarray:
        """Bytes that each token stands for: one for each character of its name."""
        n = self.library.get_vocab_size(with_added_tokens=True)
        return np.array([len(self.library.id_to_token(i) or "") for i in range(n)], np.int64)

    def _single(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[int]:
        """Counts of pieces; those between two stable places go through the library on end, many at once."""
        out = np.zeros(len(pieces), np.int64)
        joined = [k for k, p in enumerate(pieces) if p[:1] in (" ", "\n") and (p[-1].isalnum() or p[-1] in ".,;:!?)\"'-")]
        parts = [joined[at : at + 500] for at in range(0, len(joined), 500)]
        alone = set(range(len(pieces))).difference(joined)
        for part, coded in zip(parts, self.library.encode_batch_fast(["".join(pieces[k] for k in part) for part in parts], add_special_tokens=False)):
            ends = np.cumsum([len(pieces[k].encode()) for k in part])
            tokens = np.cumsum(self.token_bytes[coded.ids])
            at = np.searchsorted(tokens, ends, side="right")
            if (tokens[at - 1] == ends).all():
                out[part] = np.diff(at, prepend=0)
            else:
                alone.update(part)
        rest = sorted(alone)
        out[rest] = self._single([pieces[k] for k in rest])
        return out.tolist()

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out = np.zeros(len(texts), np.int64)
        marked = pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)
        if marked.any():
            out[marked] = self._single(texts.filter(pa.array(marked)).to_pylist())
            texts = texts.filter(pa.array(~marked))
        if not len(texts):
            return out
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _BEFORE_SPACE, "\\1" + _MARK + "\\2"), _MARK)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        sizes = np.array([self.memo.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(sizes < 0).tolist()
        if new:
            learnt = self._learn([pieces[k] for k in new])
            sizes[new] = learnt
            self.memo.update((pieces[k], n) for k, n in zip(new, learnt) if len(pieces[k]) <= MEMO_CHARS)
        sums = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
        out[~marked] = np.diff(sums[bounds - bounds[0]])
        return out

    def boundaries(self, text: str, zones: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
        """Tokens of a chunk, and for each zone (from, to: bytes) the first stable token boundaries in it with the tokens before them."""
        ends = np.cumsum(self.token_bytes[self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids])
        raw, found = text.encode("utf-8"), []
        for a, b in zones:
            b = min(b, len(raw))
            if a >= b:
                found.append([])
                continue
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            # The character before the zone tells whether its first place is stable.
            first = a
            while first and raw[first - 1] & 0xC0 == 0x80:
                first -= 1
            first = max(0, first - 1)
            part = raw[first:b].decode("utf-8", "ignore")
            here: list[tuple[int, int]] = []
            done, place = 0, first
            for m in _STABLE.finditer(part):
                place += len(part[done : m.end()].encode("utf-8"))
                done = m.end()
                k = int(np.searchsorted(ends, place))
                if place >= a and place and k < len(ends) and ends[k] == place:
                    here.append((place, k + 1))
                    if len(here) == OFFERS:
                        break
            found.append(here)
        return len(ends), found


def counter(path: str) -> PieceCounter:
    """One counter per worker process and file."""
    return resident(f"counts {path}", lambda: PieceCounter(path))


def _chunk_rows(text: str, size: int, overlap: int):
    """Start and stop (in bytes) and text of chunks of about ``size`` bytes that end between characters, and the ``overlap`` bytes after them."""

    def whole(at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(raw))

    raw, at = text.encode("utf-8"), 0
    while at < len(raw):
        end = whole(at + size)
        yield at, end, raw[at:end].decode("utf-8"), raw[end : whole(end + overlap)].decode("utf-8")
        at = end


def _chunks(long_texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks as rows, each with the beginning of the next one, so that encoding them needs no further shuffle of text."""

    def run(batches):
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
                rows = []
                for k, chunk in enumerate(_chunk_rows(text, size, overlap)):
                    rows.append((rid, doc_id, k, *chunk))
                    if len(rows) == 64:
                        yield _batch(rows, _CHUNK)
                        rows = []
                if rows:
                    yield _batch(rows, _CHUNK)

    return cut(long_texts.mapInArrow(run, "rid long, doc_id long, k long, start long, stop long, piece string, beyond string"))


_CHUNK = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("piece", pa.string()), ("beyond", pa.string())])
_PLACES = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))
_CODED = pa.schema([("rid", pa.int64()), ("k", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("head", _PLACES), ("tail", _PLACES)])
_CODED_SQL = "rid long, k long, last long, n long, head array<struct<place: long, before: long>>, tail array<struct<place: long, before: long>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _encoded(segments: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (rid, k, last, start, stop, text, reach): a segment's own bytes, and ``text`` which goes on into the next one.

    ``head`` and ``tail`` offer places (bytes of the whole text) in the first ``reach`` bytes of
    the segment and in what it shares with the next, with the segment's tokens before them.
    """

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("rid", "k", "last", "start", "stop", "text", "reach")]
            for rid, k, last, start, stop, text, reach in zip(*cols):
                own = stop - start
                n, (head, tail) = count.boundaries(text, [(1, reach), (own + 1, own + reach)])
                yield _batch([(rid, k, last, n, [{"place": start + p, "before": b} for p, b in head], [{"place": start + p, "before": b} for p, b in tail])], _CODED)

    return segments.select("rid", "k", "last", "start", "stop", "text", "reach").mapInArrow(run, _CODED_SQL)


def _joined(coded: DataFrame) -> DataFrame:
    """Add to each segment ``meet``: where it is spliced with the one after it (null: nowhere), and whether there is one."""
    after = Window.partitionBy("rid").orderBy("k")
    places = lambda c: F.transform(c, lambda x: x["place"])
    next_head = F.lead(places(F.col("head"))).over(after)
    return coded.withColumn("_next", next_head).withColumn("more", F.col("_next").isNotNull()).withColumn("meet", F.array_min(F.array_intersect(places(F.col("tail")), "_next"))).drop("_next")


def _segments(chunks: DataFrame, beyond: str | Column, reach: int) -> DataFrame:
    """Each chunk as a segment whose text goes on into the next."""
    beyond = F.col(beyond) if isinstance(beyond, str) else beyond
    return chunks.select("rid", "k", F.col("k").alias("last"), "start", "stop", F.concat("piece", beyond).alias("text"), F.lit(reach).cast("long").alias("reach"))


def _long_counts(long_texts: DataFrame, tokenizer: str, chunk_bytes: int, overlap: int) -> DataFrame:
    chunks = _chunks(long_texts, chunk_bytes, overlap)
    # Codes are small; from here on text is read only for the chunks whose join failed.
    joins = cut(_joined(cut(_encoded(_segments(chunks, "beyond", overlap), tokenizer))))
    after = Window.partitionBy("rid").orderBy("k")
    reach = overlap
    while reach < chunk_bytes:
        failed = cut(joins.filter("more AND meet IS NULL").select("rid", "k"))
        if failed.isEmpty():
            break
        # Both sides of a failed join are encoded again with a wider overlap; all other segments stay.
        reach = min(reach * WIDEN, chunk_bytes)
        sides = cut(failed.union(failed.select("rid", F.col("k") + 1)).distinct())
        need = cut(sides.union(sides.select("rid", F.col("k") + 1)).distinct())
        near = chunks.join(need, ["rid", "k"], "left_semi").withColumn("_on", F.coalesce(F.lead(F.substring("piece", 1, reach)).over(after), F.lit("")))
        again = cut(_encoded(_segments(near.join(sides, ["rid", "k"], "left_semi"), "_on", reach), tokenizer))
        joins = cut(_joined(joins.drop("meet", "more").join(sides, ["rid", "k"], "left_anti").unionByName(again)))
    while not joins.filter("more AND meet IS NULL").isEmpty():
        joins = cut(_joined(_merged(joins, chunks, tokenizer, reach)))
    before = Window.partitionBy("rid").orderBy("k")
    tokens_at = lambda c, place: F.get(F.filter(c, lambda x: x["place"] == place), 0)["before"]
    joins = joins.withColumn("_from", F.lag("meet").over(before))
    own = F.coalesce(tokens_at(F.col("tail"), F.col("meet")), F.col("n")) - F.coalesce(tokens_at(F.col("head"), F.col("_from")), F.lit(0))
    sums = joins.groupBy("rid").agg(F.sum(own).alias("n_tokens"))
    about = chunks.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("stop").alias("n_bytes"))
    return about.join(sums, "rid").select("doc_id", "n_bytes", "n_tokens")


def _merged(joins: DataFrame, chunks: DataFrame, tokenizer: str, reach: int) -> DataFrame:
    """Segments whose join found no boundary at all become one with the next, and are encoded as one."""
    before = Window.partitionBy("rid").orderBy("k")
    starts = F.lag(~F.col("more") | F.col("meet").isNotNull(), 1, True).over(before)
    runs = joins.withColumn("run", F.sum(starts.cast("int")).over(before)).withColumn("_n", F.count("*").over(Window.partitionBy("rid", "run")))
    stay = runs.filter("_n = 1").drop("run", "_n", "meet", "more")
    go = cut(runs.filter("_n > 1").select("rid", F.explode(F.sequence("k", "last")).alias("k"), "run"))
    need = cut(go.select("rid", "k").union(go.select("rid", F.col("k") + 1)).distinct())
    after = Window.partitionBy("rid").orderBy("k")
    near = chunks.join(need, ["rid", "k"], "left_semi").withColumn("_on", F.coalesce(F.lead(F.substring("piece", 1, reach)).over(after), F.lit("")))
    rows = near.join(go, ["rid", "k"]).groupBy("rid", "run").agg(
        F.min("k").alias("k"), F.max("k").alias("last"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("_pieces"), F.max_by("_on", "k").alias("_tail"),
    )
    text = F.concat(F.array_join(F.transform("_pieces", lambda x: x["piece"]), ""), "_tail")
    segments = rows.select("rid", "k", "last", "start", "stop", text.alias("text"), F.lit(reach).cast("long").alias("reach"))
    return stay.unionByName(cut(_encoded(segments, tokenizer)))


def token_counts(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row, as the tokenizers library counts its whole text.

    Null text is empty and has no token; special strings inside a text count as the library's
    default has them.  Rows that share an id or a text are counted each.  An empty table gives
    no rows; other columns don't matter.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    size = F.octet_length("text")

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(count.counts(part.column("text")))], ["doc_id", "n_bytes", "n_tokens"])

    short = texts.filter(size <= chunk_bytes).withColumn("n_bytes", size.cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    long_texts = texts.withColumn("rid", F.monotonically_increasing_id()).filter(size > chunk_bytes)
    counts = short.unionByName(_long_counts(long_texts, tokenizer, chunk_bytes, overlap))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
