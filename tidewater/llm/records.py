"""Length-delimited binary records of token ids, with a separate offset index.

A shard is a run of records.  A record is

    uint64 payload length | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of the payload

with little-endian numbers; the crc is CRC-32 (zlib), masked by rotating it 15 bits to the
right and adding a constant, so that a crc stored inside data isn't mistaken for one of
the framing.  The payload is one flag byte (1: the id is null, 2: ids of 32 bits, else 16),
the id as int64, and the token ids.  Beside each shard lies its index: for each record the
id, the byte offset and the frame's bytes, as three int64; a reader may so take the records
in any order.  ``_manifest.json`` lists the shards of finished tasks in order, with their
records and tokens; files of lost or repeated tasks aren't in it and are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tidewater.llm.common import text_of
from tidewater.llm.words import coder, slices

MASK_DELTA = 0xA282EAD8
MANIFEST = "_manifest.json"
HEAD = struct.Struct("<QI")
ID = struct.Struct("<Bq")
FLUSH_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at ``at`` and where the next one begins; raises on a damaged one."""
    if at + HEAD.size > len(data):
        raise ValueError("record cut off in its header")
    size, crc = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError("damaged record length")
    body = data[at + HEAD.size : at + HEAD.size + size]
    end = at + HEAD.size + size + 4
    if end > len(data) or masked(bytes(body)) != struct.unpack_from("<I", data, end - 4)[0]:
        raise ValueError("damaged record payload")
    return body, end


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (doc_id is None) | (wide << 1)
    return ID.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = ID.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=ID.size)
    return None if flags & 1 else doc_id, ids


@dataclass
class ShardDone(WriterCommitMessage):
    order: int
    name: str
    records: int
    tokens: int
    size: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{uuid.uuid4().hex[:8]}"
        records = tokens = at = 0
        index: list[tuple[int, int, int]] = []
        waiting = bytearray()
        with where.open_output_stream(f"{base}/{name}.rec") as out:
            for batch in iterator:
                wide = batch.column("wide").to_pylist()
                for doc_id, raw, w in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), wide):
                    ids = np.frombuffer(raw.as_buffer(), "<u4")
                    framed = frame(pack(doc_id, ids, w))
                    index.append((doc_id or 0, at, len(framed)))
                    waiting += framed
                    at, records, tokens = at + len(framed), records + 1, tokens + len(ids)
                    if len(waiting) >= FLUSH_BYTES:
                        out.write(bytes(waiting))
                        waiting.clear()
            out.write(bytes(waiting))
        with where.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(np.array(index, "<i8").tobytes())
        return ShardDone(context.partitionId(), name, records, tokens, at)

    def commit(self, messages):
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(base, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        shards, start = [], 0
        for m in done:
            if m.records:
                shards.append({"name": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.size, "start": start})
                start += m.tokens
        with where.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps({"tokens": start, "shards": shards}).encode())

    def abort(self, messages):
        where, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                for end in ("rec", "idx"):
                    where.delete_file(f"{base}/{m.name}.{end}")


@dataclass
class Shard(InputPartition):
    name: str
    start: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Shard(s["name"], s["start"]) for s in read_manifest(self.path)["shards"]] or [Shard("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        where, base = fs.FileSystem.from_uri(self.path)
        start, held = partition.start, {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
        size, schema = 0, arrow_schema()
        with where.open_input_file(f"{base}/{partition.name}.rec") as file:
            for _, at, n in read_index(self.path, partition.name):
                file.seek(at)
                payload, end = unframe(memoryview(file.read(n)), 0)
                if end != n:
                    raise ValueError("the index doesn't fit the records")
                doc_id, ids = unpack(payload)
                for k, v in zip(held, (doc_id, start, len(ids), ids.astype("<u4").tobytes())):
                    held[k].append(v)
                start, size = start + len(ids), size + 4 * len(ids)
                if size >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_pydict(held, schema)
                    held, size = {k: [] for k in held}, 0
        if held["start"]:
            yield pa.RecordBatch.from_pydict(held, schema)


def arrow_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class TokenRecords(DataSource):
    """Format ``token_records``: write (doc_id, ids, wide), read (doc_id, start, n_tokens, ids)."""

    @classmethod
    def name(cls):
        return "token_records"

    def schema(self):
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema):
        return RecordReader(self.options["path"])

    def writer(self, schema, overwrite):
        return RecordWriter(self.options["path"])


def read_manifest(path: str) -> dict:
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_index(path: str, shard: str) -> np.ndarray:
    """Rows (id, byte offset, bytes) of a shard's records."""
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{base}/{shard}.idx") as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def read_record(path: str, shard: str, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_file(f"{base}/{shard}.rec") as f:
        f.seek(offset)
        return unpack(unframe(memoryview(f.read(size)), 0)[0])


def encoded(df: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as little-endian uint32, wide), in the order of the rows; null text is empty."""

    def run(batches):
        code = coder(tokenizer)
        wide = code.n_vocab > 1 << 16
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        for batch in batches:
            for part in slices(batch):
                ids, at = code.encode(part.column("text"))
                flat = memoryview(ids.astype("<u4").tobytes())
                raw = [bytes(flat[4 * a : 4 * b]) + tail for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary()), pa.array([wide] * len(raw))], ["doc_id", "ids", "wide"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, wide boolean")


def write_token_records(df: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write them in ascending order of the id (null first; equal ids by text).

    ``path`` must be a folder all executors share.  An empty table gives a manifest without shards.
    """
    df.sparkSession.dataSource.register(TokenRecords)
    ordered = df.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    encoded(ordered, tokenizer, end_id, id_col, text_col).write.format("token_records").mode("append").save(path)


def read_token_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all records before it), n_tokens, ids (little-endian uint32); checksums are verified."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(path)


def fresh_folder(base: str) -> str:
    return f"{base}/records-{uuid.uuid4().hex}"
