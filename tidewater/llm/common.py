"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot above this share of all rows, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1000
#: Below this many rows a key is never hot: salting would cost more than it spares.
HOT_LEAST = 50

#: What the stages of the running pipeline wrote for themselves.
_made: list[str] = []
_registering = False


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _registering:
        _made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write the rows to the shared folder once and go on from the copy."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_output(df: DataFrame) -> DataFrame:
    """``written``, for what a pipeline stage hands on; ``stage_of`` deletes it when no later stage reads it."""
    global _registering
    _registering = True
    try:
        return written(df, "stage")
    finally:
        _registering = False


def cut(df: DataFrame) -> DataFrame:
    """``written``, to end a plan there: a lost executor costs no recompute, and what is read later are only the columns asked for."""
    return written(df, "cut")


@contextmanager
def stage_of(docs: DataFrame, first: bool = False) -> Iterator[None]:
    """Around the making of one pipeline stage from ``docs``: deletes what earlier stages of the run wrote for themselves.

    Whatever ``docs`` still reads stays, and so does anything written outside of stages.  The
    ``first`` stage of a run deletes nothing: what an earlier run wrote may still be read.
    Runs follow each other; two that take turns in one session would delete each other's.
    """
    global _registering
    spark = docs.sparkSession
    old, _made[:] = ([] if first else _made[:]), []
    if old:
        sc, read = spark.sparkContext, docs.inputFiles()
        for path in old:
            if any(path.split("://")[-1] in f for f in read):
                _made.append(path)
                continue
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        gc.collect()
        sc._jvm.System.gc()  # Spark deletes shuffles that nothing refers to any more
    _registering = True
    try:
        yield
    finally:
        _registering = False


_resident: dict[str, Any] = {}


def resident(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks: one thing at a time, so that memory of one operator isn't held under the next."""
    if name not in _resident:
        _resident.clear()
        _resident[name] = make()
    return _resident[name]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def hot_hashes(hashed: DataFrame, column: str = "h") -> list[int]:
    """The hashes that hold more than 1 / HOT_PARTS of the rows: at most HOT_PARTS numbers."""
    counts = cut(hashed.groupBy(column).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_PARTS)
    return [r[0] for r in counts.filter(F.col("n") > least).select(column).collect()]


def least_id_by_key(df: DataFrame, keys: Sequence[str], uid: str, out: str, hot: list[int]) -> DataFrame:
    """Add ``out``: the smallest ``uid`` among rows whose ``keys`` are equal (null equals null).

    Rows of a hot key (``hot``: xxhash64 of the keys) are dealt over salts first, each
    salt finds its smallest id, and only the salts' representatives meet again; so no
    task sees a whole hot group.  The keys are dropped.
    """
    from pyspark.sql import Window

    if not hot:
        part = Window.partitionBy(*keys)
        return df.withColumn(out, F.min(uid).over(part)).drop(*keys)
    salts = 4 * shuffle_parts(df.sparkSession)
    is_hot = F.xxhash64(*keys).isin(hot)
    df = df.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(uid), F.lit(salts))).otherwise(F.lit(-1)))
    part = Window.partitionBy(*keys, "_salt")
    df = df.withColumn("_own", F.min(uid).over(part))
    stands = (F.col("_salt") >= 0) & (F.col("_own") == F.col(uid))
    df = cut(df.withColumn("_key", F.when(stands, F.struct(*keys))).drop(*keys))
    reps = df.filter(F.col("_key").isNotNull()).select("_key", F.col("_own").alias("_rep"))
    least = reps.groupBy("_key").agg(F.min("_rep").alias("_least"))
    # At most HOT_PARTS keys x salts rows of two longs.
    names = reps.join(least, "_key").select("_rep", "_least")
    return (
        df.join(F.broadcast(names), F.col("_own") == F.col("_rep"), "left")
        .withColumn(out, F.coalesce("_least", "_own"))
        .drop("_salt", "_own", "_key", "_rep", "_least")
    )
