"""Day files behind a cache: only days that aren't there yet are fetched, one task each."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib import error, request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Day(InputPartition):
    day: str


def day_rows(body: bytes) -> list[list[str]]:
    """The tab-separated rows of a day's archive (its first member) or plain file; blank rows go."""
    if body[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            body = z.read(z.namelist()[0])
    return [r for r in csv.reader(io.StringIO(body.decode("utf-8", errors="replace")), delimiter="\t") if r]


class DayReader(DataSourceReader):
    def __init__(self, template: str, days: Sequence[str], timeout: float):
        self.template, self.days, self.timeout = template, days, timeout

    def partitions(self):
        return [Day(d) for d in self.days]

    def read(self, partition):
        try:
            with request.urlopen(self.template.replace("{day}", partition.day), timeout=self.timeout) as got:  # file: and http(s): urls
                rows = day_rows(got.read())
        except (error.URLError, TimeoutError, zipfile.BadZipFile, OSError):
            return  # not published, or not to be had now: the day stays missing
        for k, fields in enumerate(rows):
            yield (partition.day, k, fields)


class DaySource(DataSource):
    """Format ``dayfiles`` (S15): a partition for each day of the option ``days``, read from ``template`` with {day} filled in."""

    @classmethod
    def name(cls):
        return "dayfiles"

    def schema(self):
        return "day string, position int, fields array<string>"

    def reader(self, schema):
        return DayReader(self.options["template"], self.options.get("days", "").split(), float(self.options.get("timeout", 60)))


def read_days(spark: SparkSession, template: str, days: Sequence[str]) -> DataFrame:
    """Rows of day files as they are: (day, position, fields); a day that can't be had has none."""
    spark.dataSource.register(DaySource)
    return spark.read.format("dayfiles").option("template", template).option("days", " ".join(days)).load()


def days_between(first: dt.date, last: dt.date) -> list[str]:
    return [(first + dt.timedelta(days=k)).strftime("%Y%m%d") for k in range((last - first).days + 1)]


def cached(spark: SparkSession, cache: str) -> list[str]:
    """The days that the cache holds, ascending."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n[4:] for n in names if n.startswith("day="))


def cached_scan(spark: SparkSession, cache: str, days: Sequence[str], load: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The rows of some days, from a cache that is filled with the missing ones first.

    ``load`` gives the rows of missing days, with a column ``day`` (yyyymmdd), such as
    ``read_days``.  They are written by day in one job, which shows whole days or, if it
    dies, none; a day without rows isn't cached and is asked for again next time.  The scan
    reads the folders of the days asked for and no others.
    """
    have = set(cached(spark, cache))
    missing = [d for d in dict.fromkeys(days) if d not in have]
    if missing:
        rows = load(missing)
        schema = rows.schema
        rows.filter(F.col("day").isin(missing)).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(cache)
        have = set(cached(spark, cache))
    wanted = [d for d in dict.fromkeys(days) if d in have]
    if not wanted:
        return load([]) if not missing else spark.createDataFrame([], schema)
    # Read by folder, so that neither other days nor their listing cost anything.
    return spark.read.option("basePath", cache).parquet(*[f"{cache}/day={d}" for d in wanted]).withColumn("day", F.col("day").cast("string"))
