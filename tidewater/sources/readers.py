"""Readers and sinks: feeds, JSON shapes, delimited events, chart arrays, web pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass
from urllib import error, request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewater.functions import predicates, scalars

ENTRY = "feed string, position int, guid string, title string, summary string, link string, published string, failure string"
POINTS = "ticker string, points array<struct<date: string, value: double>>"
BARS = "symbol string, zone string, ts array<long>, close array<double>, adjclose array<double>"
WATCH = "version int, rows array<struct<id: string, trigger: string, symbol: string, condition: string, level: double>>"
BUNDLE = """ticker string, rp_entity_id string, sentiment struct<as_of: string, daily_sentiment: double, sentiment_pressure: double, abnormal_media_attention: double, trend_mean: double, trend_delta: double, n_points: int>,
 events array<struct<category: string, title: string, date: string, url: string>>, evidence array<struct<headline: string, source: string, date: string, url: string, sentiment: double>>, error string"""


@dataclass
class Feed(InputPartition):
    url: str


def failure_kind(problem: Exception) -> str:
    """http_403, http_429, http_5xx, tls, timeout, network, malformed or error."""
    if isinstance(problem, error.HTTPError):
        return f"http_{problem.code}" if problem.code in (403, 429) else "http_5xx" if problem.code >= 500 else "error"
    text = str(problem).lower()
    if isinstance(problem, TimeoutError) or "timed out" in text:
        return "timeout"
    if "ssl" in text or "certificate" in text:
        return "tls"
    if isinstance(problem, ET.ParseError):
        return "malformed"
    return "network" if isinstance(problem, (error.URLError, OSError)) else "error"


def parse_feed(body: bytes) -> list[dict[str, str | None]]:
    """The entries of an RSS or Atom document, in order."""
    name = lambda e: e.tag.rpartition("}")[2]
    out = []
    for item in ET.fromstring(body).iter():
        if name(item) not in ("item", "entry"):
            continue
        own: dict[str, str | None] = {}
        for child in item:
            kind = name(child)
            own.setdefault(kind, child.get("href") if kind == "link" and child.get("href") else child.text)
        out.append({
            "guid": own.get("guid") or own.get("id"), "title": own.get("title"), "summary": own.get("description") or own.get("summary") or own.get("content"),
            "link": own.get("link"), "published": own.get("pubDate") or own.get("published") or own.get("updated"),
        })
    return out


class FeedReader(DataSourceReader):
    def __init__(self, urls: Sequence[str], attempts: int):
        self.urls, self.attempts = urls, attempts

    def partitions(self):
        return [Feed(u) for u in self.urls]

    def read(self, partition):
        failure = None
        for _ in range(self.attempts):
            try:
                with request.urlopen(partition.url, timeout=20) as got:  # file: and http(s): urls
                    entries = parse_feed(got.read())
                if not entries:
                    yield (partition.url, None, None, None, None, None, None, "empty")
                for k, e in enumerate(entries):
                    yield (partition.url, k, e["guid"], e["title"], e["summary"], e["link"], e["published"], None)
                return
            except Exception as problem:  # each feed reports its own failure as a row
                failure = failure_kind(problem)
                if failure not in ("http_429", "http_5xx"):
                    break
        yield (partition.url, None, None, None, None, None, None, failure)


class FeedSource(DataSource):
    """Format ``feeds`` (S01, S05): one partition for each url of the option ``urls`` (blank-separated)."""

    @classmethod
    def name(cls):
        return "feeds"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return FeedReader(self.options.get("urls", "").split(), int(self.options.get("attempts", 3)))


def read_feeds(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.read.format("feeds").option("urls", " ".join(urls)).load()


def derived_title(body: Column, most: int = 160) -> Column:
    """Without tags and footer, cut at a word."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)The post .* appeared first on .*$", ""), r"<[^>]+>", " "), r"\s+", " "))
    return F.when(F.length(plain) > most, F.regexp_replace(F.substring(plain, 1, most), r"\s\S*$", "")).otherwise(plain)


def normalised_entries(entries: DataFrame) -> DataFrame:
    """Feed, position, guid, title (derived where missing), summary without tags, link, published_at, hash."""
    formats = ["EEE, dd MMM yyyy HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss zzz", "yyyy-MM-dd'T'HH:mm:ssXXX"]
    published = F.coalesce(*[F.try_to_timestamp("published", F.lit(f)) for f in formats[2:]], F.try_to_timestamp(F.regexp_replace("published", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    summary = F.trim(F.regexp_replace(F.regexp_replace("summary", r"<[^>]+>", " "), r"\s+", " "))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), derived_title(F.col("summary")))
    return entries.filter("failure IS NULL").select("feed", "position", "guid", title.alias("title"), summary.alias("summary"), "link", published.alias("published_at"), scalars.content_hash(F.col("guid"), F.col("link")).alias("hash"))


def page_text(html: Column) -> Column:
    """Scripts and styles out, then tags, white space as one blank."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def typed_event_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated event lines with at least 52 fields; rows with a bad date or number are dropped."""
    # Split once: a plain column would be split again for each field, and for each filter on one.
    split, f = lines.select(F.explode(F.array(F.split(column, "\t"))).alias("_f")), F.col("_f")
    rows = split.filter(F.size(f) >= 52).select(
        scalars.compact_date(f[1]).alias("date"), f[28].alias("root"), f[29].alias("quad"), f[30].try_cast("double").alias("goldstein"),
        f[31].try_cast("int").alias("mentions"), f[34].try_cast("double").alias("tone"), f[51].alias("geo"),
    )
    return rows.filter("date IS NOT NULL AND goldstein IS NOT NULL AND mentions IS NOT NULL AND tone IS NOT NULL")


def point_rows(series: DataFrame) -> DataFrame:
    """(ticker, date, value) of series (POINTS); a point without a readable date goes."""
    rows = series.select("ticker", F.inline("points"))
    return rows.select("ticker", F.try_to_date("date").alias("date"), "value").filter("date IS NOT NULL")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of JSON series files."""
    return point_rows(spark.read.schema(POINTS).option("multiLine", True).json(path))


def price_map_rows(rows: DataFrame, key: str, prices: str) -> DataFrame:
    """A map of date to close as rows."""
    return rows.select(key, F.explode(prices).alias("date", "close")).select(key, F.to_date("date").alias("date"), "close")


def chart_closes(charts: DataFrame, pence: Column | None = None) -> DataFrame:
    """(symbol, date, close) of chart arrays: adjusted close if there is one, exchange-local date, the day's last bar; of equal times the later in the array."""
    bars = charts.select("symbol", "zone", F.posexplode(F.arrays_zip("ts", "close", "adjclose")).alias("pos", "bar"))
    value = F.coalesce("bar.adjclose", "bar.close")
    local = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("bar.ts"), F.coalesce("zone", F.lit("UTC"))))
    rows = bars.filter(value.isNotNull()).groupBy("symbol", local.alias("date")).agg(F.max_by(value, F.struct("bar.ts", "pos")).alias("close"))
    return rows if pence is None else rows.withColumn("close", F.when(pence, F.col("close") / 100).otherwise(F.col("close")))


def watch_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a watch file with ``kind`` (event, price) and ``error`` (null for a good row)."""
    rows = text.select(F.from_json(column, WATCH).alias("f")).select(F.col("f.version").alias("version"), F.inline_outer("f.rows"))
    kind = F.when(F.col("condition").isNotNull(), "price").otherwise("event")
    wrong = (
        F.when(F.col("version").isNull() | (F.col("version") != 1), "version")
        .when(F.col("id").isNull(), "id")
        .when((kind == "event") & F.col("trigger").isNull(), "trigger")
        .when((kind == "price") & ~F.col("condition").isin("below", "above", "above_ma200"), "condition")
        .when((kind == "price") & (F.col("condition") != "above_ma200") & F.col("level").isNull(), "level")
    )
    return rows.withColumn("kind", kind).withColumn("error", wrong)


def gold_items(files: DataFrame) -> DataFrame:
    """The items of labelled files, a row each."""
    return files.select(F.explode("items").alias("i")).select("i.*")


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    """The items of a labelled file."""
    return gold_items(spark.read.option("multiLine", True).json(path))


def bundles_for(tickers: DataFrame, bundles: DataFrame) -> DataFrame:
    """A bundle for each wanted ticker; one that has none gets a bundle without sentiment or error."""
    return tickers.join(bundles, "ticker", "left")


def read_bundles(spark: SparkSession, path: str, tickers: DataFrame) -> DataFrame:
    """The bundles of a provider's files for the wanted tickers."""
    return bundles_for(tickers, spark.read.schema(BUNDLE).option("multiLine", True).json(path))


def rows_or_default(text: DataFrame, schema: str, default: DataFrame, column: str = "value") -> DataFrame:
    """The rows of JSON texts that can be read; the default's where not one can."""
    rows = text.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r IS NOT NULL")
    kind = rows.schema["r"].dataType.typeName()
    rows = rows.select(F.explode("r").alias("r")).select("r.*") if kind == "array" else rows.select("r.*")
    rows = rows.filter(F.coalesce(*[F.col(c).isNotNull() | F.lit(None) for c in rows.columns]).isNotNull())
    found = rows.limit(1).agg(F.count("*").alias("_found"))
    return rows.unionByName(default.select(*rows.columns).crossJoin(F.broadcast(found)).filter("_found = 0").drop("_found"))  # one row


def read_or_default(spark: SparkSession, path: str, schema: str, default: DataFrame) -> DataFrame:
    """JSON rows of a file; the default where it is missing or can't be read."""
    return rows_or_default(spark.read.text(path, wholetext=True), schema, default) if _exists(spark, path) else default


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_signals(signals: DataFrame, path: str, day: str = "date") -> None:
    """A snapshot of each day, replaced when written again."""
    signals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).json(path)


def pending_units(tickers: DataFrame, quarters: DataFrame, done: DataFrame) -> DataFrame:
    """A news unit for each ticker and a unit for each ticker and quarter, less those done."""
    news = tickers.select("ticker", F.lit(None).cast("string").alias("quarter"))
    calls = tickers.crossJoin(F.broadcast(quarters)).select("ticker", "quarter")
    rows = news.unionByName(calls)
    d = done.select(F.col("ticker").alias("t"), F.col("quarter").alias("q"))
    return rows.join(d, (F.col("ticker") == F.col("t")) & F.col("quarter").eqNullSafe(F.col("q")), "left_anti")


def passages(embeddings: DataFrame, query: Sequence[float] | DataFrame, n: int, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """The n rows most like a vector by cosine, ties by id.  ``query``: the vector, or one row with a column of the vector's name."""
    if isinstance(query, DataFrame):
        embeddings, q = embeddings.crossJoin(F.broadcast(query.limit(1).select(F.col(vector).cast("array<double>").alias("_q")))), F.col("_q")  # one row
    else:
        q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    cosine = F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return embeddings.select(row_id, F.round(cosine, 9).alias("score")).orderBy(F.desc("score"), row_id).limit(n)


def normalised_signals(raw: DataFrame) -> DataFrame:
    """Signals with canonical direction and confidence; rows without direction, confidence or topic are dropped."""
    direction = scalars.lookup(F.lower(F.trim("direction")), {"bullish": "bullish", "long": "bullish", "up": "bullish", "bearish": "bearish", "short": "bearish", "down": "bearish"})
    confidence = scalars.lookup(F.lower(F.trim("confidence")), {"high": "high", "strong": "high", "medium": "medium", "moderate": "medium", "low": "low", "weak": "low"})
    rows = raw.withColumn("direction", direction).withColumn("confidence", confidence).withColumn("topic", predicates.null_words(F.col("topic")))
    return rows.filter("direction IS NOT NULL AND confidence IS NOT NULL AND topic IS NOT NULL")


ARTICLES = "struct<articles: array<struct<title: string, url: string, published: string>>>"


def embedded_articles(pages: DataFrame, page_id: str, html: str, marker: str = "window.__DATA__") -> DataFrame:
    """(page, title, url, published) of the JSON object that a page assigns to ``marker``; pages without one give no rows."""
    blob = F.regexp_extract(html, rf"(?s){marker.replace('.', '[.]')}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    rows = pages.select(page_id, F.from_json(blob, ARTICLES).alias("d")).filter("d IS NOT NULL")
    return rows.select(page_id, F.inline("d.articles"))


def watched_closes(quotes_a: DataFrame, quotes_b: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted (symbol, market) with a close: for US the first provider, else the second; for UK, DE, FR the second only."""
    a, b = quotes_a.select("symbol", F.col("close").alias("_a")), quotes_b.select("symbol", F.col("close").alias("_b"))
    rows = wanted.join(a, "symbol", "left").join(b, "symbol", "left")
    close = F.when(F.col("market") == "US", F.coalesce("_a", "_b")).when(F.col("market").isin("UK", "DE", "FR"), F.col("_b"))
    return rows.withColumn("close", close).drop("_a", "_b")


def all_sources(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """Built-in feeds and a user's own of type feed; a capture url takes the url's place."""
    rows = builtin.unionByName(own.filter("source_type = 'feed'"), allowMissingColumns=True)
    return rows.withColumn("url", F.coalesce("capture_url", "url")).drop("capture_url")
