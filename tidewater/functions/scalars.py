"""Scalar functions: ``Column -> Column``, built-in expressions unless marked."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
TRACKING_PREFIX = "utm_"
CLICK_IDS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
#: Words that say nothing of a headline.
NOISE_WORDS = "a an and as at but by for from in is it of on or s the to with after over says said new up down amid its his her their that this".split()
#: Words that say nothing of a claim.
CLAIM_NOISE = "a an and are as at be been by for from had has have in is it its of on or that the this to was were will with".split()
NUMBER = r"(\d[\d.,]*)"
SOURCE_SUFFIX = r"(?U)\s*[-|–—]\s*[\w.\s]{1,25}$"
DUPLICATE_JACCARD = 0.85


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Decode HTML entities; Spark has no built-in for it."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def normalize_url(url: Column) -> Column:
    """drop tracking parameters and the fragment, keep the order of the others."""
    plain = F.substring_index(url, "#", 1)
    base = F.substring_index(plain, "?", 1)
    query = F.when(F.locate("?", plain) > 0, F.substring(plain, F.length(base) + 2, F.length(plain))).otherwise("")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith(TRACKING_PREFIX) & ~name(p).isin(CLICK_IDS))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def content_hash(guid: Column, url: Column) -> Column:
    """sha256 of the guid, else of the normalised url."""
    return F.sha2(F.coalesce(F.nullif(F.trim(guid), F.lit("")), normalize_url(url)), 256)


def clean(text: Column) -> Column:
    """unescape, white space as one blank, trim."""
    return F.trim(F.regexp_replace(html_unescape(text), r"\s+", " "))


def tokens(text: Column, noise: Sequence[str] = NOISE_WORDS) -> Column:
    """distinct ASCII words in lower case without noise words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(list(noise))))


def fingerprint_numbers(text: Column) -> Column:
    """the distinct numbers of a claim, with their inner marks, sorted; null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.rtrim(n, F.lit(".,")))))


def fingerprint_words(text: Column, noise: Sequence[str] = CLAIM_NOISE) -> Column:
    """the distinct content words of a claim, sorted; a word doesn't begin with a digit."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(list(noise)) & ~w.rlike("^[0-9]"))))


def jaccard(a: Column, b: Column) -> Column:
    """shared over all elements of two arrays of distinct values; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def is_duplicate_claim(a: Column, b: Column) -> Column:
    """equal numbers and word similarity of at least DUPLICATE_JACCARD; a claim without words is nobody's duplicate."""
    return (fingerprint_numbers(a) == fingerprint_numbers(b)) & (jaccard(fingerprint_words(a), fingerprint_words(b)) >= DUPLICATE_JACCARD)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of words padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """F08."""
    return jaccard(trigrams(a), trigrams(b))


def dropped_numbers(stored: Column, rewritten: Column) -> Column:
    """numbers of the stored text that the rewritten one lacks."""
    return F.array_except(fingerprint_numbers(stored), fingerprint_numbers(rewritten))


def normalise_title(text: Column) -> Column:
    """decompose, straight quotes, cut a source after the last dash, words in lower case."""
    plain = F.regexp_replace(F.translate(nfkd(F.coalesce(text, F.lit(""))), "‘’“”", "''\"\""), SOURCE_SUFFIX, "")
    return F.array_join(F.regexp_extract_all(F.lower(plain), F.lit("([a-z0-9]+)"), 1), " ")


def nearest_rank(values: Column, q: float) -> Column:
    """the sorted array's element at round-half-even(q * (n - 1)); null when empty."""
    n = F.size(values)
    return F.when(n > 0, F.try_element_at(F.array_sort(values), (F.bround(F.lit(q) * (n - 1)) + 1).cast("int")))


def epoch_bucket(at: Column, hours: int) -> Column:
    """number of the epoch-aligned bucket."""
    return F.floor(F.unix_timestamp(at) / (hours * 3600)).cast("long")


def six_hour_start(at: Column) -> Column:
    """F16: the start of the 6-hour UTC bucket, in seconds."""
    return (F.floor(F.unix_timestamp(at) / 21600) * 21600).cast("long")


def duration_text(seconds: Column) -> Column:
    """1h05m, 12m."""
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes % 60)).otherwise(F.format_string("%dm", minutes))


def days_between(old: Column, new: Column) -> Column:
    """whole days from ISO texts; 0 when either can't be read."""
    read = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.datediff(read(new), read(old)), F.lit(0))


def resolution_date(first_seen: Column, horizon_days: Column) -> Column:
    """F19."""
    return F.date_add(first_seen, horizon_days)


def quarter_anchor(quarter: Column, offset_days: int = 50) -> Column:
    """the end of a quarter like 2020Q3 plus some days."""
    year, q = F.substring(quarter, 1, 4).try_cast("int"), F.substring(quarter, 6, 1).try_cast("int")
    return F.date_add(F.last_day(F.make_date(year, q * 3, F.lit(1))), offset_days)


def iso_week_friday(day: Column) -> Column:
    """F21."""
    return F.date_add(day, F.lit(4) - F.weekday(day))


def compact_date(text: Column) -> Column:
    """eight digits as a date, else null."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def signal_return(direction: Column, entry: Column, price: Column) -> Column:
    """F23."""
    move = F.try_divide(price, entry) - 1
    return F.when(direction == "bullish", move).otherwise(-move)


def haircut_fraction(asset_class: Column, equity_bps: float = 10, crypto_bps: float = 26) -> Column:
    """F24."""
    return F.when(asset_class == "crypto", crypto_bps).otherwise(equity_bps) / 10000


def benchmark_or_null(value: Column, most: float = 3.0) -> Column:
    """a benchmark return that can't be true is unknown."""
    return F.when(F.abs(value) <= most, value)


def parse_symbol(symbol: Column, markets: Sequence[str] = ("US", "UK", "DE", "FR")) -> Column:
    """struct(base, market) of BASE.MARKET with a known market, else null."""
    base, market = F.regexp_extract(symbol, r"^(.+)\.([A-Z]+)$", 1), F.regexp_extract(symbol, r"^(.+)\.([A-Z]+)$", 2)
    return F.when(market.isin(list(markets)), F.struct(base.alias("base"), market.alias("market")))


def normalize_ticker(raw: Column) -> Column:
    """upper case, without an exchange prefix or venue suffix."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(raw)), r"^[A-Z]+:", ""), r"\.[A-Z]{1,3}$", "")


def base_keys(ticker: Column) -> Column:
    """the raw base and the one without a trailing class marker."""
    return F.array_distinct(F.array(ticker, F.regexp_replace(ticker, r"[-/ ].*$", "")))


def lookup(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """a small fixed map."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def format_volume(v: Column) -> Column:
    """1.2M, 3.4k, n."""
    return (
        F.when(v >= 1e6, F.concat(F.format_string("%.1f", v / 1e6), F.lit("M")))
        .when(v >= 1e3, F.concat(F.format_string("%.1f", v / 1e3), F.lit("k")))
        .otherwise(F.floor(v).cast("string"))
    )


def full_turnover_minutes(overlap: Column, gap: Column) -> Column:
    """F32: null from an overlap of 1 on."""
    return F.when(overlap < 1, F.try_divide(gap, 1 - overlap))


def turnover_from_rate(window: Column, departed: Column, span: Column) -> Column:
    """null where nothing departed."""
    return F.when(departed > 0, F.try_divide(window * span, departed))


def flicker_ratio(window: Column, entries: Column) -> Column:
    """null where there were no entries."""
    return F.when(entries > 0, F.try_divide(window, entries))


def proposed_interval(turnover: Column, safety: float = 4, low: float = 10, high: float = 1440) -> Column:
    """truncated to whole minutes."""
    return F.greatest(F.lit(low), F.least(F.lit(high), turnover / safety)).cast("int")


def split_share(gaps_hours: Column) -> Column:
    """an aggregate, the mean of gaps capped at six hours, over six."""
    return F.avg(F.least(gaps_hours / 6, F.lit(1.0)))


def price_hash(signal: Column, condition: Column, level: Column) -> Column:
    """first 16 hex digits of a row's identity."""
    return F.left(F.sha2(F.concat_ws("|", signal, condition, level.cast("string")), 256), F.lit(16))


def trigger_hash(text: Column) -> Column:
    """F41."""
    return F.left(F.sha2(text, 256), F.lit(16))


def short_id(text: Column) -> Column:
    """F42."""
    return F.left(F.sha1(text), F.lit(10))


def call_cost(input_tokens: Column, output_tokens: Column, cached: Column, in_price: float, out_price: float, cache_share: float = 0.1, batch: bool = False) -> Column:
    """prices are by million tokens; cached input costs a share, a batch half."""
    cost = (input_tokens * in_price + cached * in_price * cache_share + output_tokens * out_price) / 1e6
    return cost / 2 if batch else cost


def host(url: Column) -> Column:
    """host with its port, as written."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def labels(prefix: str, ids: Column) -> Column:
    """map of prefix and position to id."""
    named = F.transform(ids, lambda x, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")), x))
    return F.map_from_entries(named)


def checkpoint_map(horizons: Sequence[tuple[str, int]], opened: Column, entry: Column, price_at) -> Column:
    """map of horizon label to struct(date, price, return); ``price_at(day)`` gives a Column."""
    rows = []
    for label, days in horizons:
        day = F.date_add(opened, days)
        price = price_at(day)
        rows.append(F.struct(F.lit(label), F.struct(day.alias("date"), price.alias("price"), (F.try_divide(price, entry) - 1).alias("return"))))
    return F.map_from_entries(F.array(*rows))


def sanitise(text: Column, allowed: Sequence[str] = ("b", "i", "a", "code", "pre")) -> Column:
    """escape markup except allowed tags."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.regexp_replace(escaped, rf"&lt;(/?(?:{'|'.join(allowed)})(?: [^&]*)?)&gt;", "<$1>")


def news_query_url(domain: Column) -> Column:
    """a feed query for a site."""
    return F.concat(F.lit("https://news.google.com/rss/search?q="), F.url_encode(F.concat(F.lit("site:"), domain)))


def severity_rank(severity: Column) -> Column:
    """F49."""
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def repair_minor_unit(entry: Column, mark: Column) -> Column:
    """a mark a hundred times off is in the minor unit."""
    ratio = F.try_divide(mark, entry)
    return F.when(ratio.between(50, 200), mark / 100).otherwise(mark)


def retire_score(gross: Column, cost: Column) -> Column:
    """net return, not below total loss."""
    return F.greatest(gross - cost, F.lit(-1.0))


def day_range(start: Column, end: Column) -> Column:
    """all days, ends included."""
    return F.explode(F.sequence(start, end))


def quarters(start_year: int, end_year: int, end_q: int) -> list[str]:
    """YYYYQn up to a bound."""
    return [f"{y}Q{q}" for y in range(start_year, end_year + 1) for q in range(1, 5) if (y, q) <= (end_year, end_q)]


def census_block(prepared_on: Column, day_one: Column, lag: int = 3, days: int = 14, least: int = 10) -> Column:
    """struct(start, end); null when fewer than ``least`` days are left."""
    end = F.date_sub(prepared_on, lag)
    start = F.greatest(F.date_sub(end, days), F.date_add(day_one, days))
    return F.when(F.datediff(end, start) >= least, F.struct(start.alias("start"), end.alias("end")))
