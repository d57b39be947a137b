"""Predicates and rules: ``Column -> Column``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import scalars

# Fixed values.
CONFLICT_ROOTS = ["18", "19", "20"]
NULL_WORDS = ["", "null", "none", "n/a", "na"]
QUOTE_PAGE_PHRASE = "stock price & latest news"
QUOTE_PAGE_TITLES = [
    r"^About .+ \([A-Za-z0-9^=][A-Za-z0-9^=\-]*\.[A-Z0-9]+\)\s+-\s+Reuters$",
    r"^(?:[A-Z0-9^=][A-Z0-9.^=\-]*|[A-Za-z0-9^=][A-Za-z0-9^=\-]*\.[A-Z]{1,3})\s+-\s+Reuters$",
]
TRUE_WORDS = ["1", "true", "yes", "on"]


def exclusion_reason(title: Column, quote_page: Column, published: Column, created: Column, backlog_hours: int = 24) -> Column:
    """The first of empty_title, quote_page, backlog; else null."""
    late = F.unix_timestamp(created) - F.unix_timestamp(published) > backlog_hours * 3600
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "empty_title").when(quote_page, "quote_page").when(late, "backlog")


def is_quote_page(title: Column, phrase: str = QUOTE_PAGE_PHRASE, titles: Sequence[str] = QUOTE_PAGE_TITLES) -> Column:
    """An instrument's page and no news: its title, unescaped, has the phrase or is a bare instrument or profile; null isn't."""
    plain = F.trim(scalars.html_unescape(F.coalesce(title, F.lit(""))))
    hit = F.lower(plain).contains(phrase)
    for pattern in titles:
        hit = hit | plain.rlike(pattern)
    return hit


def is_syndication(a: Column, b: Column, least: float = 0.85) -> Column:
    """Equal normalised titles, or token similarity of these; a title without words is nobody's copy."""
    x, y = scalars.normalise_title(a), scalars.normalise_title(b)
    alike = (x == y) | (scalars.jaccard(scalars.tokens(x), scalars.tokens(y)) >= least)
    return (x != "") & (y != "") & alike


def in_region(geo: Column, region: Sequence[str]) -> Column:
    """P04."""
    return geo.isin(list(region))


def is_conflict(quad: Column, root: Column) -> Column:
    """P05."""
    return quad.isin("3", "4") | root.isin(CONFLICT_ROOTS)


def without_boilerplate(segments: Column) -> Column:
    """Segments (speaker, title, sentiment) that are not the operator's or investor relations'."""
    return F.filter(segments, lambda s: (F.lower(s["speaker"]) != "operator") & ~F.lower(s["title"]).contains("investor relations"))


def form_matches(form: Column, text: Column, stop: Sequence[str] = ()) -> Column:
    """A surface form between non-word characters; forms of under four characters keep their case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(form, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    pattern = lambda flags: F.concat(F.lit(f"{flags}(?<!\\w)"), quoted, F.lit(r"(?!\w)"))
    hit = F.when(F.length(form) < 4, F.expr("true") & F.regexp_like(text, pattern("(?U)"))).otherwise(F.regexp_like(text, pattern("(?U)(?i)")))
    return hit & ~F.lower(form).isin(list(stop) or [""])


def is_due(last: Column, now: Column, interval_minutes: Column, half_tick_minutes: float = 15) -> Column:
    """Never polled, or half a tick of slack brings it due."""
    minutes = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 60
    return last.isNull() | (minutes + half_tick_minutes >= interval_minutes)


def is_proxy(url: Column, marks: Sequence[str] = ("news.google.com", "bing.com/news")) -> Column:
    """The feed is ranked by relevance, or a proxy for a site."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.lower(url).contains(m)
    return hit


def null_words(value: Column) -> Column:
    """P18."""
    return F.when(~F.lower(F.trim(value)).isin(NULL_WORDS), value)


def asset_class(ticker: Column, declared: Column, indices: Sequence[str]) -> Column:
    """Unknown is equity; an equity with an index ticker is an index."""
    known = F.when(declared.isin("equity", "crypto", "index", "commodity"), declared).otherwise("equity")
    return F.when((known == "equity") & ticker.isin(list(indices)), "index").otherwise(known)


def plausible_mark(entry: Column, mark: Column, ratio: float = 10.0) -> Column:
    """P19."""
    return (entry > 0) & (mark > 0) & F.try_divide(mark, entry).between(1 / ratio, ratio)


def has_new_crossing(days_open: Column, recorded: Column, horizons: Sequence[int] = (7, 14, 28)) -> Column:
    """A horizon has passed that is not recorded."""
    return F.exists(F.array(*map(F.lit, horizons)), lambda h: (days_open >= h) & ~F.array_contains(recorded, h))


def in_cooldown(last_alert: Column, now: Column, hours: int = 12) -> Column:
    """A time that can't be read is not in cooldown; parts of a second count."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(micros(now) - micros(F.try_to_timestamp(last_alert)) < hours * 3_600_000_000, F.lit(False))


def band(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Half-open bands [edges[i], edges[i + 1]); outside is null."""
    out = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], names):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def gap_band(share: Column) -> Column:
    """P27."""
    return F.when(share < 0.4, "proceed").when(share <= 0.5, "within_6h_only").when(share > 0.5, "stop")


def enum_or_null(value: Column, members: Sequence[str]) -> Column:
    """The canonical lower-case member, else null."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(list(members)), low)


def horizon_days(value: Column) -> Column:
    """An integer of 1 to 3650, else null; booleans are rejected."""
    n = F.when(~F.lower(value.cast("string")).isin("true", "false"), value.cast("string").try_cast("int"))
    return F.when(n.between(1, 3650), n)


def source_count(value: Column) -> Column:
    """A non-negative integer, else null."""
    n = value.cast("string").try_cast("int")
    return F.when(n >= 0, n)


def strength(verdict: Column, has_evidence: Column) -> Column:
    """P32."""
    return F.when(verdict == "triggered", 2).when((verdict == "unclear") & has_evidence, 1).otherwise(0)


def knob(raw: Column, kind: str, default) -> Column:
    """Typed parse; blank or unreadable gives the default."""
    text = F.nullif(F.trim(raw), F.lit(""))
    if kind == "boolean":
        return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(text).isin(TRUE_WORDS))
    return F.coalesce(text.try_cast(kind), F.lit(default))


def evidence_verdict(verdict: Column, evidence: Column, known: Column) -> Column:
    """An unknown label makes the row invalid; triggered without evidence is unclear."""
    unknown = F.size(F.array_except(evidence, known)) > 0
    return F.when(unknown, "invalid").when((verdict == "triggered") & (F.size(evidence) == 0), "unclear").otherwise(verdict)


def poll_interval(nominal: Column, declared: Column, ranked: Column, most: int = 4) -> Column:
    """A declared integer above nominal counts on feeds that aren't ranked, up to a multiple."""
    wanted = declared.cast("string").try_cast("int")
    return F.when(~ranked & (wanted > nominal), F.least(wanted, nominal * most)).otherwise(nominal)


def corroboration_cue(n: Column) -> Column:
    """P41."""
    return F.when(n >= 4, "widely reported").when(n >= 2, "corroborated").when(n == 1, "single source").otherwise("unsourced")


def sign_ok(ic: Column, expected: Column, least: float = 0.03) -> Column:
    """P42."""
    return (F.signum(ic) == expected) & (F.abs(ic) > least)


def is_throttled(*markers: Column) -> Column:
    """Any of the marker fields is there."""
    return F.coalesce(*markers).isNotNull()


def price_verdict(condition: Column, last: Column, level: Column, average: Column, n_bars: Column, stale_days: Column) -> Column:
    """Fired, not or unknown for below, above and above_ma200."""
    usable = (n_bars > 0) & (stale_days <= 5)
    hit = F.when(condition == "below", last < level).when(condition == "above", last > level).when((condition == "above_ma200") & (n_bars >= 200), last > average)
    return F.when(~usable | hit.isNull(), "unknown").when(hit, "fired").otherwise("not")
