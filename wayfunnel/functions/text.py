"""Text, request-context and time-format expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfunnel.functions.common import ColumnLike, col

# Characters kept by the cleaner (word characters, blanks, CJK range).
_NOT_KEPT = r"[^\p{L}\p{N}_\s一-鿿]"

# User-agent words, tested in this order.
DEVICE_WORDS = (
    ("tablet", ("ipad", "tablet")),
    ("mobile", ("iphone", "android", "mobile")),
    ("desktop", ("windows", "macintosh", "linux")),
)


def clean_text(c: ColumnLike) -> Column:
    """Lower case, symbols to blanks, runs of blanks to one, trimmed; null -> ''."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, _NOT_KEPT, " "), r"\s+", " "))


def word_count(c: ColumnLike) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda t: t != "")).cast("long")


def device_type(user_agent: ColumnLike) -> Column:
    ua = F.lower(F.coalesce(col(user_agent), F.lit("")))
    expr: Column | None = None
    for label, words in DEVICE_WORDS:
        hit = reduce(lambda a, b: a | b, [ua.contains(w) for w in words])
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise("unknown")


def locale_of(accept_language: ColumnLike) -> Column:
    first = F.lower(F.trim(F.split_part(F.coalesce(col(accept_language), F.lit("unknown")), F.lit(","), F.lit(1))))
    return F.when(first == "", "unknown").otherwise(first)


def time_bucket(ts: ColumnLike, hours: int) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd-HH" if hours == 1 else "yyyy-MM-dd")


def parse_event_time(c: ColumnLike) -> Column:
    """ISO text (with or without zone) or epoch seconds as text -> UTC timestamp without zone."""
    text = F.trim(col(c))
    epoch = text.try_cast("double")
    from_epoch = F.timestamp_micros((epoch * 1_000_000).cast("long"))
    iso = F.when(epoch.isNull(), F.try_to_timestamp(text))
    return F.coalesce(iso, from_epoch).cast("timestamp_ntz")


def freshness(days: ColumnLike) -> Column:
    """1.0 up to 7 days, 0.5 up to 30, else 0.2; a missing age counts as 999 days."""
    d = F.coalesce(col(days).cast("double"), F.lit(999.0))
    return F.when(d <= 7, 1.0).when(d <= 30, 0.5).otherwise(0.2)


def stamp(ts: ColumnLike) -> Column:
    """Timestamp as fixed text, for reports and comparisons."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")
