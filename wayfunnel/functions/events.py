"""Expressions that read items, slots, requests and channels out of web logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.functions.common import ColumnLike, col

# Url shapes that carry an item id, in order of precedence.
ITEM_PATTERNS = (r"dataDetail/(\d+)", r"dataAPIDetail/(\d+)", r"payment/(\d+)")
CLICK_PATTERN = r"^click_(\d+)_([0-9]+)"
SLOT_PATTERN = r"pos=(\d+)"
REQUEST_PATTERN = r"rid=([^&]+)"
REQUEST_PREFIX = "req_"

# Columns searched for an item, in order of precedence.
ACTION_ID_COLUMNS = ("idaction_url", "idaction_name", "idaction_event_action", "idaction_event_category",
                     "idaction_product_name", "idaction_content_target")
ACTION_TEXT_COLUMNS = ("search_cat", "search_count", "url", "referer_url", "idpageview")

# Dimensions read even when the configuration does not name them.
LEGACY_REQUEST_DIMENSIONS = (4, 2, 3, 1)
CLICK_COLUMN = "custom_dimension_5"

# Default weight per recall channel used for training labels.
LABEL_CHANNEL_WEIGHTS: dict[str, float] = {
    "behavior": 1.5, "content": 0.8, "vector": 0.5, "popular": 0.05, "tag": 0.4,
    "category": 0.3, "price": 0.2, "usercf": 0.6, "image": 0.4,
}
UNLISTED_CHANNEL_WEIGHT = 0.1


def _digits(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("long")


def item_from_text(c: ColumnLike) -> Column:
    text = col(c).cast("string")
    return F.coalesce(*[_digits(text, p) for p in ITEM_PATTERNS])


def dimension_columns(configured: Iterable[int], always: Sequence[int]) -> list[str]:
    """Configured dimension numbers first, then the always-read ones, without repeats."""
    wanted = [d for d in configured if d and d > 0] + list(always)
    return [f"custom_dimension_{d}" for d in dict.fromkeys(wanted)]


def parse_dimensions(raw: str | None, fallback: str | None = None) -> list[int]:
    """`"4, x,2"` -> [4, 2]; the fallback is used when nothing parses."""
    def numbers(text: str | None) -> list[int]:
        out = []
        for part in (text or "").split(","):
            try:
                out.append(int(part.strip()))
            except ValueError:
                continue
        return out
    return numbers(raw) or numbers(fallback)


def request_columns(configured: str | None = None) -> list[str]:
    return dimension_columns(parse_dimensions(configured, "4") or [4], LEGACY_REQUEST_DIMENSIONS)


def slot_columns(configured: str | None = None) -> list[str]:
    return dimension_columns(parse_dimensions(configured), (4,))


def click_item(c: ColumnLike = CLICK_COLUMN) -> Column:
    return _digits(F.trim(col(c)), CLICK_PATTERN, 2)


def click_slot(c: ColumnLike = CLICK_COLUMN) -> Column:
    return _digits(F.trim(col(c)), CLICK_PATTERN, 1)


def digits_only(c: ColumnLike) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long"))


def slot_of(columns: Sequence[str], url: ColumnLike = "url", click: ColumnLike | None = CLICK_COLUMN) -> Column:
    """Slot from click metadata, else a configured column, else the url."""
    found = [digits_only(c) for c in columns] + [_digits(col(url), SLOT_PATTERN)]
    if click is not None:
        found = [click_slot(click), *found]
    return F.coalesce(*found)


def request_from_columns(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(c).startswith(REQUEST_PREFIX), F.col(c)) for c in columns])


def request_of(columns: Sequence[str], url: ColumnLike = "url") -> Column:
    from_url = F.nullif(F.regexp_extract(F.coalesce(col(url), F.lit("")), REQUEST_PATTERN, 1), F.lit(""))
    return F.coalesce(request_from_columns(columns), from_url)


def is_recommend_click(columns: Sequence[str], url: ColumnLike = "url") -> Column:
    return F.coalesce(col(url).contains("from=recommend"), F.lit(False)) | request_from_columns(columns).isNotNull()


def _tokens(reason: ColumnLike) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.coalesce(col(reason), F.lit("")))), r"\+"), lambda t: t != "")


def channel_first(reason: ColumnLike) -> Column:
    """First token of `a+b`; `fallback…` -> fallback; nothing -> unknown."""
    first = F.get(_tokens(reason), F.lit(0))
    return F.when(first.isNull(), "unknown").when(first.startswith("fallback"), "fallback").otherwise(first)


def channel_first_known(reason: ColumnLike, known: Iterable[str]) -> Column:
    """First token that is a known channel or a fallback, else the first token."""
    names = list(known)
    tokens = _tokens(reason)
    hit = F.get(F.filter(tokens, lambda t: t.isin(names) | t.startswith("fallback")), F.lit(0))
    chosen = F.coalesce(hit, F.get(tokens, F.lit(0)))
    is_fallback = hit.isNotNull() & hit.startswith("fallback") & ~hit.isin(names)
    return F.when(chosen.isNull(), "unknown").when(is_fallback, "fallback").otherwise(chosen)


def lookup(key: ColumnLike, table: Mapping[str, float], default: float) -> Column:
    """Small fixed table as a literal map."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(float(kv[1]))], table.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(float(default)))


def channel_weight(weights_json: ColumnLike, channel: ColumnLike,
                   defaults: Mapping[str, float] = LABEL_CHANNEL_WEIGHTS) -> Column:
    """Weight named in the logged JSON, else the default table, else 0.1."""
    parsed = F.from_json(col(weights_json), T.MapType(T.StringType(), T.StringType()))
    override = F.try_element_at(parsed, col(channel)).try_cast("double")
    return F.coalesce(override, lookup(channel, defaults, UNLISTED_CHANNEL_WEIGHT))
