"""Column selection, defaults and coercions of the source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.functions import text as tx
from wayfunnel.functions.common import col, finite, log1p_floor, split_tags, with_defaults, zero

# Columns of the item and user views, prepared fields and their defaults.
ITEM_VIEW = ("dataset_id", "dataset_name", "description", "tag", "price", "create_company_name", "cover_id", "create_time")
USER_VIEW = ("user_id", "company_name", "province", "city", "is_consumption")
ITEM_TEXT = ("title", "intro", "description", "tag")
ITEM_NUMBERS = ("price", "original_price", "sales_volume", "clout", "dataset_size", "record_count")
ITEM_CATEGORIES = ("type_name", "data_format", "file_pattern", "create_company_name")
USER_TEXT = ("province", "city", "country", "company_industry", "company_name")
SEX_CODES = {0: "unknown", 1: "male", 2: "female"}
OPTIONAL_IMAGE = ("image_richness_score", "image_embed_norm", "has_images", "has_cover")


def coerce(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text columns to datetime / float; what does not parse, and infinities, become null."""
    out: dict[str, Column] = {}
    for name, kind in kinds.items():
        if name not in df.columns:
            continue
        out[name] = F.try_to_timestamp(F.col(name)).cast("timestamp_ntz") if kind == "datetime" else finite(name)
    return df.withColumns(out) if out else df


def live(df: DataFrame, flag: str = "is_delete") -> DataFrame:
    return df.filter(F.coalesce(F.col(flag).try_cast("long"), F.lit(0)) == 0) if flag in df.columns else df


def item_view(raw: DataFrame) -> DataFrame:
    out = live(raw).withColumnRenamed("id", "dataset_id")
    out = out.select(*[c for c in ITEM_VIEW if c in out.columns])
    texts = {c: F.coalesce(c, F.lit("")) for c in ("description", "tag", "create_company_name") if c in out.columns}
    return out.withColumns({**texts, "price": F.coalesce(F.col("price").try_cast("double"), F.lit(0.0))})


def user_view(raw: DataFrame) -> DataFrame:
    out = raw.withColumnRenamed("id", "user_id").select(*USER_VIEW)
    out = with_defaults(out, {c: "unknown" for c in ("company_name", "province", "city")})
    return out.withColumn("is_consumption", F.coalesce(F.col("is_consumption").try_cast("long"), F.lit(0)))


def only_live_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose item is in the item view; the key table is narrow and AQE may broadcast it."""
    return rows.join(items.select("dataset_id"), "dataset_id", "left_semi")


def one_day(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of one day as a half-open time range, so the scan can push the filter down."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return df.filter((F.col(column) >= start) & (F.col(column) < start + F.expr("INTERVAL 1 DAY")))


def utc_without_zone(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c).cast("string")).cast("timestamp_ntz")


def prepare_item_text(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    out = df.withColumns({c: (F.coalesce(c, F.lit("")) if c in present else F.lit("")) for c in ITEM_TEXT})
    tokens = F.replace("tag", F.lit(";"), F.lit(" "))
    combined = F.trim(F.concat_ws(" ", "title", "intro", "description", tokens))
    return out.withColumns({
        "tag_tokens": tokens, "title_clean": tx.clean_text("title"), "intro_clean": tx.clean_text("intro"),
        "description_clean": tx.clean_text("description"), "tag_clean": tx.clean_text(tokens),
        "combined_text": combined, "combined_text_clean": tx.clean_text(combined),
        "tag_list": split_tags("tag", lower=False)})


def prepare_item_numbers(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    numbers = {c: (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in present else F.lit(0.0))
               for c in ITEM_NUMBERS}
    out = df.withColumns(numbers)
    out = out.withColumns({f"{c}_log": log1p_floor(c) for c in ITEM_NUMBERS})
    return out.withColumns({c: (F.coalesce(c, F.lit("unknown")) if c in present else F.lit("unknown"))
                            for c in ITEM_CATEGORIES})


def prepare_users(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    sex: Column = F.lit("unknown")
    for code, label in SEX_CODES.items():
        sex = F.when(F.col("sex").try_cast("long") == code, label).otherwise(sex)
    texts = {c: (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) if c in present else F.lit("unknown"))
             for c in USER_TEXT}
    numbers = {c: (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in present else F.lit(0.0))
               for c in ("reg_channel", "is_consumption", "is_certificated")}
    out = df.filter(F.col("user_id").try_cast("long").isNotNull()).withColumns({"sex": sex, **texts, **numbers})
    out = out.withColumn("location", F.trim(F.concat_ws(" ", "province", "city")))
    out = out.withColumn("profile_text", F.trim(F.concat_ws(" ", "company_industry", "company_name", "location")))
    return out.withColumn("profile_text_clean", tx.clean_text("profile_text"))


def request_context(requests: DataFrame, source_header: str, source_param: str, user_agent: str,
                    language: str, app: str, keep: Sequence[str]) -> DataFrame:
    source = F.coalesce(F.nullif(F.col(source_header), F.lit("")), F.nullif(F.col(source_param), F.lit("")),
                        F.lit("unknown"))
    return requests.select(*keep, source.alias("source"), tx.device_type(user_agent).alias("device_type"),
                           tx.locale_of(language).alias("locale"), F.coalesce(app, F.lit("")).alias("client_app"))


def stored_item_view(df: DataFrame) -> DataFrame:
    """Re-coerce a stored item view: ids to long (bad -> 0), numbers and text to defaults."""
    present = set(df.columns)
    numbers = {c: (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in present else F.lit(0.0))
               for c in ("price", "interaction_count", "total_weight", *OPTIONAL_IMAGE)}
    texts = {c: (F.coalesce(c, F.lit("")) if c in present else F.lit("")) for c in ("description", "tag")}
    ident = {"dataset_id": F.coalesce(F.col("dataset_id").try_cast("long"), F.lit(0).cast("long"))}
    return df.withColumns({**ident, **numbers, **texts})


def text_corpus(items: DataFrame) -> DataFrame:
    parts = [F.coalesce(c, F.lit("")) for c in ("dataset_name", "description", "tag")]
    return items.select("dataset_id", F.trim(F.concat_ws("\n", *parts)).alias("text"))


def days_since(c: str, as_of: Column) -> Column:
    from wayfunnel.functions.common import days_between
    return zero(days_between(as_of, c), "long")
