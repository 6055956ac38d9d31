"""Queries for projections, cleaning and the relational building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import AS_OF, Inputs, every
from wayfunnel.functions import text as tx
from wayfunnel.functions.common import days_between, split_tags, timestamp_lit
from wayfunnel.operators import cleaning as cl
from wayfunnel.operators import projections as pj
from wayfunnel.operators import ranks as rk
from wayfunnel.operators import relational as rl
from wayfunnel.plans.oracle import DAYS, I, R, TABLES, TAGS, TS
from wayfunnel.plans.oracle import AS_OF as SQL_AS_OF
from wayfunnel.plans.registry import query

CLEAN_AS_OF = "1999-01-01 00:00:00"
SQL_CLEAN_AS_OF = f"TIMESTAMP '{CLEAN_AS_OF}'"


def users(t: Inputs) -> DataFrame:
    return pj.user_view(t.raw_users)


def items(t: Inputs) -> DataFrame:
    return pj.item_view(t.raw_items)


# -- projections ----------------------------------------------------------------

def text_lines(t: Inputs) -> DataFrame:
    """Order lines as a text source with broken cells."""
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(every("l_orderkey", 5), "n/a").when(every("l_orderkey", 7), "Infinity")
         .otherwise(F.col("l_quantity").cast("string")).alias("price"),
        F.when(every("l_orderkey", 11), "bad").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
         .alias("create_time"))


@query("prj1_coerced_types", f"""
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 THEN {R('l_quantity')} END AS price,
         CASE WHEN l_orderkey % 11 <> 0 THEN {TS('l_shipdate')} END AS create_time FROM lineitem""")
def _(t: Inputs) -> DataFrame:
    out = pj.coerce(text_lines(t), {"price": "float", "create_time": "datetime"})
    return out.withColumn("create_time", tx.stamp("create_time"))


@query("prj2_item_view", f"""
  SELECT dataset_id, dataset_name, md5(description) AS description, tag, {R('price')} AS price, create_company_name,
         cover_id, {TS('create_time')} AS create_time FROM x_items""")
def _(t: Inputs) -> DataFrame:
    return items(t).withColumns({"description": F.md5("description"), "create_time": tx.stamp("create_time")})


@query("prj3_user_view", "SELECT user_id, company_name, province, city, is_consumption FROM x_users")
def _(t: Inputs) -> DataFrame:
    return users(t)


@query("prj4_rows_of_live_items", """
  SELECT image_key, dataset_id FROM x_images WHERE dataset_id IN (SELECT dataset_id FROM x_items)""")
def _(t: Inputs) -> DataFrame:
    return pj.only_live_items(t.images.select("image_key", "dataset_id"), items(t))


@query("prj5_one_day", f"SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def _(t: Inputs) -> DataFrame:
    return pj.one_day(t.table("events"), "ts", "2024-01-15").select("event_id", "event_type")


@query("prj6_exposure_context", """
  SELECT event_id, coalesce(variant, 'default') AS variant, coalesce(endpoint, 'unknown') AS endpoint,
         coalesce(page_id, '') AS page_id, coalesce(algorithm_version, 'unknown') AS algorithm_version FROM x_exposures""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.attribution import standard_context
    return standard_context(t.exposures).select("event_id", "variant", "endpoint", "page_id", "algorithm_version")


@query("prj7_sample_context", """
  SELECT event_id, coalesce(endpoint, 'unknown') AS endpoint, coalesce(variant, 'primary') AS variant,
         coalesce(experiment_variant, 'control') AS experiment_variant, coalesce(degrade_reason, 'none') AS degrade_reason,
         coalesce(source, 'unknown') AS source, coalesce(device_type, 'unknown') AS device_type,
         coalesce(locale, 'unknown') AS locale, coalesce(client_app, '') AS client_app FROM x_exposures""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.functions.common import with_defaults
    from wayfunnel.operators.funnel import SAMPLE_DEFAULTS
    return with_defaults(t.exposures, SAMPLE_DEFAULTS).select("event_id", *SAMPLE_DEFAULTS)


@query("prj8_utc_timestamps", f"SELECT event_id, {TS('ts - INTERVAL 8 HOUR')} AS ts FROM events")
def _(t: Inputs) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    return t.table("events").select("event_id", tx.stamp(pj.utc_without_zone(text)).alias("ts"))


@query("prj9_iso_or_epoch", f"""
  SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN {TS('ts')} END AS ts FROM events""")
def _(t: Inputs) -> DataFrame:
    raw = F.when(every("event_id", 10), "junk") \
        .when(every("event_id", 3), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
        .when(every("event_id", 3, 1), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.table("events").select("event_id", tx.stamp(tx.parse_event_time(raw)).alias("ts"))


_CLEAN = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s一-鿿]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("prj10_clean_text", f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned FROM documents")
def _(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", F.md5(tx.clean_text("text")).alias("cleaned"))


_COMBINED = """trim(dataset_name || ' ' || '' || ' ' || coalesce(description, '') || ' '
               || replace(coalesce(tag, ''), ';', ' '))"""


@query("prj11_item_text", f"""
  SELECT id AS item_id, replace(coalesce(tag, ''), ';', ' ') AS tag_tokens, {_CLEAN.format('dataset_name')} AS title_clean,
         md5({_CLEAN.format("coalesce(description, '')")}) AS description_clean, md5({_COMBINED}) AS combined_text,
         md5({_CLEAN.format(_COMBINED)}) AS combined_text_clean, len({TAGS('tag')}) AS tags FROM x_raw_items""")
def _(t: Inputs) -> DataFrame:
    raw = t.raw_items.withColumnsRenamed({"id": "item_id", "dataset_name": "title"})
    return pj.prepare_item_text(raw).select(
        "item_id", "tag_tokens", "title_clean", F.md5("description_clean").alias("description_clean"),
        F.md5("combined_text").alias("combined_text"), F.md5("combined_text_clean").alias("combined_text_clean"),
        F.size("tag_list").alias("tags"))


@query("prj12_item_numbers", f"""
  SELECT id AS item_id, {R('coalesce(price, 0.0)')} AS price, {R('ln(1 + greatest(coalesce(price, 0.0), 0))')} AS price_log,
         0.0::DOUBLE AS clout_log, coalesce(create_company_name, 'unknown') AS create_company_name,
         'unknown' AS type_name FROM x_raw_items""")
def _(t: Inputs) -> DataFrame:
    return pj.prepare_item_numbers(t.raw_items).select(
        F.col("id").alias("item_id"), "price", "price_log", "clout_log", "create_company_name", "type_name")


@query("prj13_user_profile_text", f"""
  WITH u AS (SELECT id AS user_id, CASE sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex,
                    coalesce(province, 'unknown') || ' ' || coalesce(city, 'unknown') AS location,
                    coalesce(company_name, 'unknown') AS company,
                    {R('coalesce(TRY_CAST(is_consumption AS DOUBLE), 0.0)')} AS is_consumption FROM x_raw_users)
  SELECT user_id, sex, location, is_consumption,
         {_CLEAN.format("'unknown ' || company || ' ' || location")} AS profile_text_clean FROM u""")
def _(t: Inputs) -> DataFrame:
    out = pj.prepare_users(t.raw_users.withColumnRenamed("id", "user_id"))
    return out.select("user_id", "sex", "location", "is_consumption", "profile_text_clean")


def web_requests(t: Inputs) -> DataFrame:
    e = "event_id"
    return t.events.select(
        e, "ts",
        F.when(every(e, 6), "Mozilla/5.0 (iPad; CPU OS)").when(every(e, 6, 1), "Mozilla (Linux; Android 14) Mobile")
         .when(every(e, 6, 2), "Mozilla (Windows NT 10.0)").when(every(e, 6, 3), "curl/8").when(every(e, 6, 4), "")
         .alias("user_agent"),
        F.when(every(e, 4), "search").when(every(e, 4, 1), "").alias("header_source"),
        F.when(every(e, 3), "landing").alias("param_source"),
        F.when(every(e, 5), "zh-CN,zh;q=0.9").when(every(e, 5, 1), " ,en").when(every(e, 5, 2), "EN").alias("language"),
        F.when(every(e, 2), "app").alias("app"))


_DEVICE = """CASE event_id % 6 WHEN 0 THEN 'tablet' WHEN 1 THEN 'mobile' WHEN 2 THEN 'desktop' ELSE 'unknown' END"""


@query("prj14_device_type", f"SELECT event_id, {_DEVICE} AS device_type FROM events")
def _(t: Inputs) -> DataFrame:
    return web_requests(t).select("event_id", tx.device_type("user_agent").alias("device_type"))


@query("prj15_time_bucket", """
  SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour_bucket, strftime(ts, '%Y-%m-%d') AS day_bucket FROM events""")
def _(t: Inputs) -> DataFrame:
    return t.table("events").select("event_id", tx.time_bucket("ts", 1).alias("hour_bucket"),
                                    tx.time_bucket("ts", 24).alias("day_bucket"))


@query("prj16_request_context", f"""
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'search' WHEN event_id % 3 = 0 THEN 'landing' ELSE 'unknown' END AS source,
         {_DEVICE} AS device_type,
         CASE event_id % 5 WHEN 0 THEN 'zh-cn' WHEN 2 THEN 'en' ELSE 'unknown' END AS locale,
         CASE WHEN event_id % 2 = 0 THEN 'app' ELSE '' END AS client_app FROM events""")
def _(t: Inputs) -> DataFrame:
    return pj.request_context(web_requests(t), "header_source", "param_source", "user_agent", "language", "app",
                              ["event_id"])


@query("prj17_tag_list", f"SELECT id, array_to_string({TAGS('tag')}, '|') AS tags FROM x_raw_items")
def _(t: Inputs) -> DataFrame:
    return t.raw_items.select("id", F.array_join(split_tags("tag"), "|").alias("tags"))


@query("prj18_freshness", f"""
  WITH d AS (SELECT id, CASE WHEN id % 4 <> 0 THEN {DAYS("TIMESTAMP '1995-03-01 00:00:00'", 'create_time')} END AS days
             FROM x_raw_items)
  SELECT id, CASE WHEN coalesce(days, 999) <= 7 THEN 1.0::DOUBLE WHEN coalesce(days, 999) <= 30 THEN 0.5::DOUBLE
                  ELSE 0.2::DOUBLE END AS freshness FROM d""")
def _(t: Inputs) -> DataFrame:
    days = F.when(~every("id", 4), days_between(timestamp_lit("1995-03-01 00:00:00"), "create_time"))
    return t.raw_items.select("id", tx.freshness(days).alias("freshness"))


@query("prj19_stored_view", f"""
  SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE id END AS dataset_id,
         CASE WHEN id % 7 = 0 THEN 0.0 ELSE {R('coalesce(price, 0.0)')} END AS price, coalesce(tag, '') AS tag,
         0.0::DOUBLE AS has_cover FROM x_raw_items""")
def _(t: Inputs) -> DataFrame:
    stored = t.raw_items.select(
        "id", F.when(every("id", 5), "x").otherwise(F.col("id").cast("string")).alias("dataset_id"),
        F.when(every("id", 7), "?").otherwise(F.col("price").cast("string")).alias("price"), "tag")
    return pj.stored_item_view(stored).select("id", "dataset_id", "price", "tag", "has_cover")


@query("prj20_text_corpus", """
  SELECT dataset_id, md5(trim(dataset_name || chr(10) || description || chr(10) || tag)) AS text FROM x_items""")
def _(t: Inputs) -> DataFrame:
    return pj.text_corpus(items(t)).withColumn("text", F.md5("text"))


# -- cleaning -------------------------------------------------------------------

TABLES["x_dirty"] = """
  SELECT id, buyer AS user_id, item AS dataset_id,
         CASE WHEN id % 13 = 0 THEN -1.0::DOUBLE WHEN id % 97 = 0 THEN 900000.0::DOUBLE
              ELSE ln(1 + coalesce(price, 0.0)) END AS weight,
         CASE WHEN id % 41 <> 0 THEN create_time END AS last_event_time FROM x_lines"""


def dirty(t: Inputs) -> DataFrame:
    """Uncleaned interactions: repeated pairs, negative and huge weights, null and late times."""
    return t.order_lines.select(
        "id", F.col("buyer").alias("user_id"), F.col("item").alias("dataset_id"),
        F.when(every("id", 13), -1.0).when(every("id", 97), 900000.0)
         .otherwise(F.log1p(F.coalesce("price", F.lit(0.0)))).alias("weight"),
        F.when(~every("id", 41), F.col("create_time")).alias("last_event_time"))


_BOUNDS = """q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}),
  b AS (SELECT q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper FROM q)"""


@query("cln1_iqr_clip", f"""
  WITH {_BOUNDS.format(c='weight', t='x_dirty')}
  SELECT id, {R('CASE WHEN weight < lower THEN lower WHEN weight > upper THEN upper ELSE weight END')} AS weight
  FROM x_dirty, b""")
def _(t: Inputs) -> DataFrame:
    return cl.iqr_clip(dirty(t), "weight").select("id", "weight")


@query("cln1b_iqr_remove_stats", f"""
  WITH {_BOUNDS.format(c='weight', t='x_dirty')}
  SELECT 'iqr' AS method, count(*) FILTER (weight < lower OR weight > upper) AS anomalies_found,
         count(*) AS original_count, count(*) FILTER (weight BETWEEN lower AND upper) AS cleaned_count,
         count(*) FILTER (weight < lower OR weight > upper) AS removed_count FROM x_dirty, b""")
def _(t: Inputs) -> DataFrame:
    return cl.outlier_stats(cl.iqr_flag(dirty(t), "weight"), True, "iqr")


@query("cln2_zscore_outliers", """
  WITH s AS (SELECT avg(weight) AS m, stddev_pop(weight) AS d FROM x_dirty)
  SELECT id FROM x_dirty, s WHERE d > 0 AND abs(weight - m) / d > 3""")
def _(t: Inputs) -> DataFrame:
    return cl.zscore_flag(dirty(t), "weight").filter("is_outlier").select("id")


@query("cln3_cap_percentiles", f"""
  WITH q AS (SELECT quantile_cont(weight, 0.05) AS lo, quantile_cont(weight, 0.95) AS hi FROM x_dirty)
  SELECT id, {R('CASE WHEN weight > hi THEN hi WHEN weight < lo THEN lo ELSE weight END')} AS weight FROM x_dirty, q""")
def _(t: Inputs) -> DataFrame:
    return cl.cap_percentiles(dirty(t), "weight").select("id", "weight")


@query("cln4_remove_duplicates", """
  SELECT 'first' AS keep, id FROM (SELECT id FROM x_dirty QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY id) = 1)
  UNION ALL
  SELECT 'last', id FROM (SELECT id FROM x_dirty QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY id DESC) = 1)""")
def _(t: Inputs) -> DataFrame:
    keys = ["user_id", "dataset_id"]
    parts = [cl.drop_duplicates(dirty(t), keys, ["id"], k).select(F.lit(k).alias("keep"), "id")
             for k in ("first", "last")]
    return parts[0].union(parts[1])


@query("cln4b_unique_only", """
  SELECT id FROM x_dirty WHERE user_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY user_id, dataset_id) = 1""")
def _(t: Inputs) -> DataFrame:
    return cl.drop_duplicates(dirty(t).filter("user_id is not null"), ["user_id", "dataset_id"], [], "none").select("id")


@query("cln4c_duplicate_stats", f"""
  WITH p AS (SELECT user_id, dataset_id, count(*) AS n FROM x_dirty GROUP BY 1, 2)
  SELECT 'last' AS keep, {I('sum(n)')} AS original_count, {I('sum(n) FILTER (n > 1)')} AS duplicate_count,
         {I('sum(n) - count(*)')} AS removed_count, count(*) AS cleaned_count,
         {R('sum(n) FILTER (n > 1) / sum(n)')} AS duplicate_ratio FROM p""")
def _(t: Inputs) -> DataFrame:
    return cl.duplicate_stats(dirty(t), ["user_id", "dataset_id"], "last")


@query("cln5_fix_timestamps", f"""
  SELECT id, {TS(f'least(last_event_time, {SQL_CLEAN_AS_OF})')} AS last_event_time FROM x_dirty
  WHERE last_event_time IS NOT NULL""")
def _(t: Inputs) -> DataFrame:
    return cl.fix_timestamps(dirty(t), "last_event_time", timestamp_lit(CLEAN_AS_OF)).select(
        "id", tx.stamp("last_event_time").alias("last_event_time"))


@query("cln5b_timestamp_stats", f"""
  SELECT count(*) AS original_count, count(*) FILTER (last_event_time IS NULL) AS null_count,
         count(*) FILTER (last_event_time > {SQL_CLEAN_AS_OF}) AS future_count,
         count(last_event_time) AS cleaned_count, count(*) FILTER (last_event_time IS NULL) AS removed_count FROM x_dirty""")
def _(t: Inputs) -> DataFrame:
    return cl.timestamp_stats(dirty(t), "last_event_time", timestamp_lit(CLEAN_AS_OF))


@query("cln6_fill_missing", f"""
  WITH m AS (SELECT median(price) AS md FROM x_raw_items),
  o AS (SELECT tag AS mode_tag FROM x_raw_items WHERE tag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT id, {R('coalesce(price, md)')} AS price, coalesce(tag, mode_tag) AS tag,
         last_value(create_company_name IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS create_company_name,
         first_value(cover_id IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cover_id
  FROM x_raw_items, m, o""")
def _(t: Inputs) -> DataFrame:
    return cl.fill_missing(t.raw_items.select("id", "price", "tag", "create_company_name", "cover_id"), {
        "price": "median", "tag": "mode", "create_company_name": "ffill", "cover_id": "bfill"}, "id")


@query("cln6b_fill_mean_constant_drop", f"""
  SELECT id, {R('coalesce(price, (SELECT avg(price) FROM x_raw_items))')} AS price, coalesce(tag, 'none') AS tag,
         create_company_name FROM x_raw_items WHERE create_company_name IS NOT NULL""")
def _(t: Inputs) -> DataFrame:
    return cl.fill_missing(t.raw_items.select("id", "price", "tag", "create_company_name"), {
        "price": "mean", "tag": "constant:none", "create_company_name": "drop"}, "id")


@query("cln6c_missing_stats", f"""
  SELECT 'price' AS "column", count(*) FILTER (price IS NULL) AS null_count,
         {R('count(*) FILTER (price IS NULL) / count(*)')} AS null_ratio, 'mean' AS strategy FROM x_raw_items
  UNION ALL SELECT 'tag', count(*) FILTER (tag IS NULL), {R('count(*) FILTER (tag IS NULL) / count(*)')}, 'mode'
  FROM x_raw_items""")
def _(t: Inputs) -> DataFrame:
    return cl.missing_stats(t.raw_items, {"price": "mean", "tag": "mode", "dataset_name": "drop"})


TABLES["x_cleaned_inter"] = f"""
  WITH d AS (SELECT * FROM x_dirty QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id
                                                                   ORDER BY id DESC, weight DESC) = 1),
  f AS (SELECT * REPLACE (least(last_event_time, {SQL_CLEAN_AS_OF}) AS last_event_time) FROM d
        WHERE last_event_time IS NOT NULL AND weight >= 0),
  {_BOUNDS.format(c='weight', t='f')}
  SELECT id, user_id, dataset_id, least(greatest(weight, lower), upper) AS weight, last_event_time FROM f, b
  WHERE user_id IS NOT NULL AND dataset_id IS NOT NULL"""


def cleaned_interactions(t: Inputs) -> DataFrame:
    # (order, line) numbers repeat in the given data, so the weight breaks the remaining ties
    return cl.clean_interactions(dirty(t), timestamp_lit(CLEAN_AS_OF), ["id", "weight"])


@query("cln7_clean_interactions", f"""
  SELECT id, user_id, dataset_id, {R('weight')} AS weight, {TS('last_event_time')} AS last_event_time FROM x_cleaned_inter""")
def _(t: Inputs) -> DataFrame:
    return cleaned_interactions(t).withColumn("last_event_time", tx.stamp("last_event_time"))


TABLES["x_cleaned_items"] = f"""
  WITH {_BOUNDS.format(c='price', t='x_items')}
  SELECT * REPLACE (least(greatest(price, lower), upper) AS price, trim(tag) AS tag, trim(description) AS description,
                    trim(dataset_name) AS dataset_name, least(create_time, {SQL_CLEAN_AS_OF}) AS create_time)
  FROM x_items, b"""


def cleaned_items(t: Inputs) -> DataFrame:
    return cl.clean_items(items(t), timestamp_lit(CLEAN_AS_OF), ["dataset_name"])


@query("cln8_clean_items", f"""
  SELECT dataset_id, dataset_name, tag, {R('price')} AS price, {TS('create_time')} AS create_time,
         md5(description) AS description FROM x_cleaned_items""")
def _(t: Inputs) -> DataFrame:
    return cleaned_items(t).select("dataset_id", "dataset_name", "tag", "price",
                                   tx.stamp("create_time").alias("create_time"), F.md5("description").alias("description"))


@query("cln9_clean_users", """
  SELECT user_id, coalesce(company_name, 'unknown') AS company_name, coalesce(province, 'unknown') AS province,
         coalesce(city, 'unknown') AS city, is_consumption FROM x_users""")
def _(t: Inputs) -> DataFrame:
    return cl.clean_users(users(t), ["company_name"])


@query("cln10_cleaning_report", f"""
  SELECT 'interactions' AS table_name, (SELECT count(*) FROM x_dirty) AS original_count,
         count(*) AS cleaned_count, (SELECT count(*) FROM x_dirty) - count(*) AS removed_count FROM x_cleaned_inter
  UNION ALL SELECT 'dataset_features', (SELECT count(*) FROM x_items), count(*), (SELECT count(*) FROM x_items) - count(*)
  FROM x_cleaned_items
  UNION ALL SELECT 'user_profile', count(*), count(*), 0 FROM x_users""")
def _(t: Inputs) -> DataFrame:
    return cl.cleaning_report({
        "interactions": (dirty(t), cleaned_interactions(t)), "dataset_features": (items(t), cleaned_items(t)),
        "user_profile": (users(t), cl.clean_users(users(t), ["company_name"]))})


# -- windows, sets, joins ---------------------------------------------------------

def stats(t: Inputs) -> DataFrame:
    from wayfunnel.plans.features import item_stats
    return item_stats(t)


@query("win1_dense_rank", """
  SELECT dataset_id, dense_rank() OVER (ORDER BY interaction_count DESC) AS popularity_rank FROM x_stats""")
def _(t: Inputs) -> DataFrame:
    return rk.with_dense_rank(stats(t), "interaction_count", "popularity_rank").select("dataset_id", "popularity_rank")


@query("win2_percentile_rank", f"""
  SELECT dataset_id, {R('(rank() OVER (ORDER BY interaction_count) + (count(*) OVER (PARTITION BY interaction_count) - 1) / 2.0::DOUBLE) / count(*) OVER ()')} AS pct
  FROM x_stats""")
def _(t: Inputs) -> DataFrame:
    return rk.with_dense_rank(stats(t), "interaction_count", "r", "pct").select("dataset_id", "pct")


@query("win3_last_per_key", """
  SELECT user_id, id FROM x_dirty WHERE user_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_event_time DESC NULLS LAST, id DESC) = 1""")
def _(t: Inputs) -> DataFrame:
    return rl.pick(dirty(t).filter("user_id is not null"), ["user_id"],
                   [F.desc_nulls_last("last_event_time"), F.desc("id")]).select("user_id", "id")


@query("win4_top_k_per_group", """
  SELECT user_id, dataset_id, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, dataset_id) AS rank
  FROM x_inter QUALIFY rank <= 5""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.plans.features import interactions
    return rl.top_per_group(interactions(t), ["user_id"], [F.desc(F.round("weight", 9)), F.asc("dataset_id")], 5) \
        .select("user_id", "dataset_id", "rank")


@query("win5_first_n_rows", """
  SELECT dataset_id, image_key FROM x_images
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY image_order, image_key) <= 4""")
def _(t: Inputs) -> DataFrame:
    return rl.pick(t.images, ["dataset_id"], [F.asc("image_order"), F.asc("image_key")], 4).select("dataset_id", "image_key")


@query("win6_global_top_k", """
  SELECT dataset_id, interaction_count FROM x_stats ORDER BY interaction_count DESC, dataset_id LIMIT 20""")
def _(t: Inputs) -> DataFrame:
    return rl.top_overall(stats(t), [F.desc("interaction_count"), F.asc("dataset_id")], 20) \
        .select("dataset_id", "interaction_count")


@query("win7_cumulative_sum", f"""
  WITH h AS (SELECT interaction_count AS v, count(*) AS n FROM x_stats GROUP BY 1)
  SELECT v AS interaction_count, n, {I('sum(n) OVER (ORDER BY v) - n')} AS below,
         {R('sum(v * n) OVER (ORDER BY v) - v * n')} AS sum_below FROM h""")
def _(t: Inputs) -> DataFrame:
    return rk.ranked_values(stats(t), "interaction_count").select(
        F.col("interaction_count").cast("long").alias("interaction_count"), "n", "below", "sum_below")


@query("win8_share_of_total", f"""
  SELECT user_id, dataset_id, {R('CASE WHEN sum(weight) OVER (PARTITION BY user_id) <> 0 THEN weight / sum(weight) OVER (PARTITION BY user_id) ELSE 0.0 END')} AS share
  FROM x_inter""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.plans.features import interactions
    return rl.share_of_total(interactions(t), ["user_id"], "weight", "share").select("user_id", "dataset_id", "share")


@query("win9_fill_within_key", """
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER w AS previous,
         first_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER v AS following
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING),
       v AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(t: Inputs) -> DataFrame:
    lines = t.table("lineitem").withColumn("x", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return lines.select("l_orderkey", "l_linenumber",
                        rl.fill_along(lines, ["l_orderkey"], order, "x").alias("previous"),
                        rl.fill_along(lines, ["l_orderkey"], order, "x", False).alias("following"))


@query("win10_trailing_average", f"""
  WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
  SELECT CAST(day AS VARCHAR) AS day, {R('avg(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)')} AS trailing
  FROM d""")
def _(t: Inputs) -> DataFrame:
    from pyspark.sql import Window
    days = t.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-7, -1)  # one row per calendar day
    return days.select(F.col("day").cast("string").alias("day"), F.avg("n").over(w).alias("trailing"))


@query("set1_union_all_sources", "SELECT CASE WHEN is_task THEN 'task' ELSE 'api_order' END AS source, id FROM x_lines")
def _(t: Inputs) -> DataFrame:
    return rl.outer_union([t.tasks.select(F.lit("task").alias("source"), "id"),
                           t.api_orders.select(F.lit("api_order").alias("source"), "id")])


@query("set2_distinct_contexts", """
  SELECT DISTINCT request_id, dataset_id, variant, endpoint, page_id, algorithm_version FROM x_exposures""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.attribution import CONTEXT
    return t.exposures.select("request_id", "dataset_id", *CONTEXT).distinct()


@query("set3_intersect_union_sizes", f"""
  WITH a AS (SELECT id, {TAGS('tag')} AS tags, {TAGS("lag(tag) OVER (ORDER BY id)")} AS other FROM x_raw_items)
  SELECT id, len(list_intersect(tags, other)) AS common, len(list_distinct(list_concat(tags, other))) AS total
  FROM a""")
def _(t: Inputs) -> DataFrame:
    """Tags of an item against those of the item with the previous id."""
    raw = t.raw_items.select("id", split_tags("tag").alias("tags"))
    # ids are consecutive, so the previous item is an equality join rather than a one-task lag
    other = raw.select((F.col("id") + 1).alias("id"), F.col("tags").alias("other"))
    none = F.array().cast("array<string>")
    joined = raw.join(other, "id", "left").withColumn("other", F.coalesce("other", none))
    return joined.select("id", F.size(F.array_intersect("tags", "other")).alias("common"),
                         F.size(F.array_union("tags", "other")).alias("total"))


@query("set4_missing_days", """
  WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
  c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT CAST(day AS VARCHAR) AS day FROM c WHERE day NOT IN (SELECT day FROM d)""")
def _(t: Inputs) -> DataFrame:
    days = t.table("lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return rl.missing_from(rl.calendar(days, "day"), days, ["day"]).select(F.col("day").cast("string").alias("day"))


@query("set5_known_items", """
  SELECT DISTINCT dataset_id FROM (SELECT item AS dataset_id FROM x_lines UNION ALL SELECT k FROM x_events
                                   UNION ALL SELECT vec_id FROM embeddings) WHERE dataset_id IS NOT NULL""")
def _(t: Inputs) -> DataFrame:
    return rl.distinct_values([(t.order_lines, "item"), (t.events, "k"), (t.vectors, "dataset_id")], "dataset_id")


@query("jn1_left_enrichment", f"""
  SELECT i.user_id, i.dataset_id, u.province, {R('m.price')} AS price
  FROM x_inter i LEFT JOIN x_users u USING (user_id) LEFT JOIN x_items m USING (dataset_id)""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.plans.features import interactions
    return interactions(t).join(users(t), "user_id", "left").join(items(t), "dataset_id", "left") \
        .select("user_id", "dataset_id", "province", "price")


@query("jn2_exposure_click", f"""
  SELECT e.event_id, {I('coalesce(c.n, 0)')} AS clicks FROM x_exposures e
  LEFT JOIN (SELECT request_id, dataset_id, count(*) AS n FROM x_clicks GROUP BY 1, 2) c USING (request_id, dataset_id)""")
def _(t: Inputs) -> DataFrame:
    per = t.clicks.groupBy("request_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return t.exposures.join(per, ["request_id", "dataset_id"], "left").select(
        "event_id", F.coalesce("n", F.lit(0)).alias("clicks"))


@query("jn3_five_key_join", f"""
  WITH g AS (SELECT dataset_id, {", ".join(f"coalesce({c}, '') AS {c}" for c in ("variant", "endpoint", "page_id", "algorithm_version"))},
                    count(*) AS n, avg(score) AS s FROM x_exposures GROUP BY ALL)
  SELECT e.event_id, g.n, {R('g.s')} AS mean_score FROM x_exposures e
  LEFT JOIN g ON e.dataset_id = g.dataset_id AND coalesce(e.variant, '') = g.variant AND coalesce(e.endpoint, '') = g.endpoint
    AND coalesce(e.page_id, '') = g.page_id AND coalesce(e.algorithm_version, '') = g.algorithm_version""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.attribution import CONTEXT
    base = t.exposures.na.fill("", list(CONTEXT))
    keys = ["dataset_id", *CONTEXT]
    per = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return base.join(per, keys, "left").select("event_id", "n", "mean_score")


@query("jn4_full_outer", """
  WITH v AS (SELECT k AS dataset_id, count(*) AS views FROM x_events WHERE event_type = 'view' GROUP BY 1),
  c AS (SELECT k AS dataset_id, count(*) AS buys FROM x_events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT coalesce(v.dataset_id, c.dataset_id) AS dataset_id, views, buys FROM v FULL JOIN c ON v.dataset_id = c.dataset_id""")
def _(t: Inputs) -> DataFrame:
    def per(kind: str, name: str) -> DataFrame:
        kept = t.events.filter(F.col("event_type") == kind)
        return kept.groupBy(F.col("k").alias("dataset_id")).agg(F.count(F.lit(1)).alias(name))
    return per("view", "views").join(per("purchase", "buys"), "dataset_id", "full")


@query("jn5_semi_and_anti", """
  SELECT 'semi' AS kind, dataset_id FROM x_stats WHERE dataset_id IN (SELECT dataset_id FROM x_items)
  UNION ALL SELECT 'anti', dataset_id FROM x_stats WHERE dataset_id NOT IN (SELECT dataset_id FROM x_items)""")
def _(t: Inputs) -> DataFrame:
    live = items(t).select("dataset_id")
    semi = stats(t).join(live, "dataset_id", "left_semi").select(F.lit("semi").alias("kind"), "dataset_id")
    anti = stats(t).join(live, "dataset_id", "left_anti").select(F.lit("anti").alias("kind"), "dataset_id")
    return semi.union(anti)


@query("jn9_cover_image", """
  SELECT m.id AS dataset_id, (SELECT image_url FROM x_images g WHERE g.dataset_id = m.id
                              ORDER BY image_order, image_key LIMIT 1) AS cover_image
  FROM x_raw_items m""")
def _(t: Inputs) -> DataFrame:
    cover = t.images.groupBy("dataset_id").agg(
        F.min_by("image_url", F.struct("image_order", "image_key")).alias("cover_image"))
    return t.raw_items.select(F.col("id").alias("dataset_id")).join(cover, "dataset_id", "left")


@query("jn10_calendar_join", """
  WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
  c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM c LEFT JOIN d USING (day)""")
def _(t: Inputs) -> DataFrame:
    per = t.table("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = t.spark.range(1).select(F.explode(F.sequence(
        F.lit("2023-12-25").cast("date"), F.lit("2024-02-05").cast("date"))).alias("day"))
    return days.join(per, "day", "left").select(F.col("day").cast("string").alias("day"),
                                                F.coalesce("n", F.lit(0)).alias("n"))
