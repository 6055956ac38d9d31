"""Queries for data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import Inputs
from wayfunnel.functions.common import timestamp_lit
from wayfunnel.operators import quality as dq
from wayfunnel.operators import ranks as rk
from wayfunnel.operators.cleaning import iqr_flag, zscore_flag
from wayfunnel.operators.funnel import item_labels
from wayfunnel.plans import features as pf
from wayfunnel.plans import funnel as pfun
from wayfunnel.plans import recall as pr
from wayfunnel.plans import tables as pt
from wayfunnel.plans.oracle import DIV, I, R, TABLES
from wayfunnel.plans.registry import query
from wayfunnel.schemas import ColumnRule, Contract

USER_CONTRACT = Contract("business", "user", ("id",), (
    ColumnRule("id", "integer"),
    ColumnRule("company_name", "string", nullable=True),
    ColumnRule("province", "string"),
    ColumnRule("city", "string"),
    ColumnRule("is_consumption", "integer", nullable=True),
    ColumnRule("create_time", "datetime"),
))
TASK_CONTRACT = Contract("business", "task", ("id",), (
    ColumnRule("id", "integer"),
    ColumnRule("create_user", "integer"),
    ColumnRule("dataset_id", "integer"),
    ColumnRule("price", "float"),
))
VISIT_CONTRACT = Contract("matomo", "matomo_log_visit", ("idvisit",), (
    ColumnRule("idvisit", "integer"),
))
CHECKED = (USER_CONTRACT, TASK_CONTRACT, VISIT_CONTRACT)


def violations(t: Inputs) -> DataFrame:
    return dq.validate_contracts(t.spark, {"user": t.raw_users, "task": t.tasks, "matomo_log_visit": None}, CHECKED)


@query("dq1_table_rules", """
  SELECT 'user' AS table_name, count(*) AS row_count, 'create_time' AS missing_columns, 'fail' AS status FROM x_raw_users
  UNION ALL SELECT 'dataset', count(*), '', 'pass' FROM x_raw_items
  UNION ALL SELECT 'task', count(*), '', CASE WHEN count(*) < 100000000 THEN 'fail' ELSE 'pass' END FROM x_lines WHERE is_task
  UNION ALL SELECT 'visit', 0, '', 'missing'""")
def _(t: Inputs) -> DataFrame:
    return dq.table_rules({"user": t.raw_users, "dataset": t.raw_items, "task": t.tasks, "visit": None}, {
        "user": (["id", "create_time"], 1), "dataset": (["id", "dataset_name"], 1), "task": (["id"], 100_000_000),
        "visit": (["idvisit"], 1)})


TABLES["x_violations"] = """
  WITH u AS (SELECT count(*) AS n, count(*) FILTER (city IS NULL) AS c FROM x_raw_users),
  k AS (SELECT count(*) AS n, count(*) FILTER (create_user IS NULL) AS u, count(*) FILTER (price IS NULL) AS p, count(*) - count(DISTINCT id) AS d
        FROM (SELECT *, buyer AS create_user FROM x_lines WHERE is_task))
  SELECT 'business' AS source, 'user' AS table_name, 'city' AS "column", 'nulls' AS "check", 'error' AS severity, c / CAST(n AS DOUBLE) AS value FROM u
  UNION ALL SELECT 'business', 'user', 'is_consumption', 'type_mismatch', 'warning', NULL
  UNION ALL SELECT 'business', 'user', 'create_time', 'missing_column', 'error', NULL
  UNION ALL SELECT 'business', 'task', 'create_user', 'nulls', CASE WHEN u / CAST(n AS DOUBLE) > 0.01 THEN 'error' ELSE 'warning' END, u / CAST(n AS DOUBLE) FROM k WHERE u > 0
  UNION ALL SELECT 'business', 'task', 'price', 'nulls', CASE WHEN p / CAST(n AS DOUBLE) > 0.01 THEN 'error' ELSE 'warning' END, p / CAST(n AS DOUBLE) FROM k WHERE p > 0
  UNION ALL SELECT 'business', 'task', 'id', 'key_duplicates', 'error', CAST(d AS DOUBLE) FROM k WHERE d > 0
  UNION ALL SELECT 'matomo', 'matomo_log_visit', NULL, 'missing_table', 'error', NULL"""


@query("dq2_contract_columns", f"""
  SELECT source, table_name, "column", "check", severity, {R('value')} AS value FROM x_violations
  WHERE "check" IN ('missing_column', 'type_mismatch', 'nulls')""")
def _(t: Inputs) -> DataFrame:
    return violations(t).filter(F.col("check").isin("missing_column", "type_mismatch", "nulls"))


@query("dq3_contract_keys", f"""
  SELECT source, table_name, "column", "check", severity, {R('value')} AS value FROM x_violations WHERE starts_with("check", 'key')""")
def _(t: Inputs) -> DataFrame:
    return dq.contract_violations(t.tasks, TASK_CONTRACT).filter(F.col("check").startswith("key"))


TABLES["x_contract_status"] = """
  SELECT source, table_name, count(*) AS violations, count(*) FILTER (severity = 'error') = 0 AS passed FROM x_violations GROUP BY 1, 2"""


@query("dq4_contract_status", "SELECT * FROM x_contract_status")
def _(t: Inputs) -> DataFrame:
    return dq.contract_status(violations(t), CHECKED)


@query("dq5_null_ratios", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {R(f'count(*) FILTER ({c} IS NULL) / CAST(count(*) AS DOUBLE)')} AS null_ratio,
        count(*) FILTER ({c} IS NULL) / CAST(count(*) AS DOUBLE) > 0.05 AS is_high FROM x_dirty"""
    for c in ("id", "user_id", "dataset_id", "weight", "last_event_time")))
def _(t: Inputs) -> DataFrame:
    return dq.null_ratios(pt.dirty(t), 0.05)


@query("dq6_duplicate_count", f"""
  SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, dataset_id FROM x_dirty)) AS duplicate_count,
         {R('1 - (SELECT count(*) FROM (SELECT DISTINCT user_id, dataset_id FROM x_dirty)) / CAST(count(*) AS DOUBLE)')} AS duplicate_ratio FROM x_dirty""")
def _(t: Inputs) -> DataFrame:
    return dq.duplicate_count(pt.dirty(t), ["user_id", "dataset_id"])


def _concentration(source: str, key: str) -> str:
    return f"""(SELECT 2 * sum((n - i) * c) / (max(n) * sum(c)) FROM (SELECT c, row_number() OVER (ORDER BY c) AS i, count(*) OVER () AS n
      FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {source} WHERE {key} IS NOT NULL GROUP BY {key})))"""


@query("dq7_concentration", f"""
  WITH a AS (SELECT {_concentration('x_dirty', 'user_id')} AS w, (SELECT count(DISTINCT user_id) FROM x_dirty) AS n)
  SELECT {R('w')} AS as_written, {R('1 - 1.0::DOUBLE / n - w')} AS gini FROM a""")
def _(t: Inputs) -> DataFrame:
    per = pt.dirty(t).filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rk.concentration(per, "n")


@query("dq8_price_anomalies", """
  WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, avg(price) AS m, stddev_pop(price) AS d FROM x_raw_items)
  SELECT id, coalesce(price < q1 - 0.2 * (q3 - q1) OR price > q3 + 0.2 * (q3 - q1), false) AS iqr_outlier,
         coalesce(abs(price - m) / d > 1.5, false) AS z_outlier FROM x_raw_items, q""")
def _(t: Inputs) -> DataFrame:
    flagged = iqr_flag(t.raw_items.select("id", "price"), "price", 0.2, "iqr_outlier")
    return zscore_flag(flagged, "price", 1.5, "z_outlier").select("id", "iqr_outlier", "z_outlier")


@query("dq9_date_completeness", f"""
  WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
  c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
  m AS (SELECT day FROM c WHERE day NOT IN (SELECT day FROM d))
  SELECT (SELECT count(*) FROM m) = 0 AS complete, (SELECT count(*) FROM m) AS missing_periods, count(*) AS total_expected,
         {R('1 - (SELECT count(*) FROM m) / CAST(count(*) AS DOUBLE)')} AS completeness_ratio,
         CAST(min(day) AS VARCHAR) || ' to ' || CAST(max(day) AS VARCHAR) AS date_range,
         (SELECT coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day), '') FROM (SELECT day FROM m ORDER BY day LIMIT 10)) AS missing_dates FROM c""")
def _(t: Inputs) -> DataFrame:
    return dq.date_completeness(t.table("lineitem"), "l_shipdate")


TABLES["x_q_inter"] = f"""
  WITH a AS (SELECT count(*) AS n, (avg((id IS NULL)::INT) + avg((user_id IS NULL)::INT) + avg((dataset_id IS NULL)::INT)
                    + avg((weight IS NULL)::INT) + avg((last_event_time IS NULL)::INT)) / 5 AS nulls,
                    count(*) FILTER (weight < 0) + count(*) FILTER (last_event_time > {pt.SQL_CLEAN_AS_OF}) AS anomalies,
                    count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, dataset_id FROM x_dirty)) AS dups,
                    count(DISTINCT user_id) AS users, count(DISTINCT dataset_id) AS items FROM x_dirty)
  SELECT 'interactions' AS table_name, n AS row_count, dups AS duplicate_count, dups / CAST(n AS DOUBLE) AS duplicate_ratio, anomalies AS anomaly_count,
         greatest(0, least(100, 100 - 50 * nulls - 30 * dups / CAST(n AS DOUBLE) - 100 * anomalies / CAST(n AS DOUBLE))) AS quality_score,
         {_concentration('x_dirty', 'user_id')} AS user_concentration, {_concentration('x_dirty', 'dataset_id')} AS item_concentration,
         users AS unique_users, items AS unique_items FROM a"""
_GRADE = "CASE WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 75 THEN 'good' WHEN {0} >= 50 THEN 'fair' ELSE 'poor' END"


def q_interactions(t: Inputs) -> DataFrame:
    return dq.interactions_quality(pt.dirty(t), timestamp_lit(pt.CLEAN_AS_OF))


@query("dq10_interactions_quality", f"""
  SELECT table_name, row_count, duplicate_count, {R('duplicate_ratio')} AS duplicate_ratio, anomaly_count, {R('quality_score')} AS quality_score,
         {_GRADE.format('quality_score')} AS status, {R('user_concentration')} AS user_concentration,
         {R('item_concentration')} AS item_concentration, unique_users, unique_items FROM x_q_inter""")
def _(t: Inputs) -> DataFrame:
    return q_interactions(t).select("table_name", "row_count", "duplicate_count", "duplicate_ratio", "anomaly_count", "quality_score",
                                    "status", "user_concentration", "item_concentration", "unique_users", "unique_items")


TABLES["x_q_items"] = """
  WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM x_raw_items),
  a AS (SELECT count(*) AS n, (avg((description IS NULL)::INT) + avg((tag IS NULL)::INT) + avg((price IS NULL)::INT)) / 4 AS nulls,
               avg((trim(coalesce(description, '')) = '')::INT) AS empty_description, avg((trim(coalesce(tag, '')) = '')::INT) AS empty_tag,
               count(*) FILTER (price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1)) AS anomalies FROM x_raw_items, q)
  SELECT 'dataset_features' AS table_name, n AS row_count, 0 AS duplicate_count, 0.0::DOUBLE AS duplicate_ratio, anomalies AS anomaly_count,
         greatest(0, least(100, 100 - 50 * nulls)) AS quality_score, empty_description, empty_tag FROM a"""


def q_items(t: Inputs) -> DataFrame:
    return dq.items_quality(t.raw_items.select(F.col("id").alias("dataset_id"), "description", "tag", "price"))


@query("dq11_items_quality", f"""
  SELECT table_name, row_count, duplicate_count, anomaly_count, {R('quality_score')} AS quality_score, {_GRADE.format('quality_score')} AS status,
         {R('empty_description')} AS empty_description, {R('empty_tag')} AS empty_tag FROM x_q_items""")
def _(t: Inputs) -> DataFrame:
    return q_items(t).select("table_name", "row_count", "duplicate_count", "anomaly_count", "quality_score", "status",
                             "empty_description", "empty_tag")


TABLES["x_q_users"] = """
  SELECT 'user_profile' AS table_name, count(*) AS row_count, 0 AS duplicate_count, 0.0::DOUBLE AS duplicate_ratio, 0 AS anomaly_count,
         100 - 50 * (avg((company_name IS NULL)::INT) + avg((city IS NULL)::INT)) / 3 AS quality_score FROM x_raw_users"""


def q_users(t: Inputs) -> DataFrame:
    return dq.users_quality(t.raw_users.select(F.col("id").alias("user_id"), "company_name", "city"))


@query("dq12_users_quality", f"""
  SELECT table_name, row_count, duplicate_count, {R('quality_score')} AS quality_score, {_GRADE.format('quality_score')} AS status FROM x_q_users""")
def _(t: Inputs) -> DataFrame:
    return q_users(t).select("table_name", "row_count", "duplicate_count", "quality_score", "status")


def report(t: Inputs) -> DataFrame:
    return dq.quality_report([q_interactions(t), q_items(t), q_users(t)])


TABLES["x_q_all"] = " UNION ALL ".join(
    f"SELECT table_name, row_count, duplicate_count, anomaly_count, quality_score FROM {x}" for x in ("x_q_inter", "x_q_items", "x_q_users"))


@query("dq13_quality_report", f"""
  SELECT table_name, row_count, {R('quality_score')} AS quality_score, {_GRADE.format('quality_score')} AS status,
         {R('avg(quality_score) OVER ()')} AS overall_score, {_GRADE.format('avg(quality_score) OVER ()')} AS overall_status FROM x_q_all""")
def _(t: Inputs) -> DataFrame:
    return report(t).select("table_name", "row_count", "quality_score", "status", "overall_score", "overall_status")


@query("dq14_processed_gate", """
  SELECT 'interactions' AS table_name, count(*) AS row_count, '' AS missing_columns, 'pass' AS status FROM x_inter
  UNION ALL SELECT 'dataset_stats', count(*), '', 'pass' FROM x_stats""")
def _(t: Inputs) -> DataFrame:
    """Raises when a processed table is empty or lacks columns."""
    return dq.require_pass(dq.table_rules({"interactions": pf.interactions(t), "dataset_stats": pf.item_stats(t)}, {
        "interactions": (["user_id", "dataset_id", "weight"], 1), "dataset_stats": (["dataset_id"], 1)}))


@query("dq15_training_readiness", f"""
  SELECT (SELECT count(*) FROM x_exposures) AS exposures_rows, (SELECT count(DISTINCT request_id) FROM x_exposures) AS exposures_request_ids,
         (SELECT count(*) FROM x_clicks) AS click_rows, (SELECT count(DISTINCT request_id) FROM x_clicks) AS click_request_ids,
         count(*) AS label_rows, {I('sum(label)')} AS positive_datasets, (SELECT count(*) FROM x_slot_metrics) AS slot_metric_rows,
         CASE WHEN sum(label) < 5 THEN 'too few positive items' ELSE '' END AS warnings, '' AS errors FROM x_item_labels""")
def _(t: Inputs) -> DataFrame:
    labels = item_labels(pfun.samples(t), t.conversions)
    return dq.training_readiness(t.exposures, t.clicks, labels, pfun.first_events(t)["recommend_slot_metrics"])


@query("dq16_popular_audit", """
  SELECT p.dataset_id, CASE WHEN m.price < 1.0 OR m.interaction_count < 50 OR m.days_since_last_purchase > 180 THEN 'low' ELSE 'high' END AS quality
  FROM x_popular p JOIN x_item_features m USING (dataset_id)""")
def _(t: Inputs) -> DataFrame:
    return dq.popular_audit(pr.popular(t).select("dataset_id"), pf.item_features(t))[0].select("dataset_id", "quality")


@query("dq16b_popular_distribution", f"""
  WITH j AS (SELECT m.* FROM x_popular p JOIN x_item_features m USING (dataset_id))
  SELECT count(*) AS items, {R('min(price)')} AS price_min, {R('max(price)')} AS price_max, {R('avg(price)')} AS price_mean,
         {R('quantile_cont(price, 0.5)')} AS price_median, {R('greatest(1, quantile_cont(price, 0.25))')} AS rule_price,
         {R('greatest(50, quantile_cont(interaction_count, 0.25))')} AS rule_interactions FROM j""")
def _(t: Inputs) -> DataFrame:
    return dq.popular_audit(pr.popular(t).select("dataset_id"), pf.item_features(t))[1].select(
        "items", "price_min", "price_max", "price_mean", "price_median", "rule_price", "rule_interactions")


@query("dq17_required_fields", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS missing, count(*) AS total, count(*) FILTER ({c} IS NULL) = 0 AS ok FROM x_exposures"
    for c in ("request_id", "algorithm_version", "timestamp", "dataset_id")))
def _(t: Inputs) -> DataFrame:
    return dq.required_fields(t.exposures, ["request_id", "algorithm_version", "timestamp", "dataset_id"])


@query("dq18_explained_variance")
def _(t: Inputs) -> DataFrame:
    return dq.components_for(dq.explained_variance(t.vectors, "embedding", 64))


@query("dq19_reconstruction_error")
def _(t: Inputs) -> DataFrame:
    return dq.reconstruction_error(t.vectors, "embedding", [4, 16, 32])


@query("dq20_table_profile", f"""
  SELECT count(*) AS total_records, count(*) FILTER (user_id IS NULL) AS null_user_id, count(*) FILTER (weight IS NULL) AS null_weight,
         {R('min(weight)')} AS value_min, {R('max(weight)')} AS value_max, {R('avg(weight)')} AS value_mean, {R('stddev_samp(weight)', 4)} AS value_std,
         count(DISTINCT user_id) AS unique_users, count(DISTINCT dataset_id) AS unique_items FROM x_dirty""")
def _(t: Inputs) -> DataFrame:
    out = dq.table_profile(pt.dirty(t).select("user_id", "dataset_id", "weight"), "weight", "user_id", "dataset_id")
    return out.drop("null_dataset_id").withColumn("value_std", F.round("value_std", 4))


@query("dq21_system_stats", """
  SELECT count(*) AS total_records, count(DISTINCT user_id) AS unique_users, count(DISTINCT item_id) AS unique_items FROM x_paid""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.plans.sqlviews import paid_interactions
    return paid_interactions(t).agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct("user_id").alias("unique_users"),
                                    F.count_distinct("item_id").alias("unique_items"))


@query("dq22_source_freshness", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {R(f'''(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max({c}))) / 3.6e9''')} AS age_hours, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max({c}))) / 3.6e9 > 48 AS is_stale FROM {s}"
    for n, c, s in (("actions", "server_time", "x_link_actions"), ("orders", "create_time", "x_lines"))))
def _(t: Inputs) -> DataFrame:
    return dq.freshness_check({"actions": (t.log_link_actions, "server_time"), "orders": (t.order_lines, "create_time")},
                              timestamp_lit("2024-02-01 00:00:00"))


@query("snk14_gauge_lines", f"""
  WITH a AS (SELECT 'warning' AS severity FROM x_q_inter WHERE user_concentration > 0.8 UNION ALL SELECT 'warning' FROM x_q_inter WHERE item_concentration > 0.8
             UNION ALL SELECT 'error' FROM x_q_inter WHERE duplicate_ratio > 0.05 UNION ALL SELECT severity FROM x_violations)
  SELECT 'data_quality_score{{table="' || table_name || '"}} ' || format('{{:.3f}}', quality_score) AS line FROM x_q_all
  UNION ALL SELECT 'data_quality_anomalies{{table="' || table_name || '"}} ' || anomaly_count FROM x_q_all
  UNION ALL SELECT 'data_quality_alerts{{severity="' || severity || '"}} ' || count(*) FROM a GROUP BY severity
  UNION ALL SELECT 'data_schema_contract_status{{table="' || source || '.' || table_name || '"}} ' || CASE WHEN passed THEN 1 ELSE 0 END FROM x_contract_status
  UNION ALL SELECT 'data_schema_contract_violations{{table="' || source || '.' || table_name || '"}} ' || violations FROM x_contract_status""")
def _(t: Inputs) -> DataFrame:
    found = violations(t)
    return dq.gauge_lines(report(t), dq.quality_alerts(q_interactions(t), found), dq.contract_status(found, CHECKED))
