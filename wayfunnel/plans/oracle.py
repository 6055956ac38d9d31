"""SQL side of the comparison: canonical tables as common table expressions.

Written separately from the Spark adapters and operators, in plain SQL. A body
that mentions a table below gets it (and what it depends on) prepended.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"
EVENT_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def R(expr: str, digits: int = 6) -> str:
    shift = " + 1.3e-10::DOUBLE" if digits == 6 else ""
    return f"(round(CAST({expr} AS DOUBLE){shift}, {digits}) + 0.0)"


def I(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def TS(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def DAYS(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def DIV(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


def ITEM(text: str) -> str:
    parts = [f"TRY_CAST(nullif(regexp_extract({text}, '{p}', 1), '') AS BIGINT)"
             for p in (r"dataDetail/(\d+)", r"dataAPIDetail/(\d+)", r"payment/(\d+)")]
    return f"coalesce({', '.join(parts)})"


def TAGS(c: str) -> str:
    return (f"list_filter(list_transform(string_split(lower(coalesce({c}, '')), ';'), lambda x: trim(x)), lambda x: x <> '')")


TABLES: dict[str, str] = {}

TABLES["x_raw_users"] = """
  SELECT c_custkey AS id, c_name AS user_name,
         CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS company_name,
         n_name AS province,
         CASE WHEN c_custkey % 7 <> 0 THEN n_name || '_' || (c_custkey % 5) END AS city,
         CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END END AS is_consumption,
         CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS sex,
         CASE WHEN c_custkey % 10 <> 0 THEN 1 ELSE 0 END AS is_valid
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

TABLES["x_raw_items"] = """
  SELECT p_partkey AS id, p_name AS dataset_name, text AS description,
         CASE WHEN p_partkey % 19 <> 0 THEN p_type || ';' || p_brand END AS tag,
         CASE WHEN p_partkey % 23 <> 0 THEN p_retailprice * ((p_partkey % 9) / 4.0::DOUBLE) END AS price,
         CASE WHEN p_partkey % 29 <> 0 THEN p_brand END AS create_company_name,
         CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 8 + 1 END AS cover_id,
         TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(p_partkey % 2500 AS INTEGER)) AS create_time,
         CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS is_delete
  FROM part LEFT JOIN documents ON p_partkey = doc_id"""

TABLES["x_lines"] = """
  SELECT l_orderkey * 8 + l_linenumber AS id,
         CASE WHEN l_orderkey % 101 <> 0 THEN o_custkey END AS buyer, l_partkey AS item,
         CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_extendedprice END AS price,
         l_quantity AS quantity, o_orderdate AS create_time, l_shipdate AS pay_time,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 5 ELSE 0 END AS pay_status,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_delete,
         o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS is_task
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""

TABLES["x_images"] = """
  SELECT l_partkey * 8 + l_orderkey % 8 AS id, l_orderkey * 8 + l_linenumber AS image_key,
         l_partkey AS dataset_id, CAST(l_linenumber AS BIGINT) AS image_order,
         'img/' || l_orderkey || '-' || l_linenumber AS image_url, l_shipdate AS update_time
  FROM lineitem WHERE l_returnflag = 'R'"""

TABLES["x_events"] = r"""
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) AS k FROM events"""

TABLES["x_exposures"] = """
  SELECT 'req_' || user_id AS request_id, user_id, k AS dataset_id, CAST(event_id % 10 AS INTEGER) AS position,
         value AS score, ts AS timestamp,
         CASE WHEN event_id % 7 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 'primary' ELSE 'shadow' END END AS variant,
         CASE WHEN event_id % 11 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'recommend_similar' ELSE 'recommend_detail' END END AS endpoint,
         CASE WHEN event_id % 13 <> 0 THEN CAST(k % 5 AS VARCHAR) END AS page_id,
         CASE WHEN event_id % 17 <> 0 THEN 'v' || (user_id % 3) END AS algorithm_version,
         CASE WHEN event_id % 19 <> 0 THEN CASE WHEN user_id % 4 = 0 THEN 'test' ELSE 'control' END END AS experiment_variant,
         CASE event_id % 6 WHEN 0 THEN 'behavior+content' WHEN 1 THEN 'content' WHEN 2 THEN 'vector+tag'
              WHEN 3 THEN 'fallback_popular' WHEN 4 THEN 'misc+Behavior' END AS reason,
         CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'empty' END AS degrade_reason,
         'run_' || (user_id % 2) AS model_run_id,
         CASE WHEN event_id % 9 <> 0 THEN 'snap_' || (user_id % 2) END AS feature_snapshot_id,
         CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'landing' END AS source,
         CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS device_type,
         CASE WHEN event_id % 2 = 0 THEN 'zh-cn' END AS locale, CAST(NULL AS VARCHAR) AS client_app,
         CASE event_id % 8 WHEN 0 THEN '{"behavior": 2.5, "content": 0.7}' WHEN 1 THEN 'not json' END AS channel_weights,
         event_id
  FROM x_events WHERE event_type = 'view'"""

TABLES["x_clicks"] = """
  SELECT 'req_' || user_id AS request_id, k AS dataset_id, ts AS server_time,
         CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 10 AS INTEGER) END AS position, event_id
  FROM x_events WHERE event_type = 'click'"""

TABLES["x_conversions"] = """
  SELECT CASE WHEN event_id % 2 <> 0 THEN 'req_' || user_id END AS request_id, k AS dataset_id, ts AS server_time,
         value AS revenue, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 10 AS INTEGER) END AS position, event_id
  FROM x_events WHERE event_type = 'purchase'"""

TABLES["x_log_actions"] = """
  SELECT p_partkey AS idaction,
         CASE p_partkey % 4 WHEN 0 THEN 'https://m/dataDetail/' || p_partkey
              WHEN 1 THEN 'https://m/dataAPIDetail/' || p_partkey || '?a=1'
              WHEN 2 THEN 'https://m/payment/' || p_partkey ELSE 'https://m/about' END AS name
  FROM part"""

TABLES["x_dictionary"] = f"""
  SELECT idaction, {ITEM('name')} AS item FROM x_log_actions WHERE {ITEM('name')} IS NOT NULL"""

TABLES["x_link_actions"] = """
  SELECT event_id AS idlink_va, user_id AS idvisit, ts AS server_time,
         CASE WHEN event_id % 4 = 0 THEN k END AS idaction_url,
         CASE WHEN event_id % 12 = 7 THEN k END AS idaction_name,
         CASE WHEN event_id % 12 = 11 THEN k END AS idaction_product_name,
         CASE event_id % 4
              WHEN 1 THEN 'https://m/dataDetail/' || k || '?from=recommend&rid=req_' || user_id || '&pos=' || (event_id % 10)
              WHEN 2 THEN 'https://m/payment/' || k ELSE 'https://m/home' END AS url,
         CASE WHEN event_id % 8 = 3 THEN 'https://m/dataAPIDetail/' || k END AS referer_url,
         CASE WHEN event_id % 16 = 5 THEN 'req_' || user_id || 'x' END AS d2,
         CASE event_id % 3 WHEN 0 THEN 'req_' || user_id WHEN 1 THEN '3' END AS d4,
         CASE WHEN event_id % 5 = 0 THEN 'click_' || (event_id % 10) || '_' || k END AS d5
  FROM x_events WHERE event_type <> 'purchase'"""

TABLES["x_log_conversions"] = """
  SELECT event_id AS buster, user_id AS idvisit, ts AS server_time,
         CASE WHEN event_id % 9 <> 0 THEN value END AS revenue,
         CASE WHEN event_id % 4 = 0 THEN k END AS idaction_url,
         CASE WHEN event_id % 4 = 1 THEN 'https://m/payment/' || k END AS url,
         CASE event_id % 3 WHEN 0 THEN 'req_' || user_id WHEN 1 THEN '3' END AS d4
  FROM x_events WHERE event_type = 'purchase'"""

# link actions with the parsed item, request and slot
TABLES["x_parsed_actions"] = rf"""
  SELECT a.idlink_va, a.idvisit, a.server_time,
         coalesce(m1.item, m2.item, m3.item, {ITEM('a.url')}, {ITEM('a.referer_url')}) AS row_item,
         TRY_CAST(nullif(regexp_extract(trim(d5), '^click_(\d+)_([0-9]+)', 2), '') AS BIGINT) AS meta_item,
         coalesce(TRY_CAST(nullif(regexp_extract(trim(d5), '^click_(\d+)_([0-9]+)', 1), '') AS BIGINT),
                  CASE WHEN regexp_full_match(trim(d4), '\d+') THEN CAST(trim(d4) AS BIGINT) END,
                  TRY_CAST(nullif(regexp_extract(a.url, 'pos=(\d+)', 1), '') AS BIGINT)) AS slot,
         coalesce(CASE WHEN starts_with(d4, 'req_') THEN d4 END, CASE WHEN starts_with(d2, 'req_') THEN d2 END) AS dim_request,
         nullif(regexp_extract(coalesce(a.url, ''), 'rid=([^&]+)', 1), '') AS url_request,
         contains(a.url, 'from=recommend') AS from_recommend
  FROM x_link_actions a
  LEFT JOIN x_dictionary m1 ON a.idaction_url = m1.idaction
  LEFT JOIN x_dictionary m2 ON a.idaction_name = m2.idaction
  LEFT JOIN x_dictionary m3 ON a.idaction_product_name = m3.idaction"""

TABLES["x_log_clicks"] = """
  SELECT coalesce(row_item, meta_item) AS dataset_id, coalesce(dim_request, url_request) AS request_id, server_time,
         slot AS position, idlink_va
  FROM x_parsed_actions
  WHERE (from_recommend OR dim_request IS NOT NULL) AND coalesce(row_item, meta_item) IS NOT NULL
    AND coalesce(dim_request, url_request) IS NOT NULL AND server_time IS NOT NULL"""

TABLES["x_items_full"] = """
  SELECT id AS dataset_id, dataset_name, coalesce(description, '') AS description, coalesce(tag, '') AS tag,
         coalesce(price, 0.0) AS price, coalesce(create_company_name, '') AS create_company_name, cover_id, create_time
  FROM x_raw_items WHERE is_delete = 0"""

TABLES["x_items"] = "SELECT * FROM x_items_full"

TABLES["x_users"] = """
  SELECT id AS user_id, coalesce(company_name, 'unknown') AS company_name, coalesce(province, 'unknown') AS province,
         coalesce(city, 'unknown') AS city, coalesce(TRY_CAST(is_consumption AS BIGINT), 0) AS is_consumption
  FROM x_raw_users"""

TABLES["x_inter"] = """
  SELECT buyer AS user_id, item AS dataset_id, sum(ln(1 + greatest(coalesce(price, 0.0), 0.0))) AS weight,
         max(create_time) AS last_event_time
  FROM x_lines WHERE buyer IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2"""

TABLES["x_stats"] = """
  SELECT dataset_id, count(*) AS interaction_count, sum(weight) AS total_weight, max(last_event_time) AS last_event_time
  FROM x_inter GROUP BY 1"""

TABLES["x_item_tags"] = f"""
  SELECT DISTINCT dataset_id, unnest({TAGS('tag')}) AS tag FROM x_items"""


def with_tables(body: str) -> str:
    """Prepend the common table expressions that ``body`` uses, in dependency order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(TABLES[name])
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in TABLES.items() if name in needed)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
