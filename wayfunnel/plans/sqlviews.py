"""The relational statements of the service, as Spark SQL over named views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import Inputs
from wayfunnel.functions.text import stamp
from wayfunnel.plans.oracle import R, TS
from wayfunnel.plans.registry import query

PAID_INTERACTIONS = """
SELECT create_user AS user_id, dataset_id AS item_id, price, CAST(1 AS DOUBLE) AS quantity, pay_status, create_time,
       coalesce(pay_time, create_time) AS event_time, 'dataset_order' AS source
FROM {tasks}
WHERE is_delete = 0 AND dataset_id IS NOT NULL AND create_user IS NOT NULL AND pay_status IN (1, 5)
UNION ALL
SELECT creator_id, api_id, price, coalesce(frequency, CAST(1 AS DOUBLE)), pay_status, create_time,
       coalesce(pay_time, create_time), 'api_order'
FROM {api_orders}
WHERE is_delete = 0 AND api_id IS NOT NULL AND creator_id IS NOT NULL AND pay_status = 1
"""


def paid_interactions(t: Inputs) -> DataFrame:
    """Paid orders of both tables with a common shape; filters reach both scans."""
    return t.spark.sql(PAID_INTERACTIONS, tasks=t.tasks, api_orders=t.api_orders)


def live_items(t: Inputs) -> DataFrame:
    return t.spark.sql("""
        SELECT i.id AS item_id, i.dataset_name AS title, i.description, i.tag, i.price, i.create_company_name,
               i.create_time, c.cover_image
        FROM {items} i
        LEFT JOIN (SELECT dataset_id, min_by(image_url, struct(image_order, image_key)) AS cover_image
                   FROM {images} GROUP BY dataset_id) c ON c.dataset_id = i.id
        WHERE i.is_delete = 0""", items=t.raw_items, images=t.images)


def valid_users(t: Inputs) -> DataFrame:
    return t.spark.sql("""
        SELECT id AS user_id, user_name, company_name, province, city, is_consumption, sex
        FROM {users} WHERE is_valid = 1""", users=t.raw_users)


@query("sql1_paid_interactions", f"""
  SELECT user_id, item_id, {R('price')} AS price, {R('quantity')} AS quantity, {TS('event_time')} AS event_time, source
  FROM x_paid""")
def _(t: Inputs) -> DataFrame:
    return paid_interactions(t).select("user_id", "item_id", "price", "quantity",
                                       stamp("event_time").alias("event_time"), "source")


@query("sql2_interactions_of_user", f"""
  SELECT item_id, {R('price')} AS price, {TS('event_time')} AS event_time, source FROM x_paid WHERE user_id = 7""")
def _(t: Inputs) -> DataFrame:
    """The per-user form of the statement (one bound user id)."""
    return t.spark.sql("SELECT item_id, price, event_time, source FROM {paid} WHERE user_id = :user",
                       args={"user": 7}, paid=paid_interactions(t)).withColumn("event_time", stamp("event_time"))


@query("sql3_interactions_with_items_and_users", f"""
  SELECT p.user_id, p.item_id, {R('p.price')} AS price, {R('p.quantity')} AS quantity, {TS('p.event_time')} AS event_time,
         p.source, i.dataset_name AS title, {R('i.price')} AS item_price, u.user_name, u.company_name
  FROM x_paid p LEFT JOIN x_raw_items i ON p.item_id = i.id AND i.is_delete = 0
  LEFT JOIN x_raw_users u ON p.user_id = u.id AND u.is_valid = 1""")
def _(t: Inputs) -> DataFrame:
    return t.spark.sql("""
        SELECT p.user_id, p.item_id, p.price, p.quantity, p.event_time, p.source, i.title, i.price AS item_price,
               u.user_name, u.company_name
        FROM {paid} p
        LEFT JOIN (SELECT id AS item_id, dataset_name AS title, price FROM {items} WHERE is_delete = 0) i
          ON p.item_id = i.item_id
        LEFT JOIN (SELECT id AS user_id, user_name, company_name FROM {users} WHERE is_valid = 1) u
          ON p.user_id = u.user_id""", paid=paid_interactions(t), items=t.raw_items, users=t.raw_users) \
        .withColumn("event_time", stamp("event_time"))


@query("sql4_popular_items", f"""
  SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS unique_users,
         {R('sum(coalesce(price, 0) * coalesce(quantity, 1))', 2)} AS total_revenue, {TS('max(event_time)')} AS last_interaction
  FROM x_paid GROUP BY 1 ORDER BY interaction_count DESC, total_revenue DESC, item_id LIMIT 100""")
def _(t: Inputs) -> DataFrame:
    return t.spark.sql("""
        SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS unique_users,
               round(sum(coalesce(price, 0) * coalesce(quantity, 1)), 2) AS total_revenue,
               max(event_time) AS last_interaction
        FROM {paid} GROUP BY item_id
        ORDER BY interaction_count DESC, total_revenue DESC, item_id LIMIT 100""", paid=paid_interactions(t)) \
        .withColumn("last_interaction", stamp("last_interaction"))


@query("sql5_cold_start_users", """
  SELECT user_id, count(*) AS interaction_count FROM x_paid GROUP BY 1 HAVING count(*) < 5""")
def _(t: Inputs) -> DataFrame:
    return t.spark.sql("""SELECT user_id, count(*) AS interaction_count FROM {paid} GROUP BY user_id
                          HAVING count(*) < 5""", paid=paid_interactions(t))


@query("sql5b_cold_start_items", """
  SELECT item_id, count(*) AS interaction_count FROM x_paid GROUP BY 1 HAVING count(*) < 5""")
def _(t: Inputs) -> DataFrame:
    return t.spark.sql("""SELECT item_id, count(*) AS interaction_count FROM {paid} GROUP BY item_id
                          HAVING count(*) < 5""", paid=paid_interactions(t))


@query("sql6_item_features", f"""
  SELECT id AS item_id, dataset_name AS title, md5(description) AS description, tag, {R('price')} AS price,
         create_company_name, {TS('create_time')} AS create_time,
         (SELECT image_url FROM x_images g WHERE g.dataset_id = m.id ORDER BY image_order, image_key LIMIT 1) AS cover_image
  FROM x_raw_items m WHERE is_delete = 0""")
def _(t: Inputs) -> DataFrame:
    return live_items(t).withColumns({"description": F.md5("description"), "create_time": stamp("create_time")})


@query("sql7_user_features", """
  SELECT id AS user_id, user_name, company_name, province, city, is_consumption, CAST(sex AS BIGINT) AS sex
  FROM x_raw_users WHERE is_valid = 1""")
def _(t: Inputs) -> DataFrame:
    return valid_users(t)
