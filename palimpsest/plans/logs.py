"""Test tables as change logs: the inputs of the query catalogue, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.formats import read_table

#: Events as a log: every tenth a delete, three of ten merges; keys repeat.
EVENT_LOG_SQL = """
log AS (
    SELECT user_id, event_type, event_id + 1 AS seq, 0 AS op_index,
           CASE WHEN event_id % 10 = 0 THEN 'delete' WHEN event_id % 10 IN (1, 2, 3) THEN 'merge' ELSE 'put' END AS kind,
           CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 97 END AS amount,
           CASE WHEN event_id % 10 = 0 OR event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS active,
           CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'e' || event_id END AS note
    FROM events
)"""

#: Line items as commits of orders: an order is a commit, its lines the operations, its parts the keys.
ITEM_LOG_SQL = """
items AS (
    SELECT l_suppkey, l_orderkey AS seq, op_index, kind, quantity FROM (
        SELECT l_suppkey, l_orderkey, CAST(l_quantity AS BIGINT) AS quantity,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS op_index,
               CASE WHEN l_linenumber % 5 = 0 THEN 'delete' ELSE 'put' END AS kind
        FROM lineitem)
)"""

#: Orders of a customer as changes of one row: before is the order before.
CDC_SQL = """
cdc AS (
    SELECT o_orderkey AS event_id, o_custkey AS id,
           lag(o_orderstatus) OVER w AS before_status, lag(o_orderpriority) OVER w AS before_priority,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS after_status,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS after_priority,
           CASE WHEN o_orderkey % 11 = 0 THEN 'd' WHEN lag(o_orderkey) OVER w IS NULL THEN 'c' ELSE 'u' END AS op,
           o_orderkey % 23 = 0 AS tombstone
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
)"""


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    m = F.col("event_id") % 10
    gone = m == 0
    return e.select(
        "user_id", "event_type", (F.col("event_id") + 1).alias("seq"), F.lit(0).alias("op_index"),
        F.when(gone, "delete").when(m.isin(1, 2, 3), "merge").otherwise("put").alias("kind"),
        F.when(~gone, F.col("event_id") % 97).alias("amount"),
        F.when(~gone & (F.col("event_id") % 3 != 0), F.col("event_id") % 2 == 0).alias("active"),
        F.when(~gone, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("note"),
    )


def item_log(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    items = read_table(spark, folder, "lineitem").withColumn("op_index", F.row_number().over(w) - 1)
    return items.select(
        "l_suppkey", F.col("l_orderkey").alias("seq"), "op_index",
        F.when(F.col("l_linenumber") % 5 == 0, "delete").otherwise("put").alias("kind"), F.col("l_quantity").cast("long").alias("quantity"),
    )


def cdc_events(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    image = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    gone = F.col("o_orderkey") % 11 == 0
    before = F.lag(image).over(w)
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("id"), F.struct(F.col("o_custkey").alias("id")).alias("primary_key"),
        before.alias("before"), F.when(~gone, image).alias("after"),
        F.when(gone, "d").when(before.isNull(), "c").otherwise("u").alias("op"),
        (F.col("o_orderkey") % 23 == 0).alias("tombstone"), F.lit("false").alias("snapshot"),
    )
