"""Date queries over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.catalog.registry import query, table
from crawlweave.catalog.shapes import stamp
from crawlweave.functions import dates


@query(
    "date_month",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS order_month FROM orders",
)
def date_month(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", dates.month(F.col("o_orderdate")).alias("order_month"))


@query(
    "date_str",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0
         THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def date_str(spark: SparkSession, folder: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return table(spark, folder, "orders").select("o_orderkey", dates.date_str(day).alias("day"))


@query(
    "tz_to_utc",
    """SELECT event_id, strftime(date_trunc('second',
         (ts AT TIME ZONE 'Asia/Jerusalem') AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS utc
       FROM events""",
)
def tz_to_utc(spark: SparkSession, folder: str) -> DataFrame:
    utc = dates.local_to_utc(F.col("ts"))
    return table(spark, folder, "events").select("event_id", stamp(utc).alias("utc"))


@query(
    "tz_date_to_utc",
    """SELECT o_orderkey, strftime((date_trunc('day', o_orderdate)
         AT TIME ZONE 'Asia/Jerusalem') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc
       FROM orders""",
)
def tz_date_to_utc(spark: SparkSession, folder: str) -> DataFrame:
    utc = dates.local_date_to_utc(F.col("o_orderdate"))
    return table(spark, folder, "orders").select("o_orderkey", stamp(utc).alias("utc"))


@query(
    "tz_to_local",
    """SELECT event_id, strftime(date_trunc('second',
         (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Jerusalem'), '%Y-%m-%d %H:%M:%S') AS local
       FROM events""",
)
def tz_to_local(spark: SparkSession, folder: str) -> DataFrame:
    local = dates.utc_to_local(F.col("ts"))
    return table(spark, folder, "events").select("event_id", stamp(local).alias("local"))


@query(
    "ts_iso",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events",
)
def ts_iso(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", dates.iso_utc(F.col("ts")).alias("iso")
    )


@query(
    "date_eq",
    """WITH d AS (SELECT o_orderkey,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS a,
          CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderdate + INTERVAL 1 DAY
               ELSE o_orderdate END AS b FROM orders)
       SELECT o_orderkey, a IS NOT DISTINCT FROM b AS same FROM d""",
)
def date_eq(spark: SparkSession, folder: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    a = F.when(key % 3 != 0, day)
    b = F.when(key % 4 == 1, day + F.expr("INTERVAL 1 DAY")).when(key % 4 != 0, day)
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.same_instant(a, b).alias("same")
    )
