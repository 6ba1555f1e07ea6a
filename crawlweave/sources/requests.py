"""Crawl requests: JSON bodies to typed rows, and to seed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions import records, urls
from crawlweave.schemas import REQUEST_JSON

_LIMITS = {"maxDistance": "max_distance", "maxSeconds": "max_seconds", "maxUrls": "max_urls"}


def parse_requests(bodies: DataFrame, value: str = "value") -> DataFrame:
    """Decode the JSON column; absent limits are 0. Other columns stay.

    A body that is not JSON gives a null url and zero limits.
    """
    keep = [c for c in bodies.columns if c != value]
    body = F.from_json(F.col(value), REQUEST_JSON)
    return bodies.select(*keep, body.alias("_body")).select(
        *keep,
        F.col("_body.url").alias("url"),
        *[
            F.coalesce(F.col(f"_body.{wire}"), F.lit(0)).alias(name)
            for wire, name in _LIMITS.items()
        ],
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from files of JSON lines; ids and request times come as columns."""
    lines = spark.read.text(path)
    ids = F.get_json_object("value", "$.crawlId").alias("crawl_id")
    at = F.get_json_object("value", "$.requestedAt").try_cast("timestamp").alias("requested_at")
    return parse_requests(lines.select(ids, at, "value"))


def normalize_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("url", urls.normalize(F.col("url")))


def seed_records(requests: DataFrame) -> DataFrame:
    """First frontier record of every crawl with an id and a valid URL."""
    return requests.where(F.col("crawl_id").isNotNull() & urls.is_valid(F.col("url"))).select(
        "crawl_id",
        F.lit(0).cast("bigint").alias("seq"),
        "url",
        F.col("url").alias("base_url"),
        F.lit(0).alias("distance"),
        F.col("requested_at").alias("start_time"),
        records.deadline(F.col("requested_at"), F.col("max_seconds")).alias("max_time"),
        "max_distance",
        "max_urls",
    )


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Error rows for the crawls ``seed_records`` leaves out."""
    bad = F.coalesce(~urls.is_valid(F.col("url")), F.lit(True))
    shown = F.coalesce("url", F.lit(""))
    return requests.where(bad | F.col("crawl_id").isNull()).select(
        "crawl_id",
        "url",
        F.when(bad, F.concat(F.lit(records.MSG_INVALID), shown))
        .otherwise(F.concat(F.lit(records.MSG_NO_ID), shown))
        .alias("message"),
    )
