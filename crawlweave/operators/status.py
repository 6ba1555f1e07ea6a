"""Per-crawl counts, status rows and changes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.functions import records
from crawlweave.schemas import STATUS_JSON

#: Two status rows with equal values here count as the same status.
STATUS_IDENTITY = ("distance", "start_time", "num_pages", "stop_reason", "last_modified")


def visited_count(visited: DataFrame) -> DataFrame:
    """Distinct URLs per crawl.

    Two plain aggregates: the first spreads a large crawl over all tasks by URL,
    the second only adds up counts.
    """
    return (
        visited.select("crawl_id", "url")
        .groupBy("crawl_id", "url")
        .agg(F.lit(1).alias("_one"))
        .groupBy("crawl_id")
        .agg(F.count("*").alias("num_pages"))
    )


def status_latest(log: DataFrame) -> DataFrame:
    """Last write wins by ``seq``; the first start and the latest write time stay."""
    final = F.max_by(F.struct("distance", "stop_reason", "error_message"), "seq")
    return (
        log.groupBy("crawl_id")
        .agg(
            final.alias("_f"),
            F.min("at").alias("start_time"),
            F.max("at").alias("last_modified"),
        )
        .select("crawl_id", "_f.*", "start_time", "last_modified")
    )


def status_view(
    crawls: DataFrame, status: DataFrame, counts: DataFrame, now: Column
) -> DataFrame:
    """One row per crawl asked for, with the live page count.

    An unknown crawl has zeros and starts ``now``.
    """
    known = records.known_stop_reason(F.col("stop_reason"))
    return (
        crawls.select("crawl_id")
        .join(status.drop("num_pages"), "crawl_id", "left")
        .join(counts, "crawl_id", "left")
        .select(
            "crawl_id",
            F.coalesce("distance", F.lit(0)).alias("distance"),
            F.coalesce("start_time", now).alias("start_time"),
            F.coalesce("num_pages", F.lit(0)).cast("bigint").alias("num_pages"),
            known.alias("stop_reason"),
            "error_message",
            "last_modified",
        )
    )


def unknown_stop_reasons(status: DataFrame) -> DataFrame:
    """Status rows whose stop reason is none of the known names."""
    known = records.known_stop_reason(F.col("stop_reason"))
    return status.where(F.col("stop_reason").isNotNull() & known.isNull())


def decode_status(store: DataFrame, value: str = "value") -> DataFrame:
    """Status rows from stored JSON; text that does not decode gives nulls."""
    return store.select("crawl_id", F.from_json(F.col(value), STATUS_JSON).alias("_s")).select(
        "crawl_id",
        F.col("_s.distance").alias("distance"),
        F.timestamp_millis("_s.startTimeMillis").alias("start_time"),
        F.col("_s.numPages").cast("bigint").alias("num_pages"),
        F.col("_s.stopReason").alias("stop_reason"),
        F.col("_s.errorMessage").alias("error_message"),
        F.timestamp_millis("_s.lastModifiedMillis").alias("last_modified"),
    )


def encode_status(status: DataFrame) -> DataFrame:
    """Stored JSON of each status row, null fields left out."""
    wire = F.struct(
        "distance",
        F.unix_millis("start_time").alias("startTimeMillis"),
        F.col("num_pages").cast("int").alias("numPages"),
        F.col("stop_reason").alias("stopReason"),
        F.col("error_message").alias("errorMessage"),
        F.unix_millis("last_modified").alias("lastModifiedMillis"),
    )
    return status.select("crawl_id", F.to_json(wire).alias("value"))


def with_start_time(frontier: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """Records with their crawl's start time, ``now`` where there is no status."""
    starts = status.select("crawl_id", F.col("start_time").alias("status_start"))
    return (
        frontier.join(starts, "crawl_id", "left")
        .withColumn("started", F.coalesce("status_start", now))
        .drop("status_start")
    )


def without_crawls(rows: DataFrame, starting: DataFrame) -> DataFrame:
    """Rows of a visited or status table less those of crawls that start anew."""
    return rows.join(starting.select("crawl_id").distinct(), "crawl_id", "left_anti")


def reset_status(status: DataFrame, starting: DataFrame, now: Column) -> DataFrame:
    """The store after ``starting`` crawls began: their rows replaced by zero rows."""
    ids = starting.select("crawl_id").distinct()
    fresh = ids.select(
        "crawl_id",
        F.lit(0).alias("distance"),
        now.alias("start_time"),
        F.lit(0).cast("bigint").alias("num_pages"),
        F.lit(None).cast("string").alias("stop_reason"),
        F.lit(None).cast("string").alias("error_message"),
        now.alias("last_modified"),
    )
    return without_crawls(status, ids).unionByName(fresh)


def status_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before, the error text aside.

    ``snapshots`` holds one row per crawl and ``day``; a crawl has as many rows
    as days it ran, so the window per crawl stays small.
    """
    now = F.struct(*STATUS_IDENTITY)
    earlier = F.lag(now).over(W.partitionBy("crawl_id").orderBy("day"))
    return (
        snapshots.withColumn("_before", earlier)
        .where(~F.col("_before").eqNullSafe(now))
        .drop("_before")
    )
