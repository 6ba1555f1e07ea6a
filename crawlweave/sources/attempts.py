"""Timed fetch attempts against what was observed of each URL over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.operators.ordering import latest_as_of

# Tries per URL, and the wait after the first failure, which doubles.
TRIES = 3
FIRST_WAIT_MICROS = 1_000_000

#: Not a fixed value: the error of a try before the first observation.
UNSEEN = "Not observed yet"


def fetch_attempts(asks: DataFrame, observed: DataFrame) -> DataFrame:
    """``ask_id, url, attempts, fetched_at, page_id, error`` of each ask.

    ``asks(ask_id, url, asked_at)``: ids are unique. ``observed(url, seen_at,
    page_id, error)``: from ``seen_at`` until the next observation a fetch of the
    URL gives the page, or fails where ``error`` is set. Of observations at one
    time an error counts over a page, the greatest error or page first.

    An ask is tried at once, then after waits that double, up to ``TRIES`` times.
    The first success ends it and gives page and time; if all tries fail, the
    error is that of the last one and page and time are null.
    """
    start = F.unix_micros("asked_at")
    steps = F.array(
        *[
            F.struct(
                F.lit(k).alias("nth"),
                F.timestamp_micros(start + (2**k - 1) * FIRST_WAIT_MICROS).alias("tried_at"),
            )
            for k in range(TRIES)
        ]
    )
    tries = asks.select("ask_id", "url", F.inline(steps))
    found = latest_as_of(
        tries.withColumnRenamed("tried_at", "at"),
        observed.withColumnRenamed("seen_at", "at"),
        "url",
        "at",
        F.struct("error", "page_id"),
        "state",
    )
    failed = F.coalesce(
        F.col("state.error"), F.when(F.col("state").isNull(), F.lit(UNSEEN))
    )
    picked = found.withColumn("failed", failed).groupBy("ask_id", "url").agg(
        F.min(
            F.when(F.col("failed").isNull(), F.struct("nth", "at", F.col("state.page_id").alias("page_id")))
        ).alias("good"),
        F.max_by("failed", "nth").alias("last_error"),
    )
    return picked.select(
        "ask_id",
        "url",
        F.coalesce(F.col("good.nth") + 1, F.lit(TRIES)).cast("bigint").alias("attempts"),
        F.col("good.at").alias("fetched_at"),
        F.col("good.page_id").alias("page_id"),
        F.when(F.col("good").isNull(), F.col("last_error")).alias("error"),
    )
