"""Crawl progress report from a log of crawl records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from crawlweave.operators import status


def progress_report(crawls: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """One row per crawl: last status, live page count, zeros where unknown.

    A crawl without a log starts ``now``.

    ``log`` has ``crawl_id, seq, url, distance, stop_reason, error_message, at``.
    """
    return status.status_view(crawls, status.status_latest(log), status.visited_count(log), now)
