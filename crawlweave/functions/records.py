"""Crawl-record expressions: limits, stop reasons, messages, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.schemas import STOP_REASONS

# Limits and message texts.
NO_LIMIT = 2147483647
MIN_TEXT = 10
FIRST_ERROR_STATUS = 400
ROBOTS_BLOCK = "disallow: /"
MSG_STATUS = "URL is not accessible or returned an error (status code >= 400): "
MSG_ROBOTS = ("Crawling may be restricted by robots.txt for ", " (proceeding with caution)")
MSG_OTHER = "No specific error (check logs for details)"
MSG_INVALID = "Invalid URL format: "
MSG_IO = "Failed to check accessibility: "
MSG_MINIMAL = "Page contains minimal or no usable content/links: "
MSG_STOPPED = "Manually stopped by user"
# Not a fixed value: requests come with their id here.
MSG_NO_ID = "Request without crawl id: "


def int_or_zero(c: Column) -> Column:
    """Counter text to int; null and non-numbers are 0."""
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int")), F.lit(0))


def deadline(start: Column, max_seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + max_seconds.cast("bigint") * 1000000)


def stop_reason(
    distance: Column,
    max_distance: Column,
    visited: Column,
    max_urls: Column,
    now: Column,
    max_time: Column,
    stopped: Column,
) -> Column:
    """Why this record is not crawled; the first that applies, else null."""
    by_distance, by_urls, by_time, by_user = STOP_REASONS
    return (
        F.when((max_distance >= 0) & (distance > max_distance), by_distance)
        .when((max_urls > 0) & (visited >= max_urls), by_urls)
        .when(now >= max_time, by_time)
        .when(stopped, by_user)
    )


def slots_left(max_urls: Column, visited: Column) -> Column:
    """How many more URLs may be added; a limit of 0 or less is no limit."""
    return F.when(max_urls > 0, max_urls - visited).otherwise(F.lit(NO_LIMIT))


def is_accessible(status_code: Column) -> Column:
    return F.coalesce(status_code < FIRST_ERROR_STATUS, F.lit(False))


def is_robots_blocked(robots_txt: Column) -> Column:
    """Any rule that starts at the root counts, also one for a sub-path."""
    text = F.regexp_replace(F.lower(robots_txt), r"\s+", " ")
    return F.coalesce(text.contains(ROBOTS_BLOCK), F.lit(False))


def access_message(
    url: Column, parseable: Column, status_code: Column, robots_txt: Column
) -> Column:
    """What to report for a URL that could not be crawled."""
    return (
        F.when(~parseable, F.concat(F.lit(MSG_INVALID), url))
        .when(status_code.isNull(), F.concat(F.lit(MSG_IO), url))
        .when(status_code >= FIRST_ERROR_STATUS, F.concat(F.lit(MSG_STATUS), url))
        .when(
            is_robots_blocked(robots_txt),
            F.concat(F.lit(MSG_ROBOTS[0]), url, F.lit(MSG_ROBOTS[1])),
        )
        .otherwise(F.lit(MSG_OTHER))
    )


def known_stop_reason(name: Column) -> Column:
    """The name if it is a stop reason, else null."""
    return F.when(name.isin(*STOP_REASONS), name)
