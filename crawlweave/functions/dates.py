"""Date helpers. Wall-clock values are ``timestamp_ntz``; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.functions.binding import bind

# Fixed value: the zone used when none is given.
DEFAULT_ZONE = "Asia/Jerusalem"

# How far clocks are set back where summer time ends.
_SET_BACK = ("30 MINUTES", "1 HOUR", "2 HOURS")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM")


def date_str(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def local_to_utc(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Wall time in ``zone`` to wall time in UTC, fractions of a second dropped.

    A wall time that occurs twice means its second, standard-time occurrence.
    """
    wall = ts.cast("timestamp_ntz")

    def latest(first: Column) -> Column:
        chosen = first
        for gap in _SET_BACK:
            later = first + F.expr(f"INTERVAL {gap}")
            again = F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == wall
            chosen = F.when(again, later).otherwise(chosen)
        return chosen

    utc = bind(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall), latest)
    return F.date_trunc("second", utc).cast("timestamp_ntz")


def local_date_to_utc(d: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Midnight of ``d`` in ``zone`` to wall time in UTC."""
    return local_to_utc(d.cast("date").cast("timestamp_ntz"), zone)


def utc_to_local(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Wall time in UTC to wall time in ``zone``, fractions of a second dropped."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.date_trunc("second", local).cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def same_instant(a: Column, b: Column) -> Column:
    """Equality at millisecond precision; two nulls are equal."""
    return _millis(a).eqNullSafe(_millis(b))


def _millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)
