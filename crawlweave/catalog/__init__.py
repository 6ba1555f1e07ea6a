"""Registered queries. Each runs over whole tables of the data folder.

``QUERIES`` maps a name to ``f(spark, folder) -> DataFrame``; ``ORACLES`` maps
it to SQL with the same result, written separately from the Spark code.
"""

from crawlweave.catalog.registry import ORACLES, QUERIES
from crawlweave.catalog import (  # noqa: F401
    crawling,
    dates,
    fetching,
    linking,
    searching,
    statuses,
    streams,
    urls,
)

__all__ = ["ORACLES", "QUERIES"]
