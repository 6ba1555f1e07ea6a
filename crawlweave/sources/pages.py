"""Page snapshots: the table that stands in for fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: largest body kept, in bytes.
BODY_CAP = 10 * 1024 * 1024


def cap_body(pages: DataFrame, cap: int = BODY_CAP) -> DataFrame:
    """Cut bodies at ``cap`` bytes and flag them; a split character is replaced."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    cut = F.make_valid_utf8(
        F.substring(F.col("html").cast("binary"), 1, cap).cast("string")
    )
    return pages.withColumns(
        {
            "html": F.when(size > cap, cut).otherwise(F.col("html")),
            "truncated": size > cap,
        }
    )


def latest_by_url(pages: DataFrame, columns: list[str]) -> DataFrame:
    """One row per URL, the one with the highest ``page_id``.

    The aggregate combines on the map side, so a URL with very many snapshots
    costs no more than any other. Pass narrow columns only.
    """
    picked = F.max_by(F.struct("page_id", *columns), "page_id")
    return pages.groupBy("url").agg(picked.alias("_p")).select("url", "_p.*")


def fetch(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier records with the page found at their URL, if any.

    ``pages`` has one row per URL. Only the few it shares with the frontier go
    on to the outer join: a small frontier is broadcast to the pages, which then
    stay where they are.
    """
    hit = pages.join(frontier.select("url").distinct(), "url")
    return frontier.join(hit, "url", "left").withColumn("found", F.col("page_id").isNotNull())
