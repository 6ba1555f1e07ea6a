"""Which fetched records become documents, and what is reported of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import records, urls
from crawlweave.operators.links import in_scope


def with_access(fetched: DataFrame) -> DataFrame:
    """Add ``accessible`` and the message for those that are not."""
    parseable = urls.is_parseable(F.col("url"))
    ok = parseable & records.is_accessible(F.col("status_code"))
    message = records.access_message(
        F.col("url"), parseable, F.col("status_code"), F.col("robots_txt")
    )
    return fetched.withColumns(
        {"accessible": ok, "message": F.when(~ok, message)}
    )


def split_by_content(
    fetched: DataFrame, links: DataFrame, scope: str = "prefix"
) -> tuple[DataFrame, DataFrame]:
    """Records worth indexing, and those with neither text nor links.

    Only records short of text are looked up in ``links``, by an inner join, so
    that a few of them are broadcast to the links and not the other way round.
    A record is known by its page and base URL.
    """
    thin = fetched.where(F.col("text_length") < records.MIN_TEXT)
    rich = fetched.where(F.col("text_length") >= records.MIN_TEXT)
    asked = thin.select(F.col("page_id").alias("_pid"), F.col("base_url").alias("_base"))
    linked = (
        links.select("page_id", "dst_url")
        .join(asked, F.col("page_id") == F.col("_pid"))
        .where(in_scope(F.col("dst_url"), F.col("_base"), scope))
        .select("_pid", "_base")
        .distinct()
    )
    own = (F.col("page_id") == F.col("_pid")) & F.col("base_url").eqNullSafe(F.col("_base"))
    return (
        rich.unionByName(thin.join(linked, own, "left_semi")),
        thin.join(linked, own, "left_anti"),
    )


def error_rows(df: DataFrame, message: Column) -> DataFrame:
    return df.select("crawl_id", "url", message.alias("message"))
