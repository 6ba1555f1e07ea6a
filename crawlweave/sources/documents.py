"""Index documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: content type of an indexed page.
CONTENT_TYPE = "html"

#: Two documents with equal values here are the same document.
IDENTITY = ["url", "base_url", "content", "level", "content_type"]


def doc_key() -> Column:
    """A stable number for a page of a crawl, the first 60 bits of a digest."""
    name = F.concat("crawl_id", F.lit("\n"), "url")
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def index_docs(fetched: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Documents from crawled records that carry ``title`` and ``content``.

    ``doc_key`` depends on crawl and URL alone, so writing a page twice in one
    crawl can be recognised.
    """
    return fetched.select(
        doc_key().alias("doc_key"),
        "crawl_id",
        "url",
        "base_url",
        "title",
        "content",
        F.col("distance").cast("int").alias("level"),
        F.lit(CONTENT_TYPE).alias("content_type"),
        *keep,
    )


def append_docs(docs: DataFrame, path: str) -> None:
    """Add documents to a stored index; pages crawled again are added again."""
    docs.write.mode("append").parquet(path)


def dedup_docs(docs: DataFrame) -> DataFrame:
    """One row per document, whichever crawls found it; lowest crawl id kept.

    Grouping on a digest instead of the text keeps the keys short, and copies
    merge on the map side, so a page held by very many crawls is no burden.
    """
    keys = [c for c in IDENTITY if c != "content"]
    return (
        docs.withColumn("_digest", F.sha2("content", 256))
        .groupBy(*keys, "_digest")
        .agg(
            F.min("crawl_id").alias("crawl_id"),
            F.any_value("content").alias("content"),
            F.count("*").alias("copies"),
        )
        .drop("_digest")
    )
