"""Visited URLs and status of crawls, kept from job to job.

Both tables have a folder per crawl, named by a digest of its id, and are written
with dynamic partition overwrite: a write replaces the folders of the crawls it
has rows for and touches no other file. A crawl that starts gets a marker row in
the visited table, so its folder is replaced even if it never finds a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.operators.status import status_view, visited_count
from crawlweave.schemas import STATUS

_VISITED = "crawl_id string, url string, distance int, seq bigint"


class CrawlStore:
    """The store under ``root``, a folder that all executors share.

    One job at a time may write a crawl; jobs on different crawls do not meet.
    Crawls without an id are not kept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def begin(self, starting: DataFrame, now: Column) -> None:
        """Forget what is known of the crawls that start, and give them a zero status."""
        ids = _ids(starting)
        zero = status_view(
            ids,
            self.spark.createDataFrame([], STATUS),
            self.spark.createDataFrame([], "crawl_id string, num_pages bigint"),
            now,
        )
        self._replace(_markers(ids), "visited")
        self._replace(zero.withColumn("last_modified", now), "status")

    def publish(self, ran: DataFrame, visited: DataFrame, status: DataFrame) -> None:
        """Replace the rows of the crawls in ``ran`` by ``visited`` and ``status``."""
        ids = _ids(ran)
        kept = visited.join(ids, "crawl_id", "left_semi")
        self._replace(_markers(ids).unionByName(kept), "visited")
        self._replace(status.join(ids, "crawl_id", "left_semi"), "status")

    def visited(self, crawls: list[str] | None = None) -> DataFrame:
        """``crawl_id, url, distance, seq``, of the named crawls only if given."""
        return self._read("visited", _VISITED, crawls).where(F.col("url").isNotNull())

    def status(self, crawls: list[str] | None = None) -> DataFrame:
        """One row per crawl; the page count is that of the visited table."""
        kept = self._read("status", STATUS, crawls)
        counts = visited_count(self.visited(crawls)).withColumnRenamed("num_pages", "_n")
        return kept.join(counts, "crawl_id", "left").select(
            *[c for c in kept.columns if c != "num_pages"],
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("num_pages"),
        )

    def _replace(self, rows: DataFrame, name: str) -> None:
        schema = _VISITED if name == "visited" else STATUS
        wanted = self.spark.createDataFrame([], schema).schema
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]
        # Rebalanced, so that a crawl is a few files, and a large one several tasks' work.
        (
            rows.select(*columns, _key().alias("crawl_key"))
            .hint("rebalance", F.col("crawl_key"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("crawl_key")
            .parquet(f"{self.root}/{name}")
        )

    def _read(self, name: str, schema: str, crawls: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, crawl_key string").parquet(f"{self.root}/{name}")
        if crawls is not None:
            # Folders of other crawls are not listed for the scan.
            keys = [_key(F.lit(c)) for c in crawls]
            rows = rows.where(F.col("crawl_key").isin(*keys) if keys else F.lit(False))
        return rows.drop("crawl_key")


def _key(crawl_id: Column | None = None) -> Column:
    given = F.col("crawl_id") if crawl_id is None else crawl_id
    return F.concat(F.lit("c"), F.sha2(given.cast("binary"), 256))


def _ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("crawl_id").isNotNull()).select("crawl_id").distinct()


def _markers(ids: DataFrame) -> DataFrame:
    return ids.select(
        "crawl_id",
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("int").alias("distance"),
        F.lit(None).cast("bigint").alias("seq"),
    )
