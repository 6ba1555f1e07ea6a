"""The event and page tables as streams; results are read back from the sinks."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.catalog.fetching import WIRE_SQL, wire_messages, wire_view
from crawlweave.catalog.registry import query, table
from crawlweave.catalog.searching import FIXED_QUERIES_SQL, POSTINGS_SQL, SCORES_SQL, fixed_queries
from crawlweave.catalog.shapes import (
    CONTROL_SQL,
    LOG_SQL,
    body_sql,
    crawl_log,
    stop_signals,
    title_sql,
)
from crawlweave.catalog.statuses import NOW_SQL, STATUS_SQL, status_out
from crawlweave.functions import urls
from crawlweave.plans import search
from crawlweave.streaming import crawls
from crawlweave.streaming.runs import append_to_files, each_batch, file_stream, latest_rows
from crawlweave.workspace import Workspace


def _log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return crawl_log(file_stream(spark, folder, "events.parquet"))


@query("stream_frontier", WIRE_SQL)
def stream_frontier(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    log = _log_stream(spark, folder).withColumns(
        {"base_url": F.lit("https://www.s.org/"), "start_time": F.col("at")}
    )
    crawls.consume_frontier(wire_messages(log), ws).awaitTermination()
    return wire_view(ws.load("frontier").where("ok = 1"))


@query("stream_dedup", f"WITH {LOG_SQL} SELECT DISTINCT crawl_id, url FROM log")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    visits = crawls.first_visits(_log_stream(spark, folder)).select("crawl_id", "url")
    append_to_files(visits, ws, "visits").awaitTermination()
    return ws.load("visits")


@query(
    "stream_progress",
    f"WITH {LOG_SQL} SELECT crawl_id, count(DISTINCT url) AS num_pages FROM log GROUP BY 1",
)
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    counts = crawls.visit_counts(_log_stream(spark, folder))
    each_batch(counts, ws, "progress", mode="update").awaitTermination()
    return latest_rows(ws, "progress", ("crawl_id",))


@query("stream_status", STATUS_SQL)
def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    status = crawls.live_status(_log_stream(spark, folder))
    each_batch(status, ws, "status", mode="update").awaitTermination()
    return status_out(latest_rows(ws, "status", ("crawl_id",)))


@query(
    "stream_deadline",
    f"""WITH {LOG_SQL} SELECT seq, crawl_id,
         CASE WHEN {NOW_SQL} >= max_time THEN 'timeout' END AS stop_reason FROM log""",
)
def stream_deadline(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    marked = crawls.mark_timeouts(_log_stream(spark, folder), now)
    append_to_files(marked.select("seq", "crawl_id", "stop_reason"), ws, "marked").awaitTermination()
    return ws.load("marked")


@query(
    "stream_stop",
    f"""WITH {LOG_SQL}, {CONTROL_SQL}
    SELECT seq, crawl_id FROM log WHERE crawl_id NOT IN (SELECT crawl_id FROM control)""",
)
def stream_stop(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    ws.save(stop_signals(table(spark, folder, "events")), "control")
    records = _log_stream(spark, folder).select("seq", "crawl_id")
    crawls.drop_stopped(records, ws.path("control"), ws).awaitTermination()
    return ws.load("running").select("seq", "crawl_id")


@query(
    "stream_index",
    rf"""SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS crawl_id, url,
         {title_sql()} AS title, {body_sql()} AS content, page_id % 3 AS level FROM pages""",
)
def stream_index(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    pages = file_stream(spark, folder, "pages.parquet").withColumns(
        {
            "crawl_id": urls.host(F.col("url")),
            "base_url": F.concat(urls.site(F.col("url")), F.lit("/")),
            "distance": (F.col("page_id") % 3).cast("int"),
        }
    )
    crawls.index_pages(pages, ws).awaitTermination()
    docs = ws.load("docs")
    return docs.select(
        "crawl_id", "url", "title", "content", F.col("level").cast("bigint").alias("level")
    )


_STARTS_SQL = f"""{LOG_SQL},
counted AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY seq) AS nth,
              count(*) OVER (PARTITION BY crawl_id) AS n FROM log),
marked AS (SELECT *, nth = 1 OR nth = n // 2 + 1 AS start FROM counted),
since AS (SELECT crawl_id, max(seq) AS begun FROM marked WHERE start GROUP BY 1)"""


def _marked_log(spark: SparkSession, folder: str, ws: Workspace) -> DataFrame:
    """The log as a stream of three files; each crawl starts twice, the second time half-way."""
    log = crawl_log(table(spark, folder, "events"))
    whole = W.partitionBy("crawl_id")
    nth = F.row_number().over(whole.orderBy("seq"))
    half = F.floor(F.count("*").over(whole) / 2) + 1
    marked = log.withColumn("start", (nth == 1) | (nth == half))
    ws.save(marked.repartitionByRange(3, "seq"), "marked")
    return file_stream(spark, ws.path("marked"), "*.parquet", per_batch=1)


@query(
    "stream_reset",
    f"""WITH {_STARTS_SQL}
    SELECT m.crawl_id, count(DISTINCT url) AS num_pages
    FROM marked m JOIN since s ON m.crawl_id = s.crawl_id AND m.seq >= s.begun GROUP BY 1""",
)
def stream_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per crawl since its last start, over several micro-batches."""
    ws = Workspace(spark)
    records = _marked_log(spark, folder, ws).withColumn("max_time", F.lit(None).cast("timestamp"))
    crawls.watch_crawls(records, ws, slices=2).awaitTermination()
    return crawls.watched(ws).select("crawl_id", "num_pages")


@query(
    "stream_timeout",
    f"""WITH {_STARTS_SQL}
    SELECT m.crawl_id, count(DISTINCT url) AS num_pages,
      CASE WHEN length(m.crawl_id) % 2 = 0 OR right(m.crawl_id, 1) IN ('1', '3', '5', '7', '9') THEN 'timeout' END AS stop_reason
    FROM marked m JOIN since s ON m.crawl_id = s.crawl_id AND m.seq >= s.begun GROUP BY ALL""",
)
def stream_timeout(spark: SparkSession, folder: str) -> DataFrame:
    """Crawls whose deadline passes after their last record, and crawls that have time left."""
    ws = Workspace(spark)
    records = _marked_log(spark, folder, ws)
    ends = datetime.now(timezone.utc) + timedelta(seconds=20)
    short = (F.length("crawl_id") % 2 == 0) | F.substring("crawl_id", -1, 1).isin("1", "3", "5", "7", "9")
    late = F.timestamp_millis(F.lit(int(ends.timestamp() * 1000)))
    records = records.withColumn("max_time", F.when(short, late))
    stream = crawls.watch_crawls(records, ws, slices=2, trigger={"processingTime": "1 second"})
    # Timers fire in the first micro-batch that begins behind the deadline.
    rows, read = ws.load("marked").count(), {}
    while sum(read.values()) < rows or begun <= ends:
        if stream.exception() is not None:
            raise stream.exception()
        time.sleep(0.5)
        for done in stream.recentProgress:
            read[done["batchId"]] = done["numInputRows"]
            begun = datetime.fromisoformat(done["timestamp"].replace("Z", "+00:00"))
    stream.stop()
    return crawls.watched(ws)


@query(
    "stream_search",
    f"""WITH {FIXED_QUERIES_SQL}, docs AS (
      SELECT CAST('0x' || substr(md5(regexp_extract(url, '^https?://([^/?#]*)', 1) || chr(10) || url), 1, 15) AS BIGINT) AS doc_id,
        url, {title_sql()} AS title, {body_sql()} AS content FROM pages
    ), {POSTINGS_SQL}, {SCORES_SQL} SELECT query_id, doc_id, score, hit FROM best""",
)
def stream_search(spark: SparkSession, folder: str) -> DataFrame:
    """Pages go into the index batch by batch, some twice, and are searched with pruning."""
    ws = Workspace(spark)
    pages = table(spark, folder, "pages").withColumn("at", F.lit(2))
    older = pages.where("page_id % 3 = 0").withColumns(
        {"html": F.lit("<title>old</title><body>edtion edtion edtion</body>"), "at": F.lit(1)}
    )
    ws.save(older.coalesce(1), "crawled")
    ws.save(pages.repartitionByRange(2, "page_id"), "crawled", mode="append")
    stream = file_stream(spark, ws.path("crawled"), "*.parquet", per_batch=1).withColumns(
        {
            "crawl_id": urls.host(F.col("url")),
            "base_url": F.concat(urls.site(F.col("url")), F.lit("/")),
            "distance": F.lit(0),
        }
    )
    home = ws.child("live")
    crawls.search_pages_live(stream, home).awaitTermination()
    return search.top_scored(search.open_index(home), fixed_queries(spark), ws)
