"""Streams of crawl records: decoding, dedup, progress, status, stops, documents."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlweave.functions import html
from crawlweave.operators import frontier as steps
from crawlweave.operators.status import status_latest
from crawlweave.plans import search
from crawlweave.sources.documents import index_docs
from crawlweave.sources.frontier import decode_records
from crawlweave.streaming.runs import AVAILABLE_NOW, append_to_files, each_batch, latest_rows
from crawlweave.workspace import Workspace


def consume_frontier(
    messages: DataFrame, ws: Workspace, name: str = "frontier", trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Decoded records under ``ok=1``, those without crawl or URL under ``ok=0``."""
    decoded = decode_records(messages)
    ok = F.col("crawl_id").isNotNull() & F.col("url").isNotNull()
    return append_to_files(decoded.withColumn("ok", ok.cast("int")), ws, name, ("ok",), trigger)


def first_visits(records: DataFrame, salts: int = 8, watermark: str | None = None) -> DataFrame:
    """Each (crawl, URL) once, when it first arrives.

    Copies are dropped in two steps, first inside ``salts`` slices of a key and
    then across them, so a URL that makes up much of the stream is spread out.
    State is one row per URL for good; with ``watermark`` (a delay on column
    ``at``) it is dropped again, and a URL may return after that long.
    """
    slice_ = F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")
    sliced = records.withColumn("_slice", slice_)
    keys = ["crawl_id", "url"]
    if watermark is None:
        once = sliced.dropDuplicates([*keys, "_slice"]).dropDuplicates(keys)
    else:
        once = (
            sliced.withWatermark("at", watermark)
            .dropDuplicatesWithinWatermark([*keys, "_slice"])
            .dropDuplicatesWithinWatermark(keys)
        )
    return once.drop("_slice")


def visit_counts(records: DataFrame, salts: int = 8) -> DataFrame:
    """Distinct URLs per crawl so far; run in update mode."""
    return (
        first_visits(records, salts).groupBy("crawl_id").agg(F.count("*").alias("num_pages"))
    )


def live_status(log: DataFrame) -> DataFrame:
    """Last status per crawl so far; run in update mode."""
    return status_latest(log)


def mark_timeouts(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Records with ``stop_reason`` timeout where the deadline has passed.

    Each record carries its deadline, so this keeps no state. Without ``now``
    the clock is the micro-batch's own time.
    """
    clock = F.current_timestamp() if now is None else now
    late = clock >= F.col("max_time")
    return records.withColumn("stop_reason", F.when(late, "timeout"))


def drop_stopped(
    records: DataFrame,
    control_path: str,
    ws: Workspace,
    name: str = "running",
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Records of crawls not stopped by the time their micro-batch runs.

    The stop signals are read anew for each micro-batch.
    """

    def change(batch: DataFrame) -> DataFrame:
        control = batch.sparkSession.read.parquet(control_path)
        return steps.without_stopped(batch, control)

    return each_batch(records, ws, name, change, trigger=trigger)


def _page_documents(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Documents of crawled pages: ``crawl_id, url, base_url, distance, html``."""
    read = pages.withColumns(
        {"title": html.title(F.col("html")), "content": html.body_text(F.col("html"))}
    )
    return index_docs(read, keep)


def index_pages(
    pages: DataFrame, ws: Workspace, name: str = "docs", trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Append a document per crawled page to a table of documents.

    ``pages`` has ``crawl_id, url, base_url, distance, html``. To search them as they
    come in, use ``search_pages_live``.
    """
    return append_to_files(_page_documents(pages), ws, name, trigger=trigger)


def search_pages_live(
    pages: DataFrame, home: Workspace, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Put the pages of each micro-batch into the index in ``home``.

    ``open_index(home)`` gives the index as of the last finished micro-batch. Pages
    crawled again replace what was there; ``at``, if ``pages`` has it, tells the newer
    of two in one micro-batch. A micro-batch that is run again finds its documents in
    the index already, alike, and adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        newest = "at" if "at" in batch.columns else None
        docs = _page_documents(batch, [newest] if newest else []).withColumnRenamed("doc_key", "doc_id")
        search.add_to(home, docs, newest)

    return (
        pages.writeStream.option("checkpointLocation", home.path("live-progress"))
        .foreachBatch(add)
        .trigger(**trigger)
        .start()
    )


class _CrawlClock(StatefulProcessor):
    """One slice of a crawl: its distinct URLs since its last start, and its deadline.

    Each URL is kept with its greatest ``seq``, so a start that comes in late still
    leaves what belongs to it. The timer tells of a deadline that passes without any
    further record. A slice is one state value, read and written once a micro-batch.
    """

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", "begun bigint, deadline bigint, urls array<string>, seqs array<bigint>"
        )

    def handleInputRows(self, key, rows, timerValues):
        # Each call to the state is a round trip; get gives None where there is none yet.
        begun, before, urls, seqs = self.state.get() or (None, None, [], [])
        known, deadline, any_row = dict(zip(urls, seqs, strict=True)), before, False
        for row in rows:
            if begun is not None and row.seq < begun:
                continue
            any_row = True
            if row.start and (begun is None or row.seq > begun):
                begun, deadline = row.seq, None
                known = {url: seq for url, seq in known.items() if seq >= begun}
            if row.deadline is not None:
                deadline = row.deadline
            if row.url is not None:
                known[row.url] = max(row.seq, known.get(row.url, row.seq))
        if not any_row:
            return
        self.state.update((begun, deadline, list(known), list(known.values())))
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else time.time() * 1000
        late = deadline is not None and deadline <= now
        if self.timers and (deadline != before or late):
            if before is not None and before in list(self.handle.listTimers()):
                self.handle.deleteTimer(before)
            if deadline is not None and not late:
                self.handle.registerTimer(deadline)
        yield Row(
            crawl_id=key[0], slice=key[1], begun=begun, n=len(known), stop_reason="timeout" if late else None
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        begun, _, urls, _ = self.state.get()
        yield Row(crawl_id=key[0], slice=key[1], begun=begun, n=len(urls), stop_reason="timeout")

    def close(self) -> None:
        pass


def watch_crawls(
    records: DataFrame,
    ws: Workspace,
    name: str = "watch",
    slices: int = 64,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Live counts that begin anew with a crawl, and timeouts that need no record.

    ``records`` has ``crawl_id, seq, url, max_time`` and ``start``, which is true for
    the record a crawl starts with. It clears what is known of the crawl up to there.
    A crawl's URLs are spread over ``slices`` keys, so many that one key's URLs are few
    enough for a state value; starts go to all of them. Timers
    fire while the stream runs, so give a ``processingTime`` trigger to wait for them;
    with ``availableNow``, which ends with the records, a deadline counts only if it
    has passed when a record comes. ``watched`` reads the outcome.
    """
    timers = "availableNow" not in trigger
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    own = F.pmod(F.xxhash64("url"), F.lit(slices)).cast("int")
    begins = F.coalesce("start", F.lit(False))
    spread = records.select(
        "crawl_id",
        "seq",
        "url",
        F.unix_millis("max_time").alias("deadline"),
        begins.alias("start"),
        own.alias("_own"),
        F.explode(F.when(begins | F.col("url").isNull(), every).otherwise(F.array(own))).alias("slice"),
    )
    rows = spread.withColumn("url", F.when(F.col("slice") == F.col("_own"), F.col("url"))).drop("_own")
    found = rows.groupBy("crawl_id", "slice").transformWithState(
        statefulProcessor=_CrawlClock(timers),
        outputStructType="crawl_id string, slice int, begun bigint, n bigint, stop_reason string",
        outputMode="update",
        timeMode="processingTime" if timers else "None",
    )
    return each_batch(found, ws, name, mode="update", trigger=trigger)


def watched(ws: Workspace, name: str = "watch") -> DataFrame:
    """``crawl_id, num_pages, stop_reason`` as of now, of each crawl's last start."""
    rows = latest_rows(ws, name, ("crawl_id", "slice"))
    return (
        rows.groupBy("crawl_id", F.coalesce("begun", F.lit(-1)).alias("begun"))
        .agg(F.sum("n").alias("num_pages"), F.max("stop_reason").alias("stop_reason"))
        .groupBy("crawl_id")
        .agg(F.max_by(F.struct("num_pages", "stop_reason"), "begun").alias("_v"))
        .select("crawl_id", "_v.*")
    )
