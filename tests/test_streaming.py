"""Streams over several files equal their batch twins."""

import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql import functions as F

from crawlweave.catalog import QUERIES
from crawlweave.operators.status import status_latest, visited_count
from crawlweave.plans import search
from crawlweave.streaming import crawls
from crawlweave import Workspace
from crawlweave.streaming.runs import (
    append_to_files,
    compact_rows,
    each_batch,
    file_stream,
    latest_rows,
    message_stream,
    send_messages,
)


def write_log(spark, ws, batches=3):
    rnd = random.Random(5)
    rows = [
        (f"c{rnd.randrange(4)}", n, f"u{rnd.randrange(12)}", n % 5,
         rnd.choice(["timeout", None]), None, n // 40)
        for n in range(120)
    ]
    df = spark.createDataFrame(
        rows,
        "crawl_id string, seq bigint, url string, distance int, stop_reason string, "
        "error_message string, part int",
    ).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
    for n in range(batches):
        df.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(
            ws.path("log")
        )
    return ws.load("log"), file_stream(spark, ws.path("log"), "*.parquet", per_batch=1)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_dedup_progress_status(spark, ws):
    batch, stream = write_log(spark, ws)
    visits = crawls.first_visits(stream).select("crawl_id", "url")
    append_to_files(visits, ws, "visits").awaitTermination()
    same(ws.load("visits"), batch.select("crawl_id", "url").distinct())

    each_batch(crawls.visit_counts(stream), ws, "n", mode="update").awaitTermination()
    same(latest_rows(ws, "n", ("crawl_id",)), visited_count(batch))
    assert ws.load("n").select("batch").distinct().count() == 3

    each_batch(crawls.live_status(stream), ws, "s", mode="update").awaitTermination()
    same(latest_rows(ws, "s", ("crawl_id",)), status_latest(batch))


def test_watermarked_dedup(spark, ws):
    batch, stream = write_log(spark, ws)
    visits = crawls.first_visits(stream, watermark="1 hour").select("crawl_id", "url")
    append_to_files(visits, ws, "visits").awaitTermination()
    same(ws.load("visits"), batch.select("crawl_id", "url").distinct())


def test_resumes_without_repeating(spark, ws):
    log, stream = write_log(spark, ws, batches=2)
    for _ in range(2):
        append_to_files(stream.select("seq"), ws, "seen").awaitTermination()
        assert ws.load("seen").count() == log.count()
    extra = log.withColumn("seq", F.col("seq") + 1000).where("seq < 1005")
    extra.coalesce(1).write.mode("append").parquet(ws.path("log"))
    append_to_files(stream.select("seq"), ws, "seen").awaitTermination()
    assert ws.load("seen").count() == log.count() + 5


def test_a_job_of_the_same_name_goes_on(spark, ws):
    log, stream = write_log(spark, ws, batches=2)
    for more in (0, 5):
        job = Workspace.named(spark, f"job-{ws.run_id}")
        extra = log.withColumn("seq", F.col("seq") + 1000).where(f"seq < {1000 + more}")
        if more:
            extra.coalesce(1).write.mode("append").parquet(ws.path("log"))
        append_to_files(stream.select("seq"), job, "seen").awaitTermination()
        assert job.load("seen").count() == job.load("seen").distinct().count() == log.count() + more


def test_compacted_batches(spark, ws):
    batch, stream = write_log(spark, ws)
    each_batch(crawls.live_status(stream), ws, "s", mode="update").awaitTermination()
    whole = latest_rows(ws, "s", ("crawl_id",)).collect()
    for upto, left in ((0, [0, 1, 2]), (1, [1, 2]), (1, [1, 2]), (2, [2])):
        compact_rows(ws, "s", ("crawl_id",), upto)
        assert ws.compacted("s")[0] == upto
        assert [r.batch for r in ws.load("s").select("batch").distinct().orderBy("batch").collect()] == left
        assert sorted(map(str, latest_rows(ws, "s", ("crawl_id",)).collect())) == sorted(map(str, whole))


def test_messages_out_and_in(spark, ws):
    _, stream = write_log(spark, ws, batches=2)
    out = stream.select(F.col("url").alias("value"))
    options = {"path": ws.path("sent")}
    send_messages(out, ws, "send", "text", options).awaitTermination()
    back = message_stream(spark, "text", options)
    append_to_files(back, ws, "back").awaitTermination()
    assert ws.load("back").count() == ws.load("log").count()


def test_stops_are_read_per_batch(spark, ws):
    batch, stream = write_log(spark, ws)
    stops = batch.where("crawl_id = 'c1'").select("crawl_id").distinct()
    ws.save(stops, "control")
    crawls.drop_stopped(stream.select("crawl_id", "seq"), ws.path("control"), ws).awaitTermination()
    same(ws.load("running").select("crawl_id", "seq"),
         batch.where("crawl_id <> 'c1'").select("crawl_id", "seq"))


def test_bad_messages_go_aside(spark, ws):
    rows = [('{"crawlId":"c","url":"u"}',), ("broken",), (None,)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.parquet(ws.path("m"))
    stream = file_stream(spark, ws.path("m"), "*.parquet")
    crawls.consume_frontier(stream, ws).awaitTermination()
    got = {r.ok: r.n for r in ws.load("frontier").groupBy("ok").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 0: 1}


def _watch_rows(spark, ws, parts, name):
    schema = "crawl_id string, seq bigint, url string, start boolean, max_time timestamp"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ws.path(name))
    return file_stream(spark, ws.path(name), "*.parquet", per_batch=1)


def test_restarted_crawl_counts_from_nothing(spark, ws):
    """The second start clears the count; records that come in late stay on their side of it."""
    parts = [
        [("a", 1, "u1", True, None), ("a", 2, "u2", False, None), ("b", 1, "u1", None, None)],
        [("a", 12, "u9", False, None), ("a", 3, "u3", False, None)],
        [("a", 10, "u1", True, None), ("a", 11, "u2", False, None), ("a", 4, "u4", False, None)],
        [("a", 5, "u5", False, None), ("a", 13, None, False, None), ("b", 2, "u1", None, None)],
    ]
    for slices in (1, 3):
        name = f"w{slices}"
        stream = _watch_rows(spark, ws, parts, f"in{slices}")
        crawls.watch_crawls(stream, ws, name, slices=slices).awaitTermination()
        got = {r.crawl_id: (r.num_pages, r.stop_reason) for r in crawls.watched(ws, name).collect()}
        assert got == {"a": (3, None), "b": (1, None)}


def test_deadline_fires_without_a_record(spark, ws):
    soon = datetime.now(timezone.utc) + timedelta(seconds=15)
    rows = [("a", 1, "u", True, soon), ("b", 1, "u", True, soon + timedelta(days=1)), ("c", 1, "u", True, None)]
    stream = _watch_rows(spark, ws, [rows], "in")
    query = crawls.watch_crawls(stream, ws, slices=1, trigger={"processingTime": "1 second"})
    try:
        for _ in range(240):
            time.sleep(0.5)
            assert query.exception() is None
            if query.recentProgress and query.recentProgress[-1]["batchId"] > 0:
                got = {r.crawl_id: r.stop_reason for r in crawls.watched(ws).collect()}
                if got.get("a"):
                    break
    finally:
        query.stop()
    assert got == {"a": "timeout", "b": None, "c": None}


def test_stream_is_searchable_batch_by_batch(spark, ws):
    schema = "crawl_id string, url string, base_url string, distance int, html string, at int"
    parts = [
        [("c", f"https://x.org/{i}", "https://x.org/", 0, f"<title>t{i}</title><body>old words</body>", 1) for i in range(5)],
        [("c", "https://x.org/1", "https://x.org/", 0, "<body>new words</body>", 3), ("c", "https://x.org/1", "https://x.org/", 0, "<body>middle words</body>", 2)],
    ]
    home = ws.child("live")
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ws.path("pages"))
        crawls.search_pages_live(file_stream(spark, ws.path("pages"), "*.parquet"), home).awaitTermination()
        index = search.open_index(home)
        found = {w: search.search_one(index, w, ws).count() for w in ("old", "new", "middle")}
        assert found == [{"old": 5, "new": 0, "middle": 0}, {"old": 4, "new": 1, "middle": 0}][n]


def test_tables_that_are_folders(spark, ws):
    rows = [(n, f"https://h{n % 2}.org/{n}", f"<title>t{n}</title><body>b {n}</body>") for n in range(7)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    ws.save(pages.repartition(3), "tables/pages.parquet")
    ws.save(pages.limit(1), "tables/others.parquet")
    found = QUERIES["stream_index"](spark, ws.path("tables")).collect()
    assert sorted((r.url, r.title, r.content) for r in found) == sorted((u, f"t{n}", f"b {n}") for n, u, _ in rows)


def test_state_of_a_crawl_is_read_in_one_call():
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *given: calls.append(name)

    clock = crawls._CrawlClock(timers=False)
    clock.state = State()
    record = Row(seq=1, start=True, deadline=None, url="u")
    assert [r.n for r in clock.handleInputRows(("c", 0), iter([record]), None)] == [1]
    assert calls == ["get", "update"]
