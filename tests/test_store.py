"""What is kept of crawls from job to job."""

import os

from pyspark.sql import functions as F

from crawlweave import Workspace
from crawlweave.operators.status import visited_count
from crawlweave.plans import crawl as plan
from crawlweave.plans.store import CrawlStore

PAGES = [
    (i, f"https://www.t.org/{k}", f"<body>long enough text{v}</body>")
    for i, (k, v) in enumerate(
        {"": '<a href="/a">a</a><a href="/b">b</a>', "a": '<a href="/c">c</a>', "b": "", "c": ""}.items()
    )
]


def files(root):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")
    }


def test_crawls_that_run_again(spark, tmp_path):
    ws = Workspace(spark)
    taken = plan.take_snapshot(spark.createDataFrame(PAGES, "page_id long, url string, html string"), ws)
    store, now = CrawlStore(spark, str(tmp_path)), F.to_timestamp(F.lit("2024-01-01 00:10:00"))

    def run(rows):
        asked = spark.createDataFrame(
            rows, "crawl_id string, url string, max_distance int, max_seconds int, max_urls int"
        ).withColumn("requested_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
        plan.crawl(asked, taken, ws, now, normalize=False, store=store)

    def kept():
        counts = {r.crawl_id: r.num_pages for r in visited_count(store.visited()).collect()}
        status = {r.crawl_id: (r.num_pages, r.error_message) for r in store.status().collect()}
        assert {c: n for c, (n, _) in status.items() if n} == counts
        return status

    base = "https://www.t.org/"
    run([("1", base, -1, 3600, 0), ("a/b c", base, 0, 3600, 0), (None, base, 0, 3600, 0)])
    assert kept() == {"1": (4, None), "a/b c": (3, None)}
    before = files(tmp_path)
    run([("1", base, -1, 3600, 2), ("new", base, 0, 3600, 0)])
    assert kept() == {"1": (2, None), "a/b c": (3, None), "new": (3, None)}
    after = files(tmp_path)
    # Of two crawls one is unchanged: its two folders hold the same files as before.
    same = {f for f in before if after.get(f) == before[f]}
    assert {os.path.basename(os.path.dirname(f)) for f in before if f not in same}.isdisjoint(
        os.path.basename(os.path.dirname(f)) for f in same
    ) and same
    assert [r.num_pages for r in store.status(["a/b c"]).collect()] == [3]
    assert sorted(r.url for r in store.visited(["1"]).collect()) == [base, base + "a"]
    assert store.visited([]).count() == 0

    # A crawl that now finds nothing leaves nothing of its former rows.
    run([("1", "foo://x", 0, 3600, 0)])
    assert kept()["1"] == (0, "Invalid URL format: foo://x")


def test_started_crawls_have_a_zero_status(spark, tmp_path):
    store, now = CrawlStore(spark, str(tmp_path)), F.to_timestamp(F.lit("2024-01-01 00:10:00"))
    store.begin(spark.createDataFrame([("x",), ("x",), (None,)], "crawl_id string"), now)
    row = store.status().collect()
    assert [(r.crawl_id, r.distance, r.num_pages, r.stop_reason) for r in row] == [("x", 0, 0, None)]
    assert row[0].start_time == row[0].last_modified and store.visited().count() == 0
