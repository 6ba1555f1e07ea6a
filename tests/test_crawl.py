"""The level-wise crawl against a first-in-first-out simulation."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from crawlweave import Workspace
from crawlweave.plans import crawl as plan
from crawlweave.sources.pages import fetch

NOW = "2024-01-01 00:10:00"
START = "2024-01-01 00:00:00"
REQ = "crawl_id string, url string, max_distance int, max_seconds int, max_urls int"
PAGES = "page_id bigint, url string, html string, status_code int, robots_txt string"
FILLER = "long enough text"


def requests(spark, rows):
    return spark.createDataFrame(rows, REQ).withColumn("requested_at", F.to_timestamp(F.lit(START)))


def run(spark, rows, pages, ws=None, **options):
    ws = ws or Workspace(spark)
    snap = plan.take_snapshot(spark.createDataFrame(pages, PAGES), ws)
    now = F.to_timestamp(F.lit(NOW))
    return plan.crawl(requests(spark, rows), snap, ws, now, **options)


def random_sites(n):
    """Requests, pages, and per site its link lists, statuses and text lengths."""
    rnd = random.Random(7)
    rows, pages, sites = [], [], {}
    for i in range(n):
        base = f"https://www.s{i}.org/"
        names = [base] + [f"{base}p{k}" for k in range(rnd.randrange(1, 9))]
        site = {}
        for name in names:
            targets = rnd.choices([*names, f"{base}gone", "https://www.o.org/"], k=rnd.randrange(0, 6))
            status = rnd.choice([200, 200, 200, 200, 404, None])
            body = rnd.choice([FILLER, FILLER, ""])
            site[name] = (targets, status, len(body))
            anchors = "".join(f'<a href="{t}"></a>' for t in targets)
            pages.append((len(pages), name, f"<body>{body}{anchors}</body>", status, None))
        site[base] = (site[base][0], rnd.choice([200] * 9 + [500]), site[base][2])
        pages = [
            (p[0], p[1], p[2], site[base][1], None) if p[1] == base else p for p in pages
        ]
        limits = (rnd.choice([-1, 0, 1, 2, 3]), 3600, rnd.choice([0, 1, 2, 3, 5, 8]))
        rows.append((f"c{i}", base, *limits))
        sites[f"c{i}"] = site
    return rows, pages, sites


def simulate(row, site, budget):
    """Visited URLs in order, fetched, indexed, and URLs with an error."""
    _, base, max_distance, _, max_urls = row
    queue, visited, fetched, docs, errors = deque([(base, 0)]), [], [], [], []
    while queue:
        url, distance = queue.popleft()
        used = len(fetched) if budget == "fetched" else len(visited)
        if 0 <= max_distance < distance or 0 < max_urls <= used:
            continue
        targets, status, length = site.get(url, ([], None, 0))
        if status is None or status >= 400:
            errors.append(url)
            continue
        if url not in visited:
            visited.append(url)
        fetched.append(url)
        found = list(dict.fromkeys(t for t in targets if t.startswith(base)))
        if length < 10 and not found:
            errors.append(url)
            continue
        docs.append(url)
        if max_urls > 0 and budget == "literal":
            found = found[: max(max_urls - len(visited), 0)]
        new = [t for t in found if t not in visited]
        if max_urls > 0 and budget == "discovered":
            new = new[: max(max_urls - len(visited), 0)]
        visited += new
        queue += [(t, distance + 1) for t in new]
    return visited, fetched, docs, errors


@pytest.mark.parametrize("budget", ["discovered", "fetched", "literal"])
def test_same_as_queue(spark, budget):
    rows, pages, sites = random_sites(80)
    done = run(spark, rows, pages, budget=budget)
    visited = done.visited.orderBy("crawl_id", "seq").collect()
    fetched = done.records.where("fetched").orderBy("crawl_id", "seq").collect()
    docs = done.docs.collect()
    errors = done.errors.collect()
    counts = {r.crawl_id: r.num_pages for r in done.status.collect()}
    of = lambda found, c: [r.url for r in found if r.crawl_id == c]
    for row in rows:
        cid = row[0]
        want = simulate(row, sites[cid], budget)
        assert of(visited, cid) == want[0], row
        assert of(fetched, cid) == want[1], row
        assert sorted(of(docs, cid)) == sorted(want[2]), row
        assert sorted(of(errors, cid)) == sorted(want[3]), row
        assert counts[cid] == len(want[0])


def test_one_crawl_and_one_url_hold_most_rows(spark):
    """A large site whose pages all link to the same pages, next to small ones."""
    base, n = "https://www.big.org/", 9000
    # Many snapshots of the root; only the last one links to the site's pages.
    pages = [(i, base, f"<body>{FILLER}</body>", 200, None) for i in range(500)]
    anchors = "".join(f'<a href="p{k}"></a>' for k in range(n))
    pages.append((500, base, f"<body>{FILLER}{anchors}</body>", 200, None))
    same = '<a href="/"></a><a href="p1"></a><a href="extra"></a>'
    pages += [
        (1000 + k, f"{base}p{k}", f"<body>{FILLER}{same}</body>", 200, None) for k in range(n)
    ]
    rows = [("all", base, -1, 3600, 0), ("some", base, -1, 3600, 7000)]
    rows += [(f"r{i}", base, 0, 3600, 0) for i in range(20)]
    done = run(spark, rows, pages)
    got = {r.crawl_id: (r.num_pages, r.distance) for r in done.status.collect()}
    assert got.pop("all") == (n + 2, 2) and got.pop("some") == (7000, 1)
    assert set(got.values()) == {(n + 1, 1)}
    visited = done.visited.where("crawl_id = 'some'")
    assert [r.url for r in visited.orderBy("seq").tail(1)] == [f"{base}p6998"]
    assert done.docs.where("crawl_id = 'all'").count() == n + 1


def site_pages():
    links = ["/a", "/b", "/a", "/a#x", "mailto:q@t.org", "javascript:void(0)",
             "https://www.o.org/", "c", "../d", "?p=2", "//www.t.org/e"]
    html = {
        "": FILLER + "".join(f'<a href="{h}">.</a>' for h in links),
        "a": FILLER + '<a href="/b">b</a><a href="/">h</a>',
        "b": FILLER + '<a href="/a">a</a><a href="/f">f</a><a href="/g">g</a>',
        "c": "hi",
        "d": "0123456789",
        "e": FILLER,
        "g": 'hi<a href="/a">a</a>',
    }
    base = "https://www.t.org/"
    return [
        (i, base + k, f"<body>{v}</body>", 404 if k == "e" else 200, None)
        for i, (k, v) in enumerate(html.items())
    ]


def test_site_by_hand(spark):
    base = "https://www.t.org/"
    rows = [("c", base, -1, 3600, 0), ("x", "www.no.org", 1, 1, 1), (None, base, 0, 1, 0)]
    done = run(spark, rows, site_pages(), normalize=False)
    visited = [r.url[len(base):] for r in done.visited.orderBy("seq").collect()]
    assert visited == ["", "a", "b", "a#x", "c", "d", "?p=2", "e", "f", "g"]
    assert sorted(r.url[len(base):] for r in done.docs.collect()) == ["", "a", "b", "d", "g"]
    errors = {r.url: r.message for r in done.errors.collect()}
    assert errors.pop(base) == f"Request without crawl id: {base}"
    assert set(errors) == {base + k for k in ("a#x", "c", "?p=2", "e", "f")} | {"www.no.org"}
    assert errors[base + "c"].startswith("Page contains minimal")
    assert errors[base + "e"].startswith("URL is not accessible")
    assert errors[base + "f"].startswith("Failed to check")
    status = {r.crawl_id: r for r in done.status.collect()}
    assert set(status) == {"c", "x"}
    x = status["x"]
    assert (x.distance, x.num_pages, x.stop_reason) == (0, 0, "userInitiated")
    assert x.error_message == "Invalid URL format: www.no.org" and x.last_modified is not None


def test_deadline_and_stop(spark):
    base = "https://www.t.org/"
    rows = [("late", base, -1, 600, 0), ("stopped", base, -1, 3600, 0), ("runs", base, 0, 3600, 0)]
    control = spark.createDataFrame([("stopped",)], "crawl_id string").withColumns(
        {"stopped_at": F.to_timestamp(F.lit(START)), "reason": F.lit("x")}
    )
    done = run(spark, rows, site_pages(), control=control)
    rows = done.status.collect()
    got = {r.crawl_id: (r.stop_reason, r.num_pages) for r in rows}
    assert got == {"late": ("timeout", 0), "stopped": ("userInitiated", 0), "runs": ("maxDistance", 8)}
    assert {r.crawl_id: r.error_message for r in rows}["stopped"] == "x"


def test_all_requests_invalid(spark):
    done = run(spark, [("a", "foo://x", 1, 1, 1)], site_pages(), normalize=False)
    assert done.records.count() == done.visited.count() == done.docs.count() == 0
    assert [r.message for r in done.errors.collect()] == ["Invalid URL format: foo://x"]
    assert [r.stop_reason for r in done.status.collect()] == ["userInitiated"]


def test_address_without_scheme(spark):
    done = run(spark, [("a", "t.org/", 0, 3600, 0)], site_pages())
    assert [r.url for r in done.docs.collect()] == ["https://www.t.org/"]


def test_signal_during_the_crawl(spark):
    base, calls = "https://www.t.org/", []

    def control():
        calls.append(1)
        ids = ["c"] if len(calls) > 1 else []
        return spark.createDataFrame([(i,) for i in ids], "crawl_id string").withColumns(
            {"stopped_at": F.to_timestamp(F.lit(START)), "reason": F.lit(None).cast("string")}
        )

    done = run(spark, [("c", base, -1, 3600, 0)], site_pages(), control=control)
    assert [r.url for r in done.docs.collect()] == [base]
    status = done.status.first()
    assert (status.stop_reason, status.error_message) == ("userInitiated", "Manually stopped by user")


def test_one_workspace_for_all(spark, ws):
    rows = [("c", "https://www.t.org/", -1, 3600, 0)]
    done = [run(spark, rows, site_pages(), ws=ws) for _ in range(2)]
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "node int")
    reached = [plan.expand(edges, seeds, ws, d) for d in (1, -1)]
    assert [d.records.count() for d in done] == [done[0].records.count()] * 2
    assert [d.docs.count() for d in done] == [5, 5]
    assert [r.count() for r in reached] == [2, 3]


def test_small_frontier_does_not_move_the_pages(spark, ws):
    n = 200_000
    facts = ws.save(
        spark.range(n).select(
            F.concat(F.lit("https://p.org/"), "id").alias("url"), F.col("id").alias("page_id"),
            F.rpad(F.lit("x"), 60, "x").alias("robots_txt"),
        ), "facts",
    )
    small = ws.save(facts.limit(5).select("url"), "small")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        got = fetch(small, facts)
        assert got.where("found").count() == 5
        text = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" in text and "Inner" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expand_on_a_cycle(spark, ws):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (9, 8)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "node int")
    got = {r.node: r.distance for r in plan.expand(edges, seeds, ws).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}
    near = plan.expand(edges, seeds, Workspace(spark), max_distance=1)
    assert {r.node for r in near.collect()} == {0, 1}
