"""Operators against plain Python on small random inputs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from crawlweave.operators import frontier as steps
from crawlweave.operators import gate, links, ranking, status
from crawlweave.operators.ordering import running_before
from crawlweave.sources import documents, frontier, pages, requests


def test_running_before_in_blocks(spark):
    rnd = random.Random(1)
    rows = [
        (g, o, rnd.randrange(5))
        for g in "ab"
        for o in rnd.sample(range(-50, 3000), 400 if g == "a" else 7)
    ]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    for levels in (1, 2, 3):
        got = running_before(df, ["g"], "o", F.col("v"), "s", levels=levels, bits=3).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.s == sum(v for g, o, v in rows if g == r.g and o < r.o)


def test_number_claims(spark):
    rnd = random.Random(2)
    pairs = rnd.sample([(p, q) for p in range(40) for q in range(0, 20000, 500)], 600)
    rows = [("c", f"u{i}", p, q) for i, (p, q) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "crawl_id string, url string, parent_seq bigint, pos bigint")
    want = {f"u{i}": n for n, (_, i) in enumerate(sorted((pq, i) for i, pq in enumerate(pairs)))}
    got = {r.url: r.nth for r in steps.number_claims(df).collect()}
    assert got == want


def test_limit_counts_known_urls(spark):
    rows = [("c", 1, f"u{i}", i, 2) for i in range(5)] + [("c", 2, "v", 0, 0)]
    df = spark.createDataFrame(
        rows, "crawl_id string, seq bigint, dst_url string, pos bigint, slots bigint"
    )
    assert sorted(r.dst_url for r in steps.limit_links(df).collect()) == ["u0", "u1"]


def test_scopes(spark):
    base = F.lit("https://www.t.org")
    df = spark.createDataFrame(
        [("https://www.t.org/a",), ("https://www.t.org.evil.org/",), ("mailto:q@t.org",), (None,)],
        "dst_url string",
    )
    kept = {s: links.scope_links(df, base, s).count() for s in ("prefix", "host", "any")}
    assert kept == {"prefix": 2, "host": 1, "any": 2}


def test_base_element_and_positions(spark):
    page = '<base href="/d/"><a href="x">1</a><a href="/y">2</a><a name=z>3</a><a href="x">4</a>'
    df = spark.createDataFrame([(1, "https://t.org/a", page)], "page_id int, url string, html string")
    got = [(r.pos, r.dst_url) for r in links.page_links(df).orderBy("pos").collect()]
    assert got == [(0, "https://t.org/d/x"), (1, "https://t.org/y"), (2, "https://t.org/d/x")]
    assert links.distinct_links(links.page_links(df)).count() == 2


def test_body_cap_replaces_split_character(spark):
    df = spark.createDataFrame([(1, "abé"), (2, "ab"), (3, None)], "page_id int, html string")
    got = {r.page_id: (r.html, r.truncated) for r in pages.cap_body(df, 3).collect()}
    assert got == {1: ("ab�", True), 2: ("ab", False), 3: (None, False)}


def test_latest_snapshot_wins(spark):
    df = spark.createDataFrame(
        [(1, "u", 200), (3, "u", 404), (2, "v", 200)], "page_id int, url string, status_code int"
    )
    got = {r.url: (r.page_id, r.status_code) for r in pages.latest_by_url(df, ["status_code"]).collect()}
    assert got == {"u": (3, 404), "v": (2, 200)}


def test_requests_without_limits(spark):
    df = spark.createDataFrame([(1, '{"url":"x","maxUrls":3}'), (2, "{")], "i int, value string")
    got = {r.i: r[1:] for r in requests.parse_requests(df).collect()}
    assert got == {1: ("x", 0, 0, 3), 2: (None, 0, 0, 0)}


def test_requests_from_files(spark, ws):
    lines = ['{"crawlId":"a","url":" x.org ","maxDistance":2,"requestedAt":"2024-01-01 00:00:00"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(ws.path("asked"))
    got = requests.normalize_requests(requests.read_requests(spark, ws.path("asked"))).first()
    assert (got.crawl_id, got.url, got.max_distance, got.max_urls) == ("a", "https://www.x.org", 2, 0)
    assert str(got.requested_at) == "2024-01-01 00:00:00"


def test_documents_append(spark, ws):
    df = spark.createDataFrame([("c", "u", "b", "t", "x", 1)], "crawl_id string, url string, base_url string, title string, content string, distance int")
    for _ in range(2):
        documents.append_docs(documents.index_docs(df), ws.path("docs"))
    stored = ws.load("docs")
    assert stored.count() == 2 and stored.select("doc_key").distinct().count() == 1


def test_crawls_that_start_anew(spark):
    rows = spark.createDataFrame([("a", "u"), ("b", "u")], "crawl_id string, url string")
    left = status.without_crawls(rows, rows.where("crawl_id = 'a'"))
    assert [r.crawl_id for r in left.collect()] == ["b"]


def test_frontier_round_trip_and_bad_messages(spark):
    rec = '{"crawlId":"c","url":"u","maxTime":0}'
    quoted = '"' + rec.replace('"', '\\"') + '"'
    df = spark.createDataFrame([(rec,), (quoted,), (None,), ("nope",)], "value string")
    good, bad = frontier.split_undecodable(frontier.decode_records(df))
    assert [(r.crawl_id, r.url, r.distance) for r in good.collect()] == [("c", "u", None)] * 2
    assert bad.count() == 1
    back = [r.value for r in frontier.encode_records(good).collect()]
    assert back == ['{"crawlId":"c","url":"u","maxTime":0}'] * 2


def test_dedup_ignores_crawl(spark):
    row = ("u", "b", "t", "text", 1, "html")
    rows = [("x", *row), ("a", *row), ("a", "u", "b", "t", "text", 2, "html")]
    df = spark.createDataFrame(
        rows,
        "crawl_id string, url string, base_url string, title string, content string, "
        "level int, content_type string",
    )
    got = sorted((r.level, r.crawl_id, r.copies) for r in documents.dedup_docs(df).collect())
    assert got == [(1, "a", 2), (2, "a", 1)]


def test_content_gate(spark):
    recs = spark.createDataFrame(
        [(1, 9, "b/"), (2, 9, "b/"), (3, 10, "b/"), (4, 0, "b/")],
        "page_id int, text_length int, base_url string",
    )
    found = spark.createDataFrame([(1, "b/x"), (1, "b/y"), (4, "c/x")], "page_id int, dst_url string")
    worth, minimal = gate.split_by_content(recs, found)
    assert sorted(r.page_id for r in worth.collect()) == [1, 3]
    assert sorted(r.page_id for r in minimal.collect()) == [2, 4]


def test_tiers_and_cap(spark):
    def hits(query, articles, others):
        urls_ = [f"https://x.org/news/{i}" for i in range(articles)]
        urls_ += [f"https://x.org/p/{i}" for i in range(others)]
        random.Random(query).shuffle(urls_)
        return [(query, n + 1, u) for n, u in enumerate(urls_)]

    mixes = {1: (60, 20), 2: (30, 50), 3: (0, 80), 4: (80, 0)}
    rows = [h for q, m in mixes.items() for h in hits(q, *m)]
    rows += [(5, 1, "https://x.org/"), (5, 2, "https://x.org/a"), (5, 3, "https://x.org/a"), (5, 4, None)]
    df = spark.createDataFrame(rows, "query_id int, hit int, url string")
    got = defaultdict(list)
    for r in ranking.rerank(ranking.with_url_flags(df)).collect():
        got[r.query_id].append((r.rank, r.tier, r.hit))
    assert {q: len(v) for q, v in got.items()} == {1: 60, 2: 50, 3: 50, 4: 80, 5: 1}
    for ranked in got.values():
        ranked.sort()
        assert [r for r, _, _ in ranked] == list(range(1, len(ranked) + 1))
        assert [(t, h) for _, t, h in ranked] == sorted((t, h) for _, t, h in ranked)


def test_status_store(spark):
    store = spark.createDataFrame(
        [("a", '{"distance":2,"startTimeMillis":1000,"stopReason":"odd"}'), ("b", "{"), ("c", None)],
        "crawl_id string, value string",
    )
    decoded = status.decode_status(store)
    got = {r.crawl_id: (r.distance, r.stop_reason) for r in decoded.collect()}
    assert got == {"a": (2, "odd"), "b": (None, None), "c": (None, None)}
    assert [r.crawl_id for r in status.unknown_stop_reasons(decoded).collect()] == ["a"]
    text = {r.crawl_id: r.value for r in status.encode_status(decoded).collect()}
    assert text["a"] == '{"distance":2,"startTimeMillis":1000,"stopReason":"odd"}'


def test_stop_leaves_finished_crawls(spark):
    base = "crawl_id string, distance int, start_time timestamp, num_pages bigint, stop_reason string, error_message string, last_modified timestamp"
    st = spark.createDataFrame([("a", 1, None, 1, None, None, None), ("b", 1, None, 1, "timeout", None, None)], base)
    control = st.select("crawl_id", F.current_timestamp().alias("stopped_at"), F.lit("r").alias("reason"))
    got = {r.crawl_id: (r.stop_reason, r.error_message) for r in steps.apply_stops(st, control).collect()}
    assert got == {"a": ("userInitiated", "r"), "b": ("timeout", None)}
