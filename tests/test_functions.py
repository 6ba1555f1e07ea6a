"""Hand-worked cases for the Column helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlweave.functions import dates, html, records, text, urls


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {
        None: "https://www.",
        " example.com ": "https://www.example.com",
        "http://example.com:81/a?x=1#f": "http://www.example.com:81/a?x=1",
        "https://www.example.com/a#f": "https://www.example.com/a#f",
        "https://u:p@example.com/a": "https://www.example.com/a",
        "https://m.example.com": "https://www.m.example.com",
        "https://example.com:bad/": "https://example.com:bad/",
        "https://example.com:/a": "https://www.example.com/a",
        "https://example.com/a/../b/./c": "https://www.example.com/b/c",
        "HTTP://example.com": "https://www.HTTP//example.com",
        "https://a_b.com/x": "https://www.a_b.com/x",
    }
    once = many(spark, list(cases), urls.normalize)
    assert once == list(cases.values())
    assert many(spark, once[1:], urls.normalize) == once[1:]


def test_validity_and_kind(spark):
    cases = ["https://a b/", "https://x.com/%zz", "ftp://x/y", "foo://x/", None, "", "x.com"]
    assert many(spark, cases, urls.is_valid) == [False, False, True, False, False, False, False]
    home = ["https://x.com", "https://x.com/", "https://x.com/?q=1", "https://x.com/a", "zzz", None]
    assert many(spark, home, urls.is_homepage) == [True, True, True, False, True, True]
    article = {
        "https://x.com/News/1": True,
        "https://x.com/a?docID=7": True,
        "https://x.com/a?pid=7": False,
        "https://x.com/2024/01/05/s": True,
        "https://x.com/123456": True,
        "https://x.com/12345": False,
        "https://x.com/a/b/c": True,
        "https://x.com/a/b": False,
        "zzz/article/": True,
        "zzz/a/b/c/d": False,
        None: False,
    }
    assert many(spark, list(article), urls.is_article) == list(article.values())


def test_resolve(spark):
    cases = {
        "/a": "https://www.t.org:81/a",
        "c": "https://www.t.org:81/x/c",
        "../d": "https://www.t.org:81/d",
        "../../d": "https://www.t.org:81/d",
        "?p=2": "https://www.t.org:81/x/y?p=2",
        "//www.t.org/e": "https://www.t.org/e",
        "#x": "https://www.t.org:81/x/y?q=1#x",
        "mailto:q@t.org": "mailto:q@t.org",
        "https:foo": "https://www.t.org:81/x/foo",
        "./": "https://www.t.org:81/x/",
        "..": "https://www.t.org:81/",
        "http://h:bad/": None,
        " https://u:p@o.org/k\n": "https://o.org/k",
    }
    base = urls.base_parts(F.lit("https://u@www.t.org:81/x/y?q=1#fr"))
    got = many(spark, list(cases), lambda h: urls.resolve(base, h))
    assert got == list(cases.values())


def test_html(spark):
    page = (
        "<html><head><title>A &amp; B &eacute;</title><style>p{}</style></head><body>"
        "<p>x&#233;y &#x20AC; &hellip; &amp;lt; z&lt;b&nbsp;<b>bo</b>ld<br>n"
        "<script>var a='<a href=q>'</script> <a class=x href='/1?a=1&amp;b=2'>l</a>"
        "<A HREF=/2>t</A><!-- <a href=/3> --></body>"
    )
    assert one(spark, html.body_text(F.lit(page))) == "xéy € … &lt; z<b bold n lt"
    assert one(spark, html.title(F.lit(page))) == "A & B é"
    assert one(spark, html.hrefs(F.lit(page))) == ["/1?a=1&b=2", "/2"]
    assert one(spark, html.body_text(F.lit(None).cast("string"))) == ""


def test_highlights(spark):
    words = F.array(F.lit("three"), F.lit("a+b"))
    long = "One two. Three four (THREE)! " + "word " * 40
    got = one(spark, text.highlights(F.lit(long), words))
    assert got == ["<em>Three</em> four (<em>THREE</em>)!"]
    title = F.lit("No match here")
    assert one(spark, text.snippet(title, F.lit(long), words)) == got[0]
    assert one(spark, text.snippet(F.lit("three"), F.lit(long), words)) == "<em>three</em>"
    assert one(spark, text.snippet(title, F.lit(None).cast("string"), words)) == ""
    pieces = one(spark, text.passages(F.lit(long)))
    assert " ".join(pieces).split() == long.split()


@pytest.mark.parametrize(
    "distance,max_distance,visited,max_urls,max_time,stopped,expected",
    [
        (2, 1, 9, 5, "2024-01-01 00:00:30", True, "maxDistance"),
        (1, 1, 5, 5, "2024-01-01 00:00:30", True, "maxUrls"),
        (1, -1, 9, 0, "2024-01-01 00:01:00", False, "timeout"),
        (1, 1, 4, 5, "2024-01-01 00:02:00", True, "userInitiated"),
        (1, 1, 4, 5, "2024-01-01 00:02:00", False, None),
    ],
)
def test_stop_reason(
    spark, distance, max_distance, visited, max_urls, max_time, stopped, expected
):
    now = F.to_timestamp(F.lit("2024-01-01 00:01:00"))
    args = [F.lit(x) for x in (distance, max_distance, visited, max_urls)]
    reason = records.stop_reason(*args, now, F.to_timestamp(F.lit(max_time)), F.lit(stopped))
    assert one(spark, reason) == expected


def test_counters_and_flags(spark):
    values = ["12", "-3", "+4", "4.5", "x", "", None, "99999999999"]
    assert many(spark, values, records.int_or_zero) == [12, -3, 4, 0, 0, 0, 0, 0]
    robots = ["User-agent: *\nDisallow:  /x", "Allow: /", None, "disallow:/"]
    assert many(spark, robots, records.is_robots_blocked) == [True, False, False, False]


def test_zone_at_clock_changes(spark):
    walls = ["2024-10-27 01:30:00.7", "2024-03-29 02:30:00", "2024-07-01 12:00:00"]
    got = many(
        spark, walls, lambda v: dates.local_to_utc(v.cast("timestamp_ntz"), "Asia/Jerusalem")
    )
    assert got == [
        dt.datetime(2024, 10, 26, 23, 30),
        dt.datetime(2024, 3, 29, 0, 30),
        dt.datetime(2024, 7, 1, 9, 0),
    ]
    same = dates.same_instant(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))
    assert one(spark, same) is True


@pytest.mark.parametrize(
    "page, text, links",
    [
        ('<a href="/x?a=1&amplitude=2&amp;b=3&amp=4">t</a>', "t", ["/x?a=1&amplitude=2&b=3&amp=4"]),
        ("<body>&#38;amp; &amp;lt; &lt; &amp x</body>", "&amp; &lt; < & x", []),
        ("<body>seen<!-- not <a href='/x'>x</a>", "seen", []),
        ("<body>seen<script>if (a < b) <a href='/x'>", "seen", []),
        ("<head><title>t</title><body>b</body>", "b", []),
        ('<p title="1 > 0">a</p><a title="x > y" href="/q">b</a>', "a b", ["/q"]),
        ("<a title=' href=/no>' data-x = \"<i>\" href='/yes'>c</a><img alt='>'>d", "c d", ["/yes"]),
        ('<a title="open href=/x>e</a>f', "ef", ["/x"]),
        ("3 < 4 and 5 > 4 <b", "3 4", []),
        ('<a\nclass=k href = /n >g</a><abbr href="/no">h</abbr>', "g h", ["/n"]),
    ],
)
def test_pages_that_are_not_well_formed(spark, page, text, links):
    df = spark.createDataFrame([(page,)], "h string")
    row = df.select(html.body_text(F.col("h")), html.hrefs(F.col("h"))).first()
    assert (row[0], row[1]) == (text, links)


def test_a_page_of_openers_ends(spark):
    df = spark.range(1).select(F.repeat(F.lit("<!-- x <script "), 70_000).alias("h"))
    assert df.select(html.body_text(F.col("h"))).first()[0] == ""
    assert df.select(F.size(html.hrefs(F.col("h")))).first()[0] == 0


def test_unclosed_tags_and_quotes_end(spark):
    for opener in ("<a ", "<a x=", "<p title='", "< ", '<a href "'):
        df = spark.range(1).select(F.repeat(F.lit(opener), 1_000_000 // len(opener)).alias("h"))
        row = df.select(F.length(html.body_text(F.col("h"))), F.size(html.hrefs(F.col("h")))).first()
        assert row[1] == 0


def test_words_of_many_scripts(spark):
    df = spark.createDataFrame([("東京都の天気 नमस्ते カタカナー abc1 ́x",)], "t string")
    got = df.select(text.tokens(F.col("t"))).first()[0]
    assert got == ["東", "京", "都", "の", "天", "気", "नमस्ते", "カタカナー", "abc1", "x"]
    marked = df.select(text.mark(F.col("t"), F.array(F.lit("京"), F.lit("abc1")))).first()[0]
    assert marked.startswith("東<em>京</em>都の") and "<em>abc1</em>" in marked


def test_best_passage(spark):
    df = spark.createDataFrame(
        [("One a here. Then b and a. Again a, b! No more.",), ("none at all",), ("a a a. b a. ",), (None,), ("",)],
        "t string",
    )
    terms = F.array(F.lit("a"), F.lit("b"))
    got = [r[0] for r in df.select(text.best_highlight(F.col("t"), terms)).collect()]
    assert got == ["Then <em>b</em> and <em>a</em>.", None, "<em>b</em> <em>a</em>.", None, None]
    shown = df.select(text.snippet(F.lit(None).cast("string"), F.col("t"), terms, best=True))
    assert [r[0] for r in shown.collect()] == [got[0], "", got[2], "", ""]
