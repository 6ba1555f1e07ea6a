"""Requests, wire records, page fetch, page text and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.catalog.registry import query, table
from crawlweave.catalog.shapes import (
    LINKS_SQL,
    LOG_SQL,
    SITE_PAGES_SQL,
    body_sql,
    crawl_log,
    millis,
    site_pages,
    title_sql,
)
from crawlweave.functions import html, records, urls
from crawlweave.operators import gate
from crawlweave.operators.links import page_links
from crawlweave.plans.search import page_docs
from crawlweave.sources import documents, frontier, requests
from crawlweave.sources.attempts import UNSEEN
from crawlweave.sources.attempts import fetch_attempts as try_fetch
from crawlweave.sources.pages import BODY_CAP, cap_body, fetch, latest_by_url
from crawlweave.workspace import Workspace

# --- requests ---------------------------------------------------------------------


@query(
    "request_parse",
    """SELECT page_id,
         CASE WHEN page_id % 5 IN (3, 4) THEN NULL ELSE url END AS url,
         CASE WHEN page_id % 5 IN (0, 1) THEN page_id % 4 ELSE 0 END AS max_distance,
         CAST(CASE WHEN page_id % 5 = 0 THEN 60 ELSE 0 END AS BIGINT) AS max_seconds,
         CASE WHEN page_id % 5 IN (0, 3) THEN page_id ELSE 0 END AS max_urls
       FROM pages""",
)
def request_parse(spark: SparkSession, folder: str) -> DataFrame:
    pid = F.col("page_id")
    full = F.to_json(
        F.struct(
            "url",
            (pid % 4).alias("maxDistance"),
            F.lit(60).alias("maxSeconds"),
            pid.alias("maxUrls"),
        )
    )
    body = (
        F.when(pid % 5 == 0, full)
        .when(pid % 5 == 1, F.to_json(F.struct("url", (pid % 4).alias("maxDistance"))))
        .when(pid % 5 == 2, F.to_json(F.struct("url")))
        .when(pid % 5 == 3, F.to_json(F.struct(pid.alias("maxUrls"))))
        .otherwise(F.lit("not json"))
    )
    parsed = requests.parse_requests(
        table(spark, folder, "pages").select("page_id", body.alias("value"))
    )
    limits = ["max_distance", "max_seconds", "max_urls"]
    return parsed.select("page_id", "url", *[F.col(c).cast("bigint").alias(c) for c in limits])


_REQUESTS_SQL = """
req AS (SELECT 'c' || page_id AS crawl_id,
          CASE page_id % 6 WHEN 1 THEN 'https://a b/' WHEN 2 THEN 'www.no-scheme.org'
                           WHEN 3 THEN NULL WHEN 4 THEN 'foo://x/' ELSE url END AS url,
          page_id % 4 - 1 AS max_distance, page_id % 90 AS max_seconds, page_id % 7 AS max_urls,
          1704067200000 + page_id * 1000 AS start_ms FROM pages)
"""


@query(
    "seed_records",
    f"""WITH {_REQUESTS_SQL}
    SELECT crawl_id, url, url AS base_url, CAST(0 AS BIGINT) AS distance, max_distance, max_urls, start_ms,
           start_ms + max_seconds * 1000 AS deadline_ms, NULL AS message
    FROM req WHERE url LIKE 'http%' AND url NOT LIKE '% %'
    UNION ALL
    SELECT crawl_id, url, NULL, NULL, NULL, NULL, NULL, NULL,
           'Invalid URL format: ' || coalesce(url, '')
    FROM req WHERE url IS NULL OR NOT (url LIKE 'http%' AND url NOT LIKE '% %')""",
)
def seed_records(spark: SparkSession, folder: str) -> DataFrame:
    pid = F.col("page_id")
    asked = table(spark, folder, "pages").select(
        F.concat(F.lit("c"), pid.cast("string")).alias("crawl_id"),
        F.when(pid % 6 == 1, "https://a b/")
        .when(pid % 6 == 2, "www.no-scheme.org")
        .when(pid % 6 == 4, "foo://x/")
        .when(pid % 6 != 3, F.col("url"))
        .alias("url"),
        (pid % 4 - 1).cast("int").alias("max_distance"),
        (pid % 90).cast("int").alias("max_seconds"),
        (pid % 7).cast("int").alias("max_urls"),
        F.timestamp_millis(F.lit(1704067200000) + pid * 1000).alias("requested_at"),
    )
    seeds = requests.seed_records(asked).select(
        "crawl_id",
        "url",
        "base_url",
        *[F.col(c).cast("bigint").alias(c) for c in ("distance", "max_distance", "max_urls")],
        millis(F.col("start_time")).alias("start_ms"),
        millis(F.col("max_time")).alias("deadline_ms"),
    )
    return seeds.unionByName(requests.rejected_requests(asked), allowMissingColumns=True)


# --- wire records -------------------------------------------------------------------

_MESSAGE_SQL = """'{"crawlId":"' || crawl_id || '","baseUrl":"https://www.s.org/","url":"' || url
  || '","distance":' || distance || ',"maxDistance":' || max_distance
  || ',"startTime":' || (epoch_us(noted) // 1000) || ',"maxTime":' || (epoch_us(max_time) // 1000)
  || ',"maxUrls":' || max_urls || '}'"""


def _log_records(spark: SparkSession, folder: str) -> DataFrame:
    return crawl_log(table(spark, folder, "events")).withColumns(
        {"base_url": F.lit("https://www.s.org/"), "start_time": F.col("at")}
    )


@query("frontier_encode", f"WITH {LOG_SQL} SELECT seq, {_MESSAGE_SQL} AS value FROM log")
def frontier_encode(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.encode_records(_log_records(spark, folder), keep=("seq",))


def wire_messages(log: DataFrame) -> DataFrame:
    """Messages as a topic may hold them: plain, doubly encoded, or null on errors."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("value"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    value = F.when(
        F.col("event_type") != "error",
        F.when(F.col("seq") % 2 == 1, quoted).otherwise(F.col("value")),
    )
    encoded = frontier.encode_records(log, keep=("seq", "event_type"))
    return encoded.select("seq", value.alias("value"))


def wire_view(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "seq",
        "crawl_id",
        "url",
        "base_url",
        *[F.col(c).cast("bigint").alias(c) for c in ("distance", "max_distance", "max_urls")],
        millis(F.col("start_time")).alias("start_ms"),
        millis(F.col("max_time")).alias("deadline_ms"),
    )


WIRE_SQL = f"""WITH {LOG_SQL}
    SELECT seq, crawl_id, url, 'https://www.s.org/' AS base_url, distance, max_distance, max_urls,
           (epoch_us(noted) // 1000) AS start_ms, (epoch_us(max_time) // 1000) AS deadline_ms
    FROM log WHERE event_type <> 'error'"""


@query("frontier_decode", WIRE_SQL)
def frontier_decode(spark: SparkSession, folder: str) -> DataFrame:
    return wire_view(frontier.decode_records(wire_messages(_log_records(spark, folder))))


# --- fetch --------------------------------------------------------------------------


@query(
    "fetch_join",
    f"""WITH {LINKS_SQL},
    front AS (SELECT page_id AS asker, -1 AS pos, url FROM pages
              UNION ALL SELECT page_id, pos, dst_url FROM links)
    SELECT f.asker, f.pos, f.url, p.page_id, p.page_id IS NOT NULL AS found,
           octet_length(encode(p.html)) AS n_bytes
    FROM front f LEFT JOIN pages p ON f.url = p.url""",
)
def fetch_join(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    asked = pages.select(
        F.col("page_id").alias("asker"), F.lit(-1).cast("bigint").alias("pos"), "url"
    ).unionByName(
        page_links(pages).select(
            F.col("page_id").alias("asker"), "pos", F.col("dst_url").alias("url")
        )
    )
    sizes = pages.select(
        "url", "page_id", F.octet_length("html").cast("bigint").alias("n_bytes")
    )
    found = fetch(asked, latest_by_url(sizes, ["n_bytes"]))
    return found.select("asker", "pos", "url", "page_id", "found", "n_bytes")


# A thousand times faster than the event table, so that tries meet other observations.
_EPOCH = 1704067200000000
_FAST = f"({_EPOCH} + (epoch_us(ts) - {_EPOCH}) // 1000)"


@query(
    "fetch_attempts",
    f"""WITH seen AS (SELECT event_id AS page_id, 'https://www.s.org/' || (event_id * 7 % 40) AS url,
                {_FAST} AS us,
                CASE WHEN event_type IN ('error', 'view') THEN 'Failed: ' || event_type END AS error
              FROM events),
    states AS (SELECT * FROM seen QUALIFY row_number() OVER
                 (PARTITION BY url, us ORDER BY error IS NOT NULL DESC, error DESC, page_id DESC) = 1),
    tries AS (SELECT event_id AS ask_id, 'https://www.s.org/' || (event_id % 41) AS url, k,
                {_FAST} + event_id * 37 % 2000000 - 1000000 + (2 ** k - 1)::BIGINT * 1000000 AS us
              FROM events, (VALUES (0), (1), (2)) AS f(k)),
    found AS (SELECT t.ask_id, t.url, t.k, t.us, s.page_id,
                CASE WHEN s.us IS NULL THEN '{UNSEEN}' ELSE s.error END AS error
              FROM tries t ASOF LEFT JOIN states s ON t.url = s.url AND t.us >= s.us),
    good AS (SELECT ask_id, min(k) AS k FROM found WHERE error IS NULL GROUP BY 1)
    SELECT f.ask_id, f.url, CAST(f.k + 1 AS BIGINT) AS attempts,
           CASE WHEN f.error IS NULL THEN f.us END AS fetched_us,
           CASE WHEN f.error IS NULL THEN f.page_id END AS page_id, f.error
    FROM found f LEFT JOIN good g ON f.ask_id = g.ask_id
    WHERE f.k = coalesce(g.k, 2)""",
)
def fetch_attempts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    event, kind = F.col("event_id"), F.col("event_type")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH
    fast = _EPOCH + F.floor(since / 1000).cast("bigint")
    site = F.lit("https://www.s.org/")
    observed = events.select(
        event.alias("page_id"),
        F.concat(site, (event * 7 % 40).cast("string")).alias("url"),
        F.timestamp_micros(fast).alias("seen_at"),
        F.when(kind.isin("error", "view"), F.concat(F.lit("Failed: "), kind)).alias("error"),
    )
    asks = events.select(
        event.alias("ask_id"),
        F.concat(site, (event % 41).cast("string")).alias("url"),
        F.timestamp_micros(fast + event * 37 % 2000000 - 1000000).alias("asked_at"),
    )
    return try_fetch(asks, observed).select(
        "ask_id", "url", "attempts", F.unix_micros("fetched_at").alias("fetched_us"), "page_id", "error"
    )


@query(
    "body_cap",
    f"""WITH b AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages)
    SELECT page_id, n AS n_bytes, least(n, {BODY_CAP}) AS kept_bytes, n > {BODY_CAP} AS truncated
    FROM b""",
)
def body_cap(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    n = F.octet_length("html").cast("bigint")
    return cap_body(pages.withColumn("n_bytes", n)).select(
        "page_id", "n_bytes", n.alias("kept_bytes"), "truncated"
    )


@query(
    "accessible",
    f"""WITH {SITE_PAGES_SQL}
    SELECT page_id, coalesce(status_code < 400, FALSE) AS accessible FROM site_pages""",
)
def accessible(spark: SparkSession, folder: str) -> DataFrame:
    pages = site_pages(table(spark, folder, "pages"))
    return gate.with_access(pages).select("page_id", "accessible")


@query(
    "access_message",
    f"""WITH {SITE_PAGES_SQL},
    u AS (SELECT page_id, CAST(k AS BIGINT) AS k, status_code, robots_txt,
            CASE k WHEN 0 THEN url ELSE 'foo://' || page_id || '/' END AS url
          FROM site_pages, (VALUES (0), (1)) AS f(k))
    SELECT page_id, k, CASE
        WHEN k = 1 THEN 'Invalid URL format: ' || url
        WHEN status_code IS NULL THEN 'Failed to check accessibility: ' || url
        WHEN status_code >= 400
          THEN 'URL is not accessible or returned an error (status code >= 400): ' || url
        WHEN contains(lower(robots_txt), 'disallow: /')
          THEN 'Crawling may be restricted by robots.txt for ' || url || ' (proceeding with caution)'
        ELSE 'No specific error (check logs for details)' END AS message
    FROM u""",
)
def access_message(spark: SparkSession, folder: str) -> DataFrame:
    forms = F.array(
        F.col("url"), F.concat(F.lit("foo://"), F.col("page_id").cast("string"), F.lit("/"))
    )
    pages = site_pages(table(spark, folder, "pages"))
    return pages.select(
        "page_id", "status_code", "robots_txt", F.posexplode(forms).alias("k", "url")
    ).select(
        "page_id",
        F.col("k").cast("bigint").alias("k"),
        records.access_message(
            F.col("url"), urls.is_parseable(F.col("url")), F.col("status_code"), F.col("robots_txt")
        ).alias("message"),
    )


@query(
    "robots_flag",
    f"""WITH {SITE_PAGES_SQL}
    SELECT page_id, coalesce(contains(lower(robots_txt), 'disallow: /'), FALSE) AS blocked
    FROM site_pages""",
)
def robots_flag(spark: SparkSession, folder: str) -> DataFrame:
    pages = site_pages(table(spark, folder, "pages"))
    return pages.select("page_id", records.is_robots_blocked(F.col("robots_txt")).alias("blocked"))


# --- page text and documents ------------------------------------------------------------


@query("page_text", f"SELECT page_id, {body_sql()} AS content FROM pages")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", html.body_text(F.col("html")).alias("content")
    )


@query("page_text_quoted", f"SELECT page_id, {body_sql()} AS content FROM pages")
def page_text_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph gets attributes that hold a tag's end and a tag: the text stays."""
    marked = F.replace(F.col("html"), F.lit("<p>"), F.lit("""<p title="a > b" data-x = '<i>'>"""))
    return table(spark, folder, "pages").select("page_id", html.body_text(marked).alias("content"))


@query("page_title", f"SELECT page_id, {title_sql()} AS title FROM pages")
def page_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", html.title(F.col("html")).alias("title")
    )


@query(
    "content_gate",
    f"""WITH {SITE_PAGES_SQL},
    t AS (SELECT page_id, status_code, {body_sql()} AS content,
            regexp_matches(html, 'href="/') AS has_link FROM site_pages)
    SELECT page_id, CASE WHEN length(content) >= 10 OR has_link THEN 'index' ELSE 'reject' END
      AS verdict FROM t WHERE status_code < 400""",
)
def content_gate(spark: SparkSession, folder: str) -> DataFrame:
    pages = site_pages(table(spark, folder, "pages"))
    fetched = gate.with_access(pages).where("accessible").select(
        "page_id",
        F.concat(urls.site(F.col("url")), F.lit("/")).alias("base_url"),
        F.length(html.body_text(F.col("html"))).alias("text_length"),
    )
    worth, minimal = gate.split_by_content(fetched, page_links(pages))
    return worth.select("page_id", F.lit("index").alias("verdict")).unionByName(
        minimal.select("page_id", F.lit("reject").alias("verdict"))
    )


_DOC_SQL = f"""
docs AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/' AS base_url,
           {title_sql()} AS title, {body_sql()} AS content FROM pages)
"""


def crawled_docs(pages: DataFrame) -> DataFrame:
    return page_docs(pages).withColumns(
        {
            "base_url": F.concat(urls.site(F.col("url")), F.lit("/")),
            "crawl_id": urls.host(F.col("url")),
            "distance": (F.col("doc_id") % 3).cast("int"),
        }
    )


@query(
    "index_docs",
    f"""WITH {_DOC_SQL}
    SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS crawl_id, url, base_url, title, content,
           page_id % 3 AS level, 'html' AS content_type FROM docs""",
)
def index_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents.index_docs(crawled_docs(table(spark, folder, "pages")))
    stored = Workspace(spark).save(docs, "index_docs")
    return stored.drop("doc_key").withColumn("level", F.col("level").cast("bigint"))


@query(
    "doc_dedup",
    f"""WITH {_DOC_SQL},
    all_docs AS (SELECT c AS crawl_id, url, base_url, content,
                   CAST(CASE WHEN c = 'x3' AND page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS level
                 FROM docs, (VALUES ('x1'), ('x2'), ('x3')) AS v(c))
    SELECT min(crawl_id) AS crawl_id, url, base_url, content, level, 'html' AS content_type,
           count(*) AS copies
    FROM all_docs GROUP BY url, base_url, content, level""",
)
def doc_dedup(spark: SparkSession, folder: str) -> DataFrame:
    crawls = F.array(F.lit("x1"), F.lit("x2"), F.lit("x3"))
    found = crawled_docs(table(spark, folder, "pages")).withColumn("crawl_id", F.explode(crawls))
    moved = (F.col("crawl_id") == "x3") & (F.col("doc_id") % 2 == 0)
    docs = documents.index_docs(found.withColumn("distance", F.when(moved, 2).otherwise(1)))
    return documents.dedup_docs(docs).withColumn("level", F.col("level").cast("bigint"))


