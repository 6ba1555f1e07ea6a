"""Inputs derived from the data folder, and the same in SQL.

The tables hold no crawl log, no odd URLs and no failing pages, so these build
them row by row from whole tables; sizes follow the tables'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import urls

# --- page addresses and variants of them -------------------------------------

_VARIANTS_SQL = r"""[
    url,
    site || '/',
    site,
    regexp_replace(url, '^https?://', ''),
    site || '/news/' || page_id,
    site || '/a/b?docid=' || page_id,
    site || '/2024/01/05/s',
    site || '/' || (1000000 + page_id),
    site || '/a/b/c',
    site || '/a?pid=' || page_id,
    '  ' || url || chr(9),
    site || ':8081/p?x=1#f',
    scheme || '://u:p@' || host || '/a',
    site || ':bad/',
    NULL,
    '',
    upper(site) || '/Q',
    'ftp://' || host || '/x',
    site || '/a b',
    site || '/%zz',
    site || '/a/../b',
    site || '/x/Article/y?k=' || page_id,
    'foo://' || host || '/'
  ]"""

URL_CASES_SQL = rf"""
v AS (SELECT page_id, url,
        regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
        regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
        regexp_extract(url, '^(https?)', 1) AS scheme
      FROM pages),
cases AS (SELECT page_id, unnest({_VARIANTS_SQL}) AS u, unnest(range(0, 23)) AS k FROM v)
"""


def url_cases(pages: DataFrame) -> DataFrame:
    """``(page_id, k, u)``: each page address in 23 forms."""
    url, pid = F.col("url"), F.col("page_id").cast("string")
    site, host, scheme = urls.site(url), urls.authority(url), urls.scheme(url)
    lit = F.lit
    forms = F.array(
        url,
        F.concat(site, lit("/")),
        site,
        F.regexp_replace(url, "^https?://", ""),
        F.concat(site, lit("/news/"), pid),
        F.concat(site, lit("/a/b?docid="), pid),
        F.concat(site, lit("/2024/01/05/s")),
        F.concat(site, lit("/"), (F.col("page_id") + 1000000).cast("string")),
        F.concat(site, lit("/a/b/c")),
        F.concat(site, lit("/a?pid="), pid),
        F.concat(lit("  "), url, lit("\t")),
        F.concat(site, lit(":8081/p?x=1#f")),
        F.concat(scheme, lit("://u:p@"), host, lit("/a")),
        F.concat(site, lit(":bad/")),
        lit(None).cast("string"),
        lit(""),
        F.concat(F.upper(site), lit("/Q")),
        F.concat(lit("ftp://"), host, lit("/x")),
        F.concat(site, lit("/a b")),
        F.concat(site, lit("/%zz")),
        F.concat(site, lit("/a/../b")),
        F.concat(site, lit("/x/Article/y?k="), pid),
        F.concat(lit("foo://"), host, lit("/")),
    )
    return pages.select("page_id", F.posexplode(forms).alias("k", "u")).withColumn(
        "k", F.col("k").cast("bigint")
    )


# --- crawl log ----------------------------------------------------------------

LOG_SQL = """
log AS (SELECT CAST(user_id AS VARCHAR) AS crawl_id, event_id AS seq,
          'https://www.s.org/' || (event_id * 7 % 40) AS url,
          event_id % 5 AS distance,
          CASE event_type WHEN 'error' THEN 'userInitiated'
                          WHEN 'signup' THEN 'noSuchReason' END AS stop_reason,
          CASE WHEN event_type = 'error' THEN event_type END AS error_message,
          user_id % 4 - 1 AS max_distance,
          user_id % 3 * 10 AS max_urls,
          ts AS noted, ts + to_minutes(CAST(user_id % 100 AS INTEGER)) AS max_time,
          event_type
        FROM events)
"""


def crawl_log(events: DataFrame) -> DataFrame:
    """One row per crawl record, from the event table; batch or stream."""
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").cast("string").alias("crawl_id"),
        F.col("event_id").alias("seq"),
        F.concat(
            F.lit("https://www.s.org/"), (F.col("event_id") * 7 % 40).cast("string")
        ).alias("url"),
        (F.col("event_id") % 5).cast("int").alias("distance"),
        F.when(kind == "error", "userInitiated")
        .when(kind == "signup", "noSuchReason")
        .alias("stop_reason"),
        F.when(kind == "error", kind).alias("error_message"),
        (F.col("user_id") % 4 - 1).cast("int").alias("max_distance"),
        (F.col("user_id") % 3 * 10).cast("int").alias("max_urls"),
        at.alias("at"),
        F.timestamp_micros(F.unix_micros(at) + F.col("user_id") % 100 * 60000000).alias(
            "max_time"
        ),
        kind.alias("event_type"),
    )


CONTROL_SQL = """
control AS (SELECT CAST(user_id AS VARCHAR) AS crawl_id, min(ts) AS stopped_at
            FROM events WHERE event_type = 'error' AND value > 140 GROUP BY 1)
"""


def stop_signals(events: DataFrame) -> DataFrame:
    """Crawls somebody stopped, one row each."""
    return (
        events.where((F.col("event_type") == "error") & (F.col("value") > 140))
        .groupBy(F.col("user_id").cast("string").alias("crawl_id"))
        .agg(F.min(F.col("ts").cast("timestamp")).alias("stopped_at"))
        .withColumn("reason", F.lit("Manually stopped by user"))
    )


# --- pages with a status code, and thin pages ----------------------------------

SITE_PAGES_SQL = r"""
site_pages AS (SELECT page_id, url,
    CASE page_id % 4 WHEN 1 THEN '<body>hi<a href="/a">x</a></body>'
                     WHEN 2 THEN '<body> hi </body>'
                     ELSE html END AS html,
    CASE page_id % 7 WHEN 1 THEN 404 WHEN 2 THEN NULL WHEN 3 THEN 301
                     WHEN 4 THEN 503 ELSE 200 END AS status_code,
    CASE page_id % 3 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /x'
                     WHEN 1 THEN 'User-agent: *' || chr(10) || 'Allow: /' END AS robots_txt
  FROM pages)
"""


def site_pages(pages: DataFrame) -> DataFrame:
    """Every page with a status, a robots text, and some bodies swapped for thin ones."""
    pid = F.col("page_id")
    agent = "User-agent: *\n"
    return pages.select(
        "page_id",
        "url",
        F.when(pid % 4 == 1, '<body>hi<a href="/a">x</a></body>')
        .when(pid % 4 == 2, "<body> hi </body>")
        .otherwise(F.col("html"))
        .alias("html"),
        F.when(pid % 7 == 1, 404)
        .when(pid % 7 == 2, F.lit(None).cast("int"))
        .when(pid % 7 == 3, 301)
        .when(pid % 7 == 4, 503)
        .otherwise(200)
        .alias("status_code"),
        F.when(pid % 3 == 0, agent + "Disallow: /x")
        .when(pid % 3 == 1, agent + "Allow: /")
        .alias("robots_txt"),
    )


# --- text of pages ---------------------------------------------------------------


def entity_sql(expr: str) -> str:
    for entity, char in (
        ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
        ("&nbsp;", " "),
    ):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


def body_sql(html: str = "html") -> str:
    expr = html
    for pattern in (
        r"(?is)<head\b.*?</head>", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>",
        r"(?s)<!--.*?-->", r"(?i)</?(a|b|i|em|strong|span|u|small|sub|sup|code)(\s[^>]*)?>",
    ):
        expr = f"regexp_replace({expr}, '{pattern}', '', 'g')"
    expr = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({entity_sql(expr)}, '[ \t\r\n\f]+', ' ', 'g'))"


def title_sql(html: str = "html") -> str:
    found = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    return rf"trim(regexp_replace({entity_sql(found)}, '[ \t\r\n\f]+', ' ', 'g'))"


LINKS_SQL = r"""
hrefs AS (SELECT page_id, url AS src_url,
            regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS l FROM pages),
raw_links AS (SELECT page_id, src_url, unnest(l) AS href, unnest(range(0, len(l))) AS pos
              FROM hrefs),
links AS (SELECT page_id, src_url, pos,
            regexp_extract(src_url, '^(https?://[^/?#]*)', 1) || href AS dst_url
          FROM raw_links)
"""


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
