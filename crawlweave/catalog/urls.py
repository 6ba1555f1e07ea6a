"""Address queries over every page in 23 forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.catalog.registry import query, table
from crawlweave.catalog.shapes import URL_CASES_SQL, url_cases
from crawlweave.functions import urls


def _over_cases(spark: SparkSession, folder: str, name: str, value: Column) -> DataFrame:
    return url_cases(table(spark, folder, "pages")).select("page_id", "k", value.alias(name))


_TRIM = r"regexp_replace(u, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

# Parts of ``x`` as named columns: scheme, authority, host, port, path, query.
_PARTS = r"""
parts AS (SELECT *, lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS sch,
            regexp_replace(regexp_extract(x, '^[A-Za-z]+://([^/?#]*)', 1), '^[^@]*@', '') AS au,
            replace(regexp_extract(x, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/a/../b', '/b') AS pa,
            regexp_extract(x, '^[^?#]*(\?[^#]*)', 1) AS qu
          FROM given),
split AS (SELECT *, regexp_extract(au, '^([^:]*)', 1) AS ho,
            regexp_extract(au, '^[^:]*:(.*)$', 1) AS po FROM parts),
t AS (SELECT *, coalesce(sch IN ('http', 'https', 'ftp', 'file', 'jar', 'mailto')
            AND regexp_matches(po, '^[0-9]{0,9}$'), FALSE) AS ok FROM split)
"""


@query(
    "url_normalize",
    rf"""WITH {URL_CASES_SQL},
    g AS (SELECT page_id, k, coalesce({_TRIM}, '') AS g0 FROM cases),
    given AS (SELECT page_id, k,
                CASE WHEN g0 LIKE 'http://%' OR g0 LIKE 'https://%' THEN g0
                     ELSE 'https://' || g0 END AS x FROM g),
    {_PARTS}
    SELECT page_id, k,
      CASE WHEN ok AND NOT starts_with(ho, 'www.')
           THEN sch || '://www.' || ho
                || CASE WHEN po = '' THEN '' ELSE ':' || CAST(po AS BIGINT) END || pa || qu
           ELSE x END AS normalized
    FROM t""",
)
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _over_cases(spark, folder, "normalized", urls.normalize(F.col("u")))


@query(
    "url_valid",
    rf"""WITH {URL_CASES_SQL}, given AS (SELECT page_id, k, {_TRIM} AS x FROM cases), {_PARTS}
    SELECT page_id, k, ok AND regexp_matches(x,
      '^[A-Za-z0-9+.-]+:([A-Za-z0-9_.!~*''();/?:@&=+$,#-]|%[0-9A-Fa-f]{{2}}|[^\x00-\x7F])+$')
      AS valid FROM t""",
)
def url_valid(spark: SparkSession, folder: str) -> DataFrame:
    return _over_cases(spark, folder, "valid", urls.is_valid(F.col("u")))


@query(
    "url_homepage",
    rf"""WITH {URL_CASES_SQL}, given AS (SELECT page_id, k, u AS x FROM cases), {_PARTS}
    SELECT page_id, k, CASE WHEN ok THEN pa IN ('', '/') ELSE TRUE END AS homepage FROM t""",
)
def url_homepage(spark: SparkSession, folder: str) -> DataFrame:
    return _over_cases(spark, folder, "homepage", urls.is_homepage(F.col("u")))


@query(
    "url_article",
    rf"""WITH {URL_CASES_SQL}, given AS (SELECT page_id, k, u AS x FROM cases), {_PARTS}
    SELECT page_id, k, coalesce(
        contains(lower(x), '/article/') OR contains(lower(x), '/news/')
        OR regexp_matches(lower(x), '\b(docid|articleid|newsid|storyid|id)=[0-9]+')
        OR regexp_matches(lower(x), '/[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/')
        OR regexp_matches(lower(x), '/[0-9]{{6,}}')
        OR (ok AND len(list_filter(string_split(pa, '/'), lambda s: s <> '')) >= 3), FALSE)
      AS article FROM t""",
)
def url_article(spark: SparkSession, folder: str) -> DataFrame:
    return _over_cases(spark, folder, "article", urls.is_article(F.col("u")))


@query(
    "robots_url",
    rf"""WITH {URL_CASES_SQL}, given AS (SELECT page_id, k, u AS x FROM cases), {_PARTS}
    SELECT page_id, k, CASE WHEN ok THEN sch || '://' || ho || '/robots.txt' END AS robots
    FROM t""",
)
def robots_url(spark: SparkSession, folder: str) -> DataFrame:
    return _over_cases(spark, folder, "robots", urls.robots_url(F.col("u")))
