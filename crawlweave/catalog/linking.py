"""Links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.catalog.registry import query, table
from crawlweave.catalog.shapes import LINKS_SQL
from crawlweave.functions import urls
from crawlweave.functions.records import slots_left
from crawlweave.operators import frontier as steps
from crawlweave.operators import links as ops
from crawlweave.workspace import Workspace


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos, href FROM raw_links")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return ops.page_hrefs(table(spark, folder, "pages")).select("page_id", "pos", "href")


_HREF_FORMS_SQL = r"""
f AS (SELECT page_id, pos, src_url, href, substr(href, 2) AS word,
        regexp_extract(src_url, '^(https?)', 1) AS sch,
        regexp_extract(src_url, '^(https?://[^/?#]*)', 1) AS site,
        regexp_extract(src_url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(src_url, '^([^#]*)', 1) AS bare
      FROM raw_links),
g AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM f),
forms AS (SELECT page_id, pos, src_url, unnest(range(0, 12)) AS k, unnest([
    site || '/' || word,
    'https://www.o.org/x?y=1#z',
    sch || '://www.t.org/e?z=1',
    site || path || '?p=2',
    bare || '#top',
    site || dir || 'sub/' || word,
    site || regexp_replace(dir, '[^/]*/$', '') || word,
    site || dir || word,
    'mailto:q@t.org',
    site || '/b/' || word,
    NULL,
    'https://o.org/k'
  ]) AS dst_url FROM g)
"""


def _href_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every link of every page, rewritten in 12 ways, and resolved."""
    anchored = ops.with_anchors(table(spark, folder, "pages").select("page_id", "url", "html"))
    forms = F.flatten(F.transform("_hrefs", _forms))
    links = ops.inline_links(anchored.withColumn("_hrefs", forms))
    return links.select(
        "page_id",
        F.floor(F.col("pos") / 12).cast("bigint").alias("pos"),
        (F.col("pos") % 12).alias("k"),
        "src_url",
        "dst_url",
    )


def _forms(href: Column) -> Column:
    lit = F.lit
    word = F.substring_index(href, "/", -1)
    return F.array(
        href,
        lit("https://www.o.org/x?y=1#z"),
        lit("//www.t.org/e?z=1"),
        lit("?p=2"),
        lit("#top"),
        F.concat(lit("sub/"), word),
        F.concat(lit("../"), word),
        F.concat(lit("./"), word),
        lit("mailto:q@t.org"),
        F.concat(lit("/a/../b/./"), word),
        lit("http://www.o.org:bad/"),
        lit(" https://u:p@o.org/k\n"),
    )


@query(
    "resolve_links",
    f"""WITH {LINKS_SQL}, {_HREF_FORMS_SQL}
    SELECT page_id, pos, k, dst_url FROM forms WHERE dst_url IS NOT NULL""",
)
def resolve_links(spark: SparkSession, folder: str) -> DataFrame:
    return _href_forms(spark, folder).select("page_id", "pos", "k", "dst_url")


@query(
    "scope_links",
    f"""WITH {LINKS_SQL}, {_HREF_FORMS_SQL},
    s AS (SELECT *, regexp_extract(src_url, '^(https?://[^/?#]*)', 1) AS site FROM forms)
    SELECT page_id, pos, k, starts_with(dst_url, site || '/') AS by_prefix,
           regexp_extract(dst_url, '^[a-z]+://([^/?#:]*)', 1)
             = regexp_extract(site, '^https?://([^/?#:]*)', 1) AS by_host
    FROM s WHERE dst_url IS NOT NULL AND NOT regexp_matches(dst_url, '^(mailto|javascript):')""",
)
def scope_links(spark: SparkSession, folder: str) -> DataFrame:
    resolved = _href_forms(spark, folder)
    base = F.concat(urls.site(F.col("src_url")), F.lit("/"))
    dst = F.col("dst_url")
    return ops.scope_links(resolved, base, "any").select(
        "page_id",
        "pos",
        "k",
        ops.in_scope(dst, base, "prefix").alias("by_prefix"),
        ops.in_scope(dst, base, "host").alias("by_host"),
    )


@query(
    "distinct_links",
    f"WITH {LINKS_SQL} SELECT page_id, dst_url, min(pos) AS pos FROM links GROUP BY 1, 2",
)
def distinct_links(spark: SparkSession, folder: str) -> DataFrame:
    links = ops.page_links(table(spark, folder, "pages"))
    return ops.distinct_links(links, "page_id")


def page_frontier(pages: DataFrame) -> DataFrame:
    """Each page as a frontier record of its site's crawl."""
    pid = F.col("page_id")
    return pages.select(
        urls.host(F.col("url")).alias("crawl_id"),
        pid.alias("seq"),
        "url",
        F.concat(urls.site(F.col("url")), F.lit("/")).alias("base_url"),
        (pid % 3).cast("int").alias("distance"),
        (pid % 9).cast("int").alias("max_urls"),
    )


@query(
    "child_records",
    f"""WITH {LINKS_SQL}
    SELECT regexp_extract(src_url, '^https?://([^/?#]*)', 1) AS crawl_id, page_id AS parent_seq,
           pos, dst_url AS url, page_id % 3 + 1 AS distance,
           regexp_extract(src_url, '^(https?://[^/?#]*)', 1) || '/' AS base_url,
           page_id % 9 AS max_urls
    FROM links""",
)
def child_records(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    links = ops.page_links(pages).drop("page_id")
    children = steps.child_records(page_frontier(pages), links)
    return children.withColumns(
        {c: F.col(c).cast("bigint") for c in ("distance", "max_urls")}
    )


@query(
    "budget_limit",
    f"""WITH {LINKS_SQL},
    d AS (SELECT page_id, src_url, dst_url, min(pos) AS pos FROM links GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n,
            CASE WHEN page_id % 9 > 0 THEN page_id % 9 - page_id % 4 ELSE 2147483647 END AS slots
          FROM d)
    SELECT page_id AS seq, dst_url, pos, slots FROM r WHERE n <= slots""",
)
def budget_limit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = ops.distinct_links(ops.page_links(pages).drop("src_url"), "page_id")
    frontier = page_frontier(pages).select(
        "crawl_id",
        "seq",
        slots_left(F.col("max_urls"), F.col("seq") % 4).cast("bigint").alias("slots"),
    )
    links = found.withColumnRenamed("page_id", "seq").join(frontier, "seq")
    return steps.limit_links(links).select("seq", "dst_url", "pos", "slots")


@query(
    "frontier_new",
    f"""WITH {LINKS_SQL},
    l AS (SELECT *, regexp_extract(src_url, '^https?://([^/?#]*)', 1) AS crawl_id FROM links),
    visited AS (SELECT DISTINCT crawl_id, dst_url FROM l WHERE src_url LIKE '%/de/%'),
    first AS (SELECT *, row_number() OVER
                (PARTITION BY crawl_id, dst_url ORDER BY page_id, pos) AS n FROM l),
    new AS (SELECT f.crawl_id, f.dst_url, f.page_id, f.pos FROM first f
            LEFT JOIN visited v ON f.crawl_id = v.crawl_id AND f.dst_url = v.dst_url
            WHERE n = 1 AND v.dst_url IS NULL)
    SELECT crawl_id, dst_url AS url, page_id AS parent_seq, pos,
           row_number() OVER (PARTITION BY crawl_id ORDER BY page_id, pos) - 1 AS nth
    FROM new""",
)
def frontier_new(spark: SparkSession, folder: str) -> DataFrame:
    links = ops.page_links(table(spark, folder, "pages")).select(
        urls.host(F.col("src_url")).alias("crawl_id"),
        F.col("dst_url").alias("url"),
        F.col("page_id").alias("parent_seq"),
        "pos",
        "src_url",
    )
    links = Workspace(spark).save(links, "links")
    visited = links.where(F.col("src_url").contains("/de/")).select("crawl_id", "url").distinct()
    claims = steps.not_visited(steps.claim_first(links), visited)
    return steps.number_claims(Workspace(spark).save(claims, "claims"))
