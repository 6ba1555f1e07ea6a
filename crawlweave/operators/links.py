"""Links of pages: extraction, resolution, scope, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import html, urls
from crawlweave.functions.binding import bind


def _link_base() -> Column:
    """Parts of the address a page's links are relative to."""
    declared = F.col("_declared")
    at = F.when(declared != "", urls.resolve(urls.base_parts(F.col("url")), declared))
    return bind(F.coalesce(at, F.col("url")), urls.base_parts)


def page_hrefs(pages: DataFrame) -> DataFrame:
    """Every anchor's href by position, as written."""
    return pages.select(
        "page_id",
        F.col("url").alias("src_url"),
        F.posexplode(html.hrefs(F.col("html"))).alias("_pos", "href"),
    ).select("page_id", "src_url", F.col("_pos").cast("bigint").alias("pos"), "href")


def with_anchors(pages: DataFrame) -> DataFrame:
    """Pages with ``_hrefs`` as written and the parts they are relative to."""
    return pages.withColumns(
        {"_hrefs": html.hrefs(F.col("html")), "_declared": html.base_href(F.col("html"))}
    ).withColumn("_base", _link_base())


def _resolved() -> Column:
    """The links of a row of ``with_anchors`` that resolve: ``(pos, dst_url)``."""
    every = F.transform(
        "_hrefs",
        lambda h, i: F.struct(
            i.cast("bigint").alias("pos"), urls.resolve(F.col("_base"), h).alias("dst_url")
        ),
    )
    return F.filter(every, lambda l: l["dst_url"].isNotNull())


def with_links(pages: DataFrame) -> DataFrame:
    """Pages with ``links``, the array of ``(pos, dst_url)`` that resolve."""
    return with_anchors(pages).select(*pages.columns, _resolved().alias("links"))


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, src_url, pos, dst_url)``: the resolved links of every page.

    Resolving inside the explode does each link once: no filter on the result
    can pull the work in front of it.
    """
    return inline_links(with_anchors(pages.select("page_id", "url", "html")))


def inline_links(anchored: DataFrame) -> DataFrame:
    """Rows of ``with_anchors`` to ``(page_id, src_url, pos, dst_url)``."""
    return anchored.select("page_id", F.col("url").alias("src_url"), F.inline(_resolved()))


def explode_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").alias("src_url"), F.inline("links"))


def in_scope(dst: Column, base_url: Column, scope: str = "prefix") -> Column:
    """Whether a link stays inside the crawl.

    ``prefix`` compares text, so a base without a trailing slash also admits
    longer host names; ``host`` compares host names; ``any`` takes all pages.
    """
    page = dst.isNotNull() & ~dst.rlike("^(mailto|javascript):")
    if scope == "any":
        return page
    if scope == "host":
        return page & (urls.host(dst) == urls.host(base_url))
    if scope == "prefix":
        return page & dst.startswith(base_url)
    raise ValueError(f"unknown scope {scope!r}")


def scope_links(links: DataFrame, base_url: Column, scope: str = "prefix") -> DataFrame:
    return links.where(in_scope(F.col("dst_url"), base_url, scope))


def distinct_links(links: DataFrame, source: str = "src_url") -> DataFrame:
    """Distinct targets per page, each at its first position."""
    return links.groupBy(source, "dst_url").agg(F.min("pos").alias("pos"))
