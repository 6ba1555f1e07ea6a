"""Crawl and retrieval analytics as Spark DataFrame jobs.

``functions``  Column helpers (URLs, HTML, text, dates, crawl records)
``sources``    typed readers and writers for requests, frontier, pages, documents
``operators``  one relational step each: DataFrame in, DataFrame out, no actions
``plans``      whole jobs built from the operators (crawl, index, search, progress)
``streaming``  the same steps on Structured Streaming
``catalog``    the registered queries and the SQL that checks them
"""

from crawlweave.session import build_session
from crawlweave.workspace import Workspace

__all__ = ["Workspace", "build_session"]
