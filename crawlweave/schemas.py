"""Record layouts as DDL. Wire names are camelCase, table names are snake_case."""

from __future__ import annotations

# JSON field names of the exchanged records.
REQUEST_JSON = "url string, maxDistance int, maxSeconds int, maxUrls int"
RECORD_JSON = (
    "crawlId string, baseUrl string, url string, distance int, maxDistance int, "
    "startTime bigint, maxTime bigint, maxUrls int"
)
STATUS_JSON = (
    "distance int, startTimeMillis bigint, numPages int, stopReason string, "
    "errorMessage string, lastModifiedMillis bigint"
)

# The names a crawl can stop under, in order of precedence.
STOP_REASONS = ("maxDistance", "maxUrls", "timeout", "userInitiated")

REQUESTS = (
    "crawl_id string, url string, max_distance int, max_seconds int, max_urls int, "
    "requested_at timestamp"
)
FRONTIER = (
    "crawl_id string, seq bigint, url string, base_url string, distance int, "
    "start_time timestamp, max_time timestamp, max_distance int, max_urls int"
)
PAGES = "page_id bigint, url string, html string"
LINKS = "src_url string, pos bigint, dst_url string"
DOCS = (
    "crawl_id string, url string, base_url string, title string, content string, "
    "level int, content_type string"
)
STATUS = (
    "crawl_id string, distance int, start_time timestamp, num_pages bigint, "
    "stop_reason string, error_message string, last_modified timestamp"
)
CONTROL = "crawl_id string, stopped_at timestamp, reason string"

#: Columns a child record inherits from its parent.
INHERITED = ("base_url", "start_time", "max_time", "max_distance", "max_urls")
