"""URL splitting, clean-up, tests and resolution.

Parts are cut with regular expressions, so odd input (unescaped spaces,
underscores in host names) yields parts rather than nulls or errors. Only
``is_valid`` applies strict URI rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.functions.binding import bind

# Schemes a URL may carry to count as parseable.
KNOWN_SCHEMES = ("http", "https", "ftp", "file", "jar", "mailto")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_PLAIN = r"^https?://[A-Za-z0-9.\-]+(?::[0-9]{1,9})?(?:[/?#]|$)"


def trim_controls(c: Column) -> Column:
    """Drop leading and trailing characters up to and including the space."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host and port without user-info; empty when there are several ``@``."""
    return F.regexp_replace(
        F.regexp_extract(url, _AFTER_SCHEME + r"//([^/?#]*)", 1), r"^[^@]*@(?:.*@.*)?", ""
    )


def host(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(\[[^\]]*\]|[^:]*)", 1)


def port_text(url: Column) -> Column:
    """The text after the host's colon, empty when there is none."""
    return F.regexp_extract(authority(url), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return bind(raw, lambda p: _clean(p, True))


def _clean(p: Column, keep_leading: bool) -> Column:
    return F.when(p.contains("/."), collapse_dots(p, keep_leading)).otherwise(p)


def query(url: Column) -> Column:
    """Query with its ``?``, empty when absent."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def is_parseable(url: Column) -> Column:
    """Known scheme and, if a port is given, a numeric one; false for null."""
    return F.coalesce(
        scheme(url).isin(*KNOWN_SCHEMES) & port_text(url).rlike(r"^[0-9]{0,9}$"), F.lit(False)
    )


def collapse_dots(p: Column, keep_leading: bool = True) -> Column:
    """Apply ``.`` and ``..`` path segments.

    A ``..`` with nothing before it stays when ``keep_leading``, else is dropped.
    """
    up = F.lit("..")
    parts = F.split(F.regexp_replace(p, "^/", ""), "/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & F.coalesce(
            F.try_element_at(done, F.lit(-1)) != up, F.lit(True)
        )
        blocked = F.array_append(done, up) if keep_leading else done
        return (
            F.when(part == ".", done)
            .when((part == up) & can_pop, F.slice(done, F.lit(1), F.size(done) - 1))
            .when(part == up, blocked)
            .otherwise(F.array_append(done, part))
        )

    def finish(done: Column) -> Column:
        last_up = F.try_element_at(done, F.lit(-1)) == up
        ends_in_dots = p.rlike(r"(^|/)\.{1,2}$") & (F.size(done) > 0) & ~last_up
        tail = F.when(ends_in_dots, F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(done, "/"), tail)

    return F.aggregate(parts, empty, step, finish)


def normalize(url: Column) -> Column:
    """Seed clean-up: trim, default to https, put the host on ``www.``.

    The rewrite onto ``www.`` drops fragment and user-info; a URL whose host is
    already there, or that does not parse, is left as it is.
    """
    given = trim_controls(F.coalesce(url, F.lit("")))

    def with_scheme(g: Column) -> Column:
        return F.when(g.rlike("^https?://"), g).otherwise(F.concat(F.lit("https://"), g))

    def on_www(full: Column) -> Column:
        port = F.when(port_text(full) == "", F.lit("")).otherwise(
            F.concat(F.lit(":"), port_text(full).try_cast("bigint").cast("string"))
        )
        rebuilt = F.concat(
            scheme(full), F.lit("://www."), host(full), port, path(full), query(full)
        )
        return F.when(is_parseable(full) & ~host(full).startswith("www."), rebuilt).otherwise(full)

    return bind(bind(given, with_scheme), on_www)


def is_valid(url: Column) -> Column:
    """Parses as a URL with a known scheme and as a strict URI."""

    def strict(bare: Column) -> Column:
        uri = F.try_parse_url(bare, F.lit("PROTOCOL")).isNotNull()
        return is_parseable(bare) & F.coalesce(uri, F.lit(False))

    return bind(trim_controls(url), strict)


def is_homepage(url: Column) -> Column:
    """Empty or root path; a URL that does not parse counts as one."""
    return F.when(is_parseable(url), trim_controls(path(url)).isin("", "/")).otherwise(True)


# Substrings and patterns that mark an article address.
ARTICLE_WORDS = ("/article/", "/news/")
ARTICLE_PATTERNS = (
    r"\b(docid|articleid|newsid|storyid|id)=\d+",
    r"/\d{4}/\d{2}/\d{2}/",
    r"/\d{6,}",
)
ARTICLE_DEPTH = 3


def is_article(url: Column) -> Column:
    """Marker word, id parameter, date path, long number, or a deep path."""
    low = F.lower(url)
    depth = F.size(F.filter(F.split(path(url), "/"), lambda part: part != ""))
    found = is_parseable(url) & (depth >= ARTICLE_DEPTH)
    for pattern in ARTICLE_PATTERNS:
        found = low.rlike(pattern) | found
    for word in ARTICLE_WORDS:
        found = low.contains(word) | found
    return F.coalesce(found, F.lit(False))


def robots_url(url: Column) -> Column:
    """Where the site keeps robots.txt; the port is left out."""
    return F.when(
        is_parseable(url), F.concat(scheme(url), F.lit("://"), host(url), F.lit("/robots.txt"))
    )


def site(url: Column) -> Column:
    """``scheme://authority``, with nothing after it."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def base_parts(base: Column) -> Column:
    """What ``resolve`` needs of a page address; build it once per page."""
    return F.struct(
        scheme(base).alias("scheme"),
        F.concat(scheme(base), F.lit("://"), authority(base)).alias("prefix"),
        path(base).alias("path"),
        query(base).alias("query"),
        F.regexp_extract(base, r"^[^?#]*(.*)$", 1).alias("tail"),
        is_parseable(base).alias("ok"),
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href``; ``base`` comes from ``base_parts``.

    Null if unusable. Schemes other than http, https and ftp pass unchanged.
    """

    def plain_or_any(raw: Column) -> Column:
        """Most links are paths or plain web addresses and need no taking apart."""
        no_dots = ~raw.contains("/.")
        rooted = raw.startswith("/") & ~raw.startswith("//") & no_dots & base["ok"]
        web = raw.rlike(_PLAIN) & no_dots
        return (
            F.when(rooted, F.concat(base["prefix"], raw))
            .when(web, raw)
            .otherwise(bind(relative_form(raw), absolute))
        )

    def relative_form(raw: Column) -> Column:
        """A link in the page's own scheme but without a host is a relative one."""
        odd = (scheme(raw) == base["scheme"]) & ~raw.rlike(_AFTER_SCHEME + "//")
        return F.when(odd, F.regexp_replace(raw, _AFTER_SCHEME, "")).otherwise(raw)

    def absolute(ref: Column) -> Column:
        is_abs = ref.rlike(_SCHEME)
        own_host = is_abs | ref.startswith("//")
        rel_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
        full = F.when(is_abs, ref).otherwise(F.concat(base["scheme"], F.lit(":"), ref))
        prefix = F.when(
            own_host, bind(full, lambda u: F.concat(scheme(u), F.lit("://"), authority(u)))
        ).otherwise(base["prefix"])
        found_path = (
            F.when(own_host, F.regexp_extract(full, _AFTER_SCHEME + r"//[^/?#]*([^?#]*)", 1))
            .when(rel_path.startswith("/"), rel_path)
            .when(rel_path == "", base["path"])
            .otherwise(F.concat(F.regexp_replace(base["path"], r"[^/]*$", ""), rel_path))
        )
        rooted = bind(
            found_path,
            lambda p: F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)),
        )
        own_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
        tail = (
            F.when(own_host | (rel_path != "") | own_tail.startswith("?"), own_tail)
            .when(own_tail == "", base["tail"])
            .otherwise(F.concat(base["query"], own_tail))
        )
        joined = F.concat(prefix, bind(rooted, lambda p: _clean(p, False)), tail)
        other = is_abs & ~scheme(ref).isin("http", "https", "ftp")
        return F.when(other, ref).otherwise(bind(joined, lambda u: F.when(is_parseable(u), u)))

    return bind(trim_controls(href), plain_or_any)
