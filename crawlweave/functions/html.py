"""Text, title and anchors of an HTML page, as regular-expression chains.

Everything runs inside the scan stage; no page leaves the JVM.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.functions.binding import bind

# Elements that do not break a line of text.
INLINE_TAGS = "a|b|i|em|strong|span|u|small|sub|sup|code"

# One pass, so that whichever of these starts first hides the others inside it.
# One that is never closed runs to the end, so a page is read once however many
# openers it has. Of the head only the title is text.
_UNSEEN = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)"
_UNSEEN_OR_TITLE = r"(?is)<(title|script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)"
# A tag up to its end: a quoted value is taken whole, whatever it holds, and a quote
# that is never closed is a character like any other. Possessive throughout, and a
# tag that is never closed runs to the end, so a page is read once.
_VALUE = r"""=\s*+(?:"[^"]*"|'[^']*')?+"""
_ATTRIBUTES = rf"[^>=]*+(?:{_VALUE}[^>=]*+)*+"
_TAG = rf"<(?=[A-Za-z/!?]){_ATTRIBUTES}(?:>|\z)|<(?![A-Za-z/!?])[^<>]*+>"
_INLINE_TAG = rf"(?i)</?(?:{INLINE_TAGS})(?:\s{_ATTRIBUTES})?(?:>|\z)"


def _with_href(tag: str) -> str:
    """An opening tag up to its first ``href``, whose value is the only group."""
    before = r"""(?:[^>=\s<]|\s(?!href\s*=)|=\s*+(?:"[^"]*"|'[^']*'|[^\s><]*+))*+"""
    return rf"""(?is)<{tag}(?=[\s/]){before}\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


_SPACE = "[ \t\r\n\f\u00a0]+"
_ZERO_WIDTH = "\u200b\u00ad"
_OTHER_ENTITY = (
    r"&(?!(?:amp|copy|middot|quot|lt|gt|nbsp);)(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z][A-Za-z0-9]*;)"
)

# The entities nearly every page uses.
_COMMON = {
    "&copy;": "©",
    "&middot;": "·",
    "&quot;": '"',
    "&lt;": "<",
    "&gt;": ">",
    "&nbsp;": " ",
}


def _code_point(number: Column) -> Column:
    """Character for a code point; U+FFFD when there is none."""
    known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(
        known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    ).otherwise("\ufffd")


def _decode_each(text: Column, bare_amp: str) -> Column:
    """Every reference once, left to right, piece by piece after each ``&``."""
    pairs = "\n".join(f"{n}\t{chr(cp)}" for n, cp in name2codepoint.items())
    names = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^#([0-9]{1,9})", 1)
        hexed = F.regexp_extract(piece, r"^#[xX]([0-9A-Fa-f]{1,7})", 1)
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        named = F.try_element_at(names, name)
        return (
            F.when(
                digits != "",
                F.concat(
                    _code_point(digits.try_cast("bigint")),
                    F.regexp_replace(piece, r"^#[0-9]{1,9};?", ""),
                ),
            )
            .when(
                hexed != "",
                F.concat(
                    _code_point(F.conv(hexed, 16, 10).try_cast("bigint")),
                    F.regexp_replace(piece, r"^#[xX][0-9A-Fa-f]{1,7};?", ""),
                ),
            )
            .when(
                named.isNotNull(),
                F.concat(named, F.regexp_replace(piece, r"^[A-Za-z][A-Za-z0-9]*;", "")),
            )
            .otherwise(F.concat(F.lit("&"), F.regexp_replace(piece, bare_amp, "")))
        )

    def join(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return bind(F.split(text, "&"), join)


def decode_entities(
    text: Column, origin: Column | None = None, attribute: bool = False
) -> Column:
    """Replace each character reference once.

    Inside an ``attribute``, ``amp`` without a semicolon is a reference only
    when no letter, digit or ``=`` follows, so that addresses stay whole.
    ``origin`` is the raw column ``text`` was cut from. Looking there whether
    the slow way is needed saves working out ``text`` twice.
    """
    bare = r"^amp(?![;A-Za-z0-9=])" if attribute else r"^amp(?!;)"
    # No name in the short list can arise from another one's character, as long
    # as the ampersand comes last.
    short = text
    for entity, char in _COMMON.items():
        short = F.replace(short, F.lit(entity), F.lit(char))
    short = F.regexp_replace(short, f"&amp;|&{bare[1:]}", "&")
    rare = (text if origin is None else origin).rlike(_OTHER_ENTITY)
    return F.when(rare, _decode_each(text, bare)).otherwise(short)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _ZERO_WIDTH, ""), _SPACE, " "))


def without_unseen(html: Column) -> Column:
    """Page without scripts, styles and comments."""
    return F.regexp_replace(html, _UNSEEN, "")


def body_text(html: Column) -> Column:
    """Visible body text with single spaces; empty for a null page."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN_OR_TITLE, "")
    text = F.regexp_replace(text, _INLINE_TAG, "")
    text = F.regexp_replace(text, _TAG, " ")
    return _squeeze(decode_entities(text, F.coalesce(html, F.lit(""))))


def title(html: Column) -> Column:
    """Text of the title element, empty when there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _squeeze(decode_entities(found, F.coalesce(html, F.lit(""))))


def hrefs(html: Column) -> Column:
    """``href`` of every anchor in document order, entities decoded."""
    seen = without_unseen(F.coalesce(html, F.lit("")))
    found = F.regexp_extract_all(seen, F.lit(_with_href("a")), 1)
    bare = F.transform(found, lambda h: F.regexp_replace(h, r"""^["']|["']$""", ""))
    return F.transform(
        bare, lambda h: F.when(h.contains("&"), decode_entities(h, attribute=True)).otherwise(h)
    )


def base_href(html: Column) -> Column:
    """Value of the first ``base`` element, empty when there is none."""
    return F.regexp_replace(
        F.regexp_extract(F.coalesce(html, F.lit("")), _with_href("base"), 1),
        r"""^["']|["']$""",
        "",
    )
