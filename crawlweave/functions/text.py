"""Tokens, passages and highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is, and the cut of a text into passages.
# A word keeps its combining marks; ideographs and hiragana are words one by one,
# katakana by the run, as scripts without spaces have no other words to find.
_ALONE = r"\p{IsHan}\p{IsHiragana}"
_SPACELESS = _ALONE + r"\p{IsKatakana}\u30FC"
# Latin and Cyrillic letters and digits, all of them in the classes they stand beside:
# named first, they need no look at a character's script, which is slow.
_COMMON = r"a-zA-Z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF\u0400-\u0481"
TOKEN = (
    rf"[{_COMMON}[\p{{L}}\p{{N}}&&[^{_SPACELESS}]]][{_COMMON}[\p{{L}}\p{{N}}\p{{M}}&&[^{_SPACELESS}]]]*+"
    rf"|(?![\x00-\x7F])(?:[{_ALONE}]\p{{M}}*|[\p{{IsKatakana}}\u30FC][\p{{IsKatakana}}\u30FC\p{{M}}]*)"
)
PIECE = TOKEN + r"|[^\p{L}\p{N}]+"
PASSAGE = r"(?s)[^.!?]{1,100}[.!?]+(?:\s+|$)|.{1,100}(?:\s+|$)|.{1,100}"
PRE_TAG = "<em>"
POST_TAG = "</em>"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def passages(text: Column) -> Column:
    """Sentences, or pieces of at most 100 characters where they run longer."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PASSAGE), 0), lambda p: F.trim(p)
    )


def mark(text: Column, terms: Column) -> Column:
    """``text`` with every token found in ``terms`` wrapped in the tags."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(PIECE), 0),
            lambda piece: F.when(
                F.array_contains(terms, F.lower(piece)),
                F.concat(F.lit(PRE_TAG), piece, F.lit(POST_TAG)),
            ).otherwise(piece),
        ),
        "",
    )


def highlights(text: Column, terms: Column) -> Column:
    """Marked passages of ``text`` that hold a term, in order."""
    hits = F.filter(passages(text), lambda p: F.arrays_overlap(tokens(p), terms))
    return F.transform(hits, lambda p: mark(p, terms))


def first_highlight(text: Column, terms: Column) -> Column:
    """The first marked passage, null when no passage holds a term."""
    hits = F.filter(passages(text), lambda p: F.arrays_overlap(tokens(p), terms))
    return mark(F.get(hits, F.lit(0)), terms)


def best_highlight(text: Column, terms: Column) -> Column:
    """The marked passage that holds most of the different ``terms``, the first of several.

    Null when no passage holds a term.
    """
    rated = F.transform(
        passages(text),
        lambda p, i: F.struct(
            F.size(F.array_intersect(tokens(p), terms)).alias("cover"), (-i).alias("place"), p.alias("p")
        ),
    )
    best = F.array_max(F.filter(rated, lambda r: r["cover"] > 0))
    return mark(best["p"], terms)


def snippet(title: Column, content: Column, terms: Column, best: bool = False) -> Column:
    """First title highlight, else first content highlight, else empty.

    With ``best``, in each field the passage with most terms instead of the first.
    """
    pick = best_highlight if best else first_highlight
    return F.coalesce(pick(title, terms), pick(content, terms), F.lit(""))
