"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations.

Every item gives windows of consecutive words, the item itself when it is
shorter. A document contains a window only if it holds every word of it, so the
prefix that must be joined is one word: the rarest of the window, by counts over
all documents. Document words meet those prefix words; the place of the word in
its window bounds where the window can begin and how many words must follow
(length and position); what is left is compared word by word with the
item-sized slice of the document.

The window table is broadcast only when its measured size is under
``BROADCAST_BYTES``; a larger benchmark is joined as Spark sees fit.

Defined cases: null texts and texts without words have no words, no hits and no
windows; rows that agree in id and text are one document; items that share an
id are one item, and a null item id is shown as an empty string; windows that
several items share count for each of them; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.llm.rows import join_keyed, keyed, rows_back, with_rest
from crawlweave.workspace import Workspace

WINDOW = 13
BROADCAST_BYTES = 32 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """ASCII letters in lower case, digits and all that is not ASCII, run by run."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _GAP), "")


def _sized(df: DataFrame, n_bytes: Column) -> DataFrame:
    """Broadcast ``df``, a written table, if its rows are known to fit."""
    total = df.agg(F.sum(n_bytes + F.lit(64))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, win, n``: the windows of each item as words joined by spaces."""
    split = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        words(F.col(text_col)).alias("w"),
    ).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - n))
    return (
        split.withColumn("n", n)
        .withColumn("at", starts)
        .select("item", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("win"), "n")
        .distinct()
    )


def _doc_words(rows: DataFrame) -> DataFrame:
    split = rows.select("_id", "_key", words(F.col("_text")).alias("w"))
    return split.select("_id", "_key", "w", F.posexplode("w").alias("pos", "word"))


def _prefixes(windows: DataFrame, rows: DataFrame, ws: Workspace) -> DataFrame:
    """``word, win, n, shift``: the rarest word of each window and its place there."""
    places = windows.select("win", "n").distinct().select(
        "win", "n", F.posexplode(F.split("win", " ")).alias("shift", "word")
    )
    vocabulary = ws.save(places.select("word").distinct(), "vocabulary")
    seen = (
        _doc_words(rows)
        .select("word")
        .join(_sized(vocabulary, F.octet_length("word")), "word")
        .groupBy("word")
        .agg(F.count("*").alias("freq"))
    )
    counts = ws.save(seen, "word_counts")
    rarest = F.min(F.struct("freq", "word", "shift")).alias("m")
    # A word that no document holds drops its place here; a window that lacks
    # one of its words has none of its places counted in full and is left out.
    return (
        places.join(counts, "word")
        .groupBy("win", "n")
        .agg(rarest, F.count("*").alias("found"))
        .where(F.col("found") == F.col("n"))
        .select(F.col("m.word").alias("word"), "win", "n", F.col("m.shift").alias("shift"))
    )


def window_hits(
    docs: DataFrame,
    items: DataFrame,
    ws: Workspace,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``_id, _key, win, start, n`` per occurrence, and ``item, win, n``."""
    rows = keyed(docs, id_col, text_col)
    windows = ws.save(item_windows(items, item_id_col, item_text_col, window), "windows")
    prefixes = ws.save(_prefixes(windows, rows, ws), "prefixes")
    start = F.col("pos") - F.col("shift")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    same = F.array_join(F.slice("w", start + 1, F.col("n")), " ") == F.col("win")
    found = (
        _doc_words(rows)
        .join(_sized(prefixes, F.octet_length("win") + F.octet_length("word")), "word")
        .where(fits)
        .where(same)
        .select("_id", "_key", "win", start.alias("start"), "n")
    )
    return ws.save(found, "hits"), windows


def contamination(
    docs: DataFrame,
    items: DataFrame,
    ws: Workspace,
    window: int = WINDOW,
    share: int = 20,
    **columns: str,
) -> DataFrame:
    """``_id, _key, n_words, n_hit, item_ids, contaminated`` per row of ``docs``.

    Contaminated: at least one in ``share`` words lies in an occurrence of a window.
    """
    hits, windows = window_hits(docs, items, ws, window, **columns)
    spans = F.transform(
        F.collect_set(F.struct("start", "n")),
        lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1),
    )
    per_doc = hits.groupBy("_id", "_key").agg(
        F.size(F.array_distinct(F.flatten(spans))).cast("bigint").alias("n_hit")
    )
    per_item = (
        hits.select("_id", "_key", "win").distinct()
        .join(windows.select("win", "item"), "win")
        .groupBy("_id", "_key")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    known = {k: v for k, v in columns.items() if k in ("id_col", "text_col")}
    sizes = keyed(docs, **known).select(
        "_id",
        "_key",
        F.size(words(F.col("_text"))).cast("bigint").alias("n_words"),
    )
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return join_keyed(sizes, join_keyed(per_doc, per_item)).select(
        "_id",
        "_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, ws: Workspace, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    gone = contamination(docs, items, ws, **options).where("contaminated")
    rows = join_keyed(with_rest(docs), gone.select("_id", "_key").distinct(), "left_anti")
    return rows_back(rows, docs)
