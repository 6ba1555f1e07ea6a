"""Scoring, top-k and re-ranking of search hits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.functions import text, urls

# Scoring constants, field boosts, hits taken, and the result cap.
K1 = 1.2
B = 0.75
BOOSTS = {"title": 3.0, "content": 1.0}
HITS = 80
CAP = 50
SCORE_PLACES = 6

#: Documents of a block of the index, as a power of two.
BLOCK_BITS = 5

#: Postings of a query's rarest words that give the floor, as a multiple of the hits.
RARE = 16

#: More than rounding can add to a score.
_SLACK = 10.0**-SCORE_PLACES


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``; a repeated word counts as often as it occurs."""
    return (
        queries.select("query_id", F.explode(text.tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def term_weights(
    terms: DataFrame, stats: DataFrame, corpus: DataFrame, boosts: Mapping[str, float] = BOOSTS
) -> DataFrame:
    """Query terms with their weight per field and the field's mean length.

    ``stats`` may have a ``peak``, the most a term weighs in any document; ``bound``
    is what a term can add to a score then.
    """
    n, df = F.col("n_docs"), F.col("df")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    boost = F.element_at(F.create_map(*[F.lit(x) for f, b in boosts.items() for x in (f, float(b))]), F.col("field"))
    peak = F.col("peak") if "peak" in stats.columns else F.lit(1.0)
    return (
        terms.join(stats.where(F.col("field").isin(*boosts)), "term")
        .join(corpus.select("field", "n_docs", "avgdl"), "field")
        .withColumn("weight", F.col("qtf") * idf)
        .select("query_id", "field", "term", "weight", "avgdl", "df", (boost * F.col("weight") * peak).alias("bound"))
    )


def _saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def _best_field(sums: Sequence[str], boosts: Mapping[str, float]) -> Column:
    best = [F.col(c) * F.lit(float(b)) for c, b in zip(sums, boosts.values(), strict=True)]
    return F.greatest(*best) if len(best) > 1 else best[0]


def score(
    postings: DataFrame, weights: DataFrame, boosts: Mapping[str, float] = BOOSTS
) -> DataFrame:
    """``(query_id, doc_id, score)``: best field's boosted BM25 sum per document.

    On postings bucketed by ``doc_id`` and weights small enough to broadcast,
    join and aggregate both run where the postings lie.
    """
    return score_pairs(postings.join(weights, ["field", "term"]), boosts)


def score_pairs(pairs: DataFrame, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """``score`` of postings that stand beside their query words' weights already."""
    part = F.col("weight") * _saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    names = [f"_s{i}" for i in range(len(boosts))]
    sums = [
        F.sum(F.when(F.col("field") == field, part)).alias(name)
        for name, field in zip(names, boosts, strict=True)
    ]
    return (
        pairs.groupBy("query_id", "doc_id")
        .agg(*sums)
        .select("query_id", "doc_id", F.round(_best_field(names, boosts), SCORE_PLACES).alias("score"))
        .where(F.col("score").isNotNull())
    )


def peaks(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(field, term, block, peak, docs)``: a word's greatest saturation in each block.

    ``corpus`` has the mean lengths that it is measured with.
    """
    means = corpus.select("field", F.col("avgdl").alias("_mean"))
    peak = F.max(_saturation(F.col("tf"), F.col("dl"), F.col("_mean")))
    return (
        postings.join(means, "field")
        .groupBy("field", "term", "block")
        .agg(peak.alias("peak"), F.count("*").alias("docs"))
    )


def rare_terms(weights: DataFrame, hits: int = HITS) -> DataFrame:
    """A query's rarest words, as many as have ``RARE`` times ``hits`` postings together."""
    order = W.partitionBy("query_id").orderBy("df", "field", "term")
    before = F.coalesce(F.sum("df").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return weights.withColumn("_before", before).where(F.col("_before") < RARE * hits).drop("_before")


def floors(scored: DataFrame, hits: int = HITS) -> DataFrame:
    """``(query_id, floor)``: ``hits`` documents score this or more; none if there are fewer.

    ``scored`` has what a part of the words gives, rounded.
    """
    last = top_hits(scored, hits).where(F.col("hit") == hits)
    return last.select("query_id", (F.col("score") - _SLACK).alias("floor"))


def needed_terms(weights: DataFrame, floors: DataFrame) -> DataFrame:
    """Add ``needed`` and ``others``, the most that words not needed give a document together.

    Words of least bound are not needed as long as all of them together stay below
    the floor: a document that holds no other word of the query is no hit.
    """
    word = W.partitionBy("query_id", "term")
    order = W.partitionBy("query_id").orderBy("_most", "term", "field")
    # A word counts once, with the field where it weighs most.
    first = F.row_number().over(word.orderBy(F.desc("bound"), "field")) == 1
    total = F.sum(F.when(F.col("_first"), F.col("_most")).otherwise(0.0)).over(order)
    return (
        weights.join(floors, "query_id", "left")
        .withColumn("_most", F.max("bound").over(word))
        .withColumn("_first", first)
        .withColumn("_total", total)
        .withColumn("_over", F.max("_total").over(word))
        .withColumn("needed", F.col("floor").isNull() | (F.col("_over") >= F.col("floor")))
        .withColumn(
            "others",
            F.coalesce(F.max(F.when(~F.col("needed"), F.col("_over"))).over(W.partitionBy("query_id")), F.lit(0.0)),
        )
        .drop("_most", "_first", "_total", "_over")
    )


def blocks_above(
    peaks: DataFrame, needed: DataFrame, corpus: DataFrame, boosts: Mapping[str, float] = BOOSTS
) -> DataFrame:
    """``(query_id, block)`` where the needed words may lead a document to the floor."""
    names = [f"_b{i}" for i in range(len(boosts))]
    part = F.col("weight") * F.col("peak") * F.col("_grown")
    sums = [
        F.sum(F.when(F.col("field") == field, part)).alias(name)
        for name, field in zip(names, boosts, strict=True)
    ]
    # Lengths are per field, so they join to the few weights, not to the peaks.
    scaled = needed.join(corpus.select("field", "built_avgdl"), "field").withColumn("_grown", grown())
    bound = _best_field(names, boosts) + F.col("others")
    return (
        peaks.join(scaled, ["field", "term"])
        .groupBy("query_id", "block", "floor", "others")
        .agg(*sums)
        .where(F.col("floor").isNull() | (bound >= F.col("floor")))
        .select("query_id", "block")
    )


def grown() -> Column:
    """How much more a word may weigh now than when the peaks were measured.

    Where documents are longer on average than then, no more than the ratio of the means.
    """
    return F.greatest(F.lit(1.0), F.col("avgdl") / F.col("built_avgdl"))


def top_hits(scored: DataFrame, hits: int = HITS) -> DataFrame:
    """Best ``hits`` per query; equal scores go by document id.

    The rank filter is applied per task before the shuffle, so no query sends
    more than ``hits`` rows per task.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (
        scored.withColumn("hit", F.row_number().over(order))
        .where(F.col("hit") <= hits)
        .withColumn("hit", F.col("hit").cast("bigint"))
    )


def with_url_flags(docs: DataFrame) -> DataFrame:
    """Add ``homepage`` and ``article``, so that a search need not look at URLs."""
    url = F.col("url")
    return docs.withColumns({"homepage": urls.is_homepage(url), "article": urls.is_article(url)})


def rerank(hits: DataFrame, cap: int = CAP) -> DataFrame:
    """Drop homepages and repeated URLs, articles first, fill up to ``cap``.

    ``hits`` has ``query_id, hit, url`` and the flags of ``with_url_flags``.
    Articles are never cut; other pages follow only while the total is below
    ``cap``. Every window here is over one query's hits, which ``top_hits`` bounds.
    """
    first = W.partitionBy("query_id", "url").orderBy("hit")
    per_query = W.partitionBy("query_id")
    in_tier = W.partitionBy("query_id", "tier").orderBy("hit")
    return (
        hits.where(F.col("url").isNotNull() & ~F.col("homepage"))
        .withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") == 1)
        .withColumn("tier", F.when(F.col("article"), 1).otherwise(2))
        .withColumn("_articles", F.count(F.when(F.col("article"), 1)).over(per_query))
        .withColumn("_place", F.row_number().over(in_tier))
        .where(
            F.col("article")
            | (F.col("_place") <= F.greatest(F.lit(cap) - F.col("_articles"), F.lit(0)))
        )
        .withColumn(
            "rank",
            F.when(F.col("article"), F.col("_place"))
            .otherwise(F.col("_articles") + F.col("_place"))
            .cast("bigint"),
        )
        .drop("_nth", "_articles", "_place", "homepage", "article")
    )
