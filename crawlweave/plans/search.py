"""Index build and ranked search.

An index is a list of segments, each a set of tables. Documents and postings are
bucketed by document, so every task holds whole documents: scoring and the first cut
to the best hits happen there, and only those hits travel. Postings are sorted by term
inside a bucket, so a query's terms skip most of each file.

Documents that are added make a segment of their own; no earlier segment is written
again. A document that is replaced stays in its old segment, and a table of such
(document, segment) pairs takes it out of every read there. ``fold_index`` makes one
segment of all when there are many. What a segment adds to or takes from the term and
length counts lies in its own tables, and the counts are sums over segments.

A segment counts once the list of segments is written that names it, which is the
last thing that happens: an attempt that fails in between leaves an index as it was.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlweave.functions import html, text
from crawlweave.operators import index as idx
from crawlweave.operators import ranking
from crawlweave.workspace import Workspace

#: Share of the postings of all query words up to which pruning pays.
PRUNE_SHARE = 0.25

COLUMNS = ("doc_id", "url", "title", "content")


@dataclass
class Segment:
    number: int
    path: str  # where the tables lie
    buckets: int
    docs: DataFrame  # doc_id, url, title, content, homepage, article, digest, block
    postings: DataFrame  # doc_id, field, term, tf, dl, block
    peaks: DataFrame  # field, term, block, peak, docs
    terms: DataFrame  # field, term, df, peak: what the segment adds, less what it replaces
    corpus: DataFrame  # field, n_docs, sum_dl likewise, built_avgdl


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass
class SearchIndex:
    segments: list[Segment]
    gone: DataFrame | None  # doc_id, segment of documents replaced since
    home: Workspace
    version: int
    gone_path: str | None = None

    def live(self, rows: DataFrame, segment: Segment) -> DataFrame:
        """Rows of a segment's documents or postings that were not replaced."""
        if self.gone is None or segment.number == self.segments[-1].number:
            return rows
        dead = self.gone.where(F.col("segment") == segment.number).select("doc_id")
        return rows.join(dead, "doc_id", "left_anti")

    def _all(self, name: str) -> DataFrame:
        return _union([self.live(getattr(s, name), s) for s in self.segments]).drop("block", "digest")

    @property
    def docs(self) -> DataFrame:
        return self._all("docs")

    @property
    def postings(self) -> DataFrame:
        return self._all("postings")

    @property
    def terms(self) -> DataFrame:
        return self.terms_among(None).select("field", "term", "df")

    def terms_among(self, wanted: DataFrame | None) -> DataFrame:
        """``field, term, df, peak``, of the ``term`` rows wanted if any are given."""
        means = self.corpus.select("field", "avgdl")
        parts = []
        for s in self.segments:
            own = s.terms if wanted is None else s.terms.join(wanted, "term", "left_semi")
            if len(self.segments) > 1:
                grown = means.join(s.corpus.select("field", "built_avgdl"), "field").select(
                    "field", ranking.grown().alias("_grown")
                )
                own = own.join(grown, "field", "left").withColumn("peak", F.col("peak") * F.col("_grown")).drop("_grown")
            parts.append(own)
        if len(parts) == 1:
            return parts[0]
        sums = _union(parts).groupBy("field", "term")
        return sums.agg(F.sum("df").alias("df"), F.max("peak").alias("peak")).where("df > 0")

    @property
    def corpus(self) -> DataFrame:
        return (
            _union([s.corpus for s in self.segments])
            .groupBy("field")
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
            .where("n_docs > 0")
            .withColumn("avgdl", F.col("sum_dl") / F.col("n_docs"))
        )


def page_docs(pages: DataFrame) -> DataFrame:
    """Documents of a page table."""
    return pages.select(
        F.col("page_id").alias("doc_id"),
        "url",
        html.title(F.col("html")).alias("title"),
        html.body_text(F.col("html")).alias("content"),
    )


def _digest() -> Column:
    return F.md5(F.to_json(F.struct("url", "title", "content")))


def _write_segment(
    number: int, docs: DataFrame, home: Workspace, earlier: SearchIndex | None = None, dead: DataFrame | None = None
) -> Segment:
    """The tables of ``docs``; counts less those of the ``dead(doc_id, segment)`` of ``earlier``.

    One shuffle moves the documents to their buckets; counting terms then needs none.
    There they are sorted by length and numbered, so that a block's documents are
    alike in the weight a word can have. The number is fixed by the write.
    """
    ws = home.child("segment")
    buckets = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        ranking.with_url_flags(docs.select(*COLUMNS))
        .withColumn("digest", _digest())
        .repartition(buckets, "doc_id")
        .sortWithinPartitions(F.length("content"))
        .withColumn("block", F.shiftright(F.monotonically_increasing_id(), ranking.BLOCK_BITS))
    )
    stored = ws.save_bucketed(placed, "docs", ["doc_id"], sort=["doc_id"], buckets=buckets, placed=True)
    counted = idx.postings(stored, keep=("block",))
    postings = ws.save_bucketed(
        counted, "postings", ["doc_id"], sort=["field", "term"], buckets=buckets, placed=True
    )
    corpus = ws.save(idx.corpus_stats(postings).coalesce(1), "lengths")
    # Joins read them whole, so they stay where they are counted.
    peaks = ws.save(ranking.peaks(postings, corpus).sortWithinPartitions("field", "term"), "peaks")
    terms = peaks.groupBy("field", "term").agg(F.sum("docs").alias("df"), F.max("peak").alias("peak"))
    sums = corpus.select("field", "n_docs", "sum_dl", F.col("avgdl").alias("built_avgdl"))
    if earlier is not None and dead is not None:
        lost = _union(
            [
                s.postings.join(dead.where(F.col("segment") == s.number).select("doc_id"), "doc_id", "left_semi")
                for s in earlier.segments
            ]
        )
        lost = ws.save(lost.select("doc_id", "field", "term", "dl"), "replaced")
        minus = idx.term_stats(lost).withColumn("df", -F.col("df"))
        terms = terms.unionByName(minus, allowMissingColumns=True).groupBy("field", "term")
        terms = terms.agg(F.sum("df").alias("df"), F.max("peak").alias("peak"))
        minus = idx.corpus_stats(lost).select("field", (-F.col("n_docs")).alias("n_docs"), (-F.col("sum_dl")).alias("sum_dl"))
        sums = sums.unionByName(minus, allowMissingColumns=True)
        sums = sums.groupBy("field").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"), F.max("built_avgdl").alias("built_avgdl")
        )
    return Segment(
        number,
        ws.root,
        buckets,
        stored,
        postings,
        peaks,
        ws.save(terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "terms"),
        ws.save(sums.coalesce(1), "corpus"),
    )


def _publish(index: SearchIndex) -> SearchIndex:
    """Write the list of segments; from then on a reader finds them."""
    rows = [
        (s.number, s.path, s.buckets, s.docs.schema.json(), s.postings.schema.json(), index.gone_path)
        for s in index.segments
    ]
    listed = index.home.spark.createDataFrame(
        rows, "number bigint, path string, buckets int, docs string, postings string, gone string"
    )
    listed.coalesce(1).write.mode("errorifexists").parquet(index.home.path(f"version-{index.version}"))
    return index


def build_index(docs: DataFrame, ws: Workspace, home: Workspace | None = None) -> SearchIndex:
    """Write the index of ``docs(doc_id, url, title, content)``; ``doc_id`` is unique."""
    home = home or ws.child("index")
    return _publish(SearchIndex([_write_segment(0, docs, home)], None, home, 0))


def open_index(home: Workspace) -> SearchIndex | None:
    """The index as it was last published in ``home``, none if there is none."""
    version = home.newest("version")
    if version is None:
        return None
    listed = home.load(f"version-{version}").orderBy("number").collect()  # a row per segment
    segments = []
    for row in listed:
        ws = Workspace(home.spark, home.root)
        ws.root = row.path
        docs, postings = (StructType.fromJson(json.loads(x)) for x in (row.docs, row.postings))
        segments.append(
            Segment(
                row.number,
                row.path,
                row.buckets,
                ws.attach_bucketed("docs", docs, ["doc_id"], ["doc_id"], row.buckets),
                ws.attach_bucketed("postings", postings, ["doc_id"], ["field", "term"], row.buckets),
                *(ws.load(name) for name in ("peaks", "terms", "corpus")),
            )
        )
        home.adopt(ws)
    gone = home.spark.read.parquet(listed[0].gone) if listed[0].gone else None
    return SearchIndex(segments, gone, home, version, listed[0].gone)


def _newest_rows(docs: DataFrame, newest: str | None) -> DataFrame:
    rank = [F.col(newest).alias("_newest")] if newest else []
    return (
        docs.groupBy("doc_id")
        .agg(F.max(F.struct(*rank, "url", "title", "content")).alias("_row"))
        .select("doc_id", "_row.url", "_row.title", "_row.content")
    )


def add_to(home: Workspace, docs: DataFrame, newest: str | None = None) -> SearchIndex:
    """``add_documents`` to the index in ``home``, or its first documents."""
    index = open_index(home)
    if index is None:
        return build_index(_newest_rows(docs, newest), home, home)
    return add_documents(index, docs, newest)


def add_documents(index: SearchIndex, docs: DataFrame, newest: str | None = None) -> SearchIndex:
    """The index with ``docs`` added; a document it has already is replaced.

    Of rows that share a ``doc_id`` the one with the greatest ``newest`` column
    counts, or else the one whose columns are greatest. Rows that the index holds
    alike are left out, which their digests tell. The others become a segment, and
    only they are written: what a replaced document counted is subtracted in the new
    segment's counts, and its id is noted beside its old segment.
    """
    home = index.home
    ws = home.child("added")
    given = _newest_rows(docs, newest).withColumn("digest", _digest())
    held = _union(
        [
            index.live(s.docs, s).select("doc_id", F.col("digest").alias("_held"), F.lit(s.number).cast("bigint").alias("segment"))
            for s in index.segments
        ]
    )
    fresh = ws.save(
        given.join(held, "doc_id", "left").where(F.col("_held").isNull() | (F.col("_held") != F.col("digest"))), "fresh"
    )
    if fresh.isEmpty():
        return index
    dead = fresh.where(F.col("_held").isNotNull()).select("doc_id", "segment")
    segment = _write_segment(index.segments[-1].number + 1, fresh, home, index, dead)
    gone = dead if index.gone is None else index.gone.unionByName(dead)
    ws.save(gone, "gone")
    return _publish(
        SearchIndex([*index.segments, segment], ws.load("gone", gone.schema), home, index.version + 1, ws.path("gone"))
    )


def fold_index(index: SearchIndex) -> SearchIndex:
    """All live documents as one segment; the old segments are read, not changed."""
    segment = _write_segment(index.segments[-1].number + 1, index.docs, index.home)
    return _publish(SearchIndex([segment], None, index.home, index.version + 1))


def search(
    index: SearchIndex,
    queries: DataFrame,
    ws: Workspace,
    boosts: Mapping[str, float] = ranking.BOOSTS,
    hits: int = ranking.HITS,
    cap: int = ranking.CAP,
    best_passage: bool = False,
) -> DataFrame:
    """Results ``(query_id, rank, tier, url, snippet)`` for ``queries(query_id, text)``.

    Ranking works on addresses and flags; texts are read for the results only.
    Snippets are the first passage with a word of the query, or with
    ``best_passage`` the one with most of them.
    """
    ws = ws.child("search")
    best = ws.save(top_scored(index, queries, ws, boosts, hits), "hits")
    return _present(index, best, queries, ws, cap, best_passage)


def _present(
    index: SearchIndex,
    best: DataFrame,
    queries: DataFrame,
    ws: Workspace,
    cap: int,
    best_passage: bool = False,
) -> DataFrame:
    narrow = index.docs.select("doc_id", "url", "homepage", "article")
    ranked = ws.save(
        ranking.rerank(best.join(narrow, "doc_id"), cap).select(
            "query_id", "doc_id", "rank", "tier", "url"
        ),
        "ranked",
    )
    words = queries.select(
        "query_id", F.array_distinct(text.tokens(F.col("text"))).alias("terms")
    )
    texts = index.docs.select("doc_id", "title", "content")
    return ranked.join(texts, "doc_id").join(words, "query_id").select(
        "query_id",
        "rank",
        "tier",
        "url",
        text.snippet(F.col("title"), F.col("content"), F.col("terms"), best_passage).alias("snippet"),
    )


def _weights(index: SearchIndex, queries: DataFrame, ws: Workspace, boosts: Mapping[str, float]) -> DataFrame:
    """Written first: the true size then decides whether weights are broadcast to the
    postings or both sides are shuffled by term."""
    asked = ranking.query_terms(queries)
    stats = index.terms_among(asked.select("term").distinct() if len(index.segments) > 1 else None)
    return ws.save(ranking.term_weights(asked, stats, index.corpus, boosts), "weights")


def top_scored(
    index: SearchIndex,
    queries: DataFrame,
    ws: Workspace,
    boosts: Mapping[str, float] = ranking.BOOSTS,
    hits: int = ranking.HITS,
    prune_share: float = PRUNE_SHARE,
) -> DataFrame:
    """Best documents per query: ``(query_id, doc_id, score, hit)``.

    The postings of a query's rarest words come first; the score that ``hits``
    documents reach by these alone is a floor. Words that together stay below it need
    not be looked up to find documents. Of the others, only postings in blocks whose
    bound reaches the floor are joined, and of the documents found, only those are
    scored in full that could still be among the best.

    Where the words needed have more than ``PRUNE_SHARE`` of the postings of all, looking
    twice costs more than it saves, and all postings are scored at once: the result is
    the same. The counts that tell are exact and known before postings are read.
    """
    ws = ws.child("scores")
    weights = _weights(index, queries, ws, boosts)
    rare = ranking.rare_terms(weights, hits)
    early = [ranking.score(index.live(s.postings, s), rare, boosts) for s in index.segments]
    judged = ws.save(ranking.needed_terms(weights, ranking.floors(_union(early), hits)), "judged")
    needed = judged.where("needed")
    share = judged.agg(F.sum(F.when(F.col("needed"), F.col("df")).otherwise(0)), F.sum("df")).first()
    if share[1] and share[0] > prune_share * share[1]:
        return ranking.top_hits(_union([ranking.score(index.live(s.postings, s), weights, boosts) for s in index.segments]), hits)
    # Written with their weights: their true size decides how they meet the postings.
    asked = [
        ranking.blocks_above(s.peaks, needed, s.corpus, boosts)
        .join(needed, "query_id")
        .withColumn("segment", F.lit(s.number).cast("bigint"))
        for s in index.segments
    ]
    blocks = ws.save(_union(asked), "blocks")
    found = [ranking.score_pairs(_among_blocks(index, s, blocks), boosts) for s in index.segments]
    partial = ws.save(_union(found), "partial")
    better = ranking.floors(partial, hits)
    others = judged.select("query_id", "others").distinct()
    reaches = F.col("score") + F.col("others") + 10.0**-ranking.SCORE_PLACES >= F.col("floor")
    hopeful = (
        partial.join(better, "query_id", "left")
        .join(others, "query_id")
        .where(F.col("floor").isNull() | reaches)
        .select("query_id", "doc_id")
    )
    candidates = ws.save(hopeful, "candidates")
    full = [ranking.score_pairs(_of_documents(index, s, candidates, weights), boosts) for s in index.segments]
    return ranking.top_hits(_union(full), hits)


def scored_documents(
    index: SearchIndex, queries: DataFrame, ws: Workspace, hits: int = ranking.HITS
) -> tuple[int, int]:
    """Pairs of query and document scored in full with pruning, and pairs that share a word."""
    inner = ws.child("pairs")
    top_scored(index, queries, inner, hits=hits, prune_share=1.0)
    done = inner._children[-1]
    whole = index.postings.join(done.load("weights"), ["field", "term"]).select("query_id", "doc_id").distinct()
    return done.load("candidates").count(), whole.count()


def _among_blocks(index: SearchIndex, segment: Segment, blocks: DataFrame) -> DataFrame:
    """Postings of a segment beside the weights of the queries that ask for their block."""
    wanted = blocks.where(F.col("segment") == segment.number).drop("segment", "df")
    return index.live(segment.postings.join(wanted, ["block", "field", "term"]), segment)


def _of_documents(index: SearchIndex, segment: Segment, candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings of candidates' documents beside the weights of the queries they are candidates of."""
    within = segment.postings.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    beside = within.join(weights, ["field", "term"])
    return index.live(beside.join(candidates, ["query_id", "doc_id"], "left_semi"), segment)


def all_scored(
    index: SearchIndex,
    queries: DataFrame,
    ws: Workspace,
    boosts: Mapping[str, float] = ranking.BOOSTS,
    hits: int = ranking.HITS,
) -> DataFrame:
    """As ``top_scored``, scoring every posting of every word of the queries."""
    weights = _weights(index, queries, ws.child("scores"), boosts)
    found = [ranking.score(index.live(s.postings, s), weights, boosts) for s in index.segments]
    return ranking.top_hits(_union(found), hits)


def one_query(spark: SparkSession, words: str) -> DataFrame:
    return spark.range(1, numPartitions=1).select(
        F.lit(0).cast("bigint").alias("query_id"), F.lit(words).alias("text")
    )


def search_one(
    index: SearchIndex,
    words: str,
    ws: Workspace,
    boosts: Mapping[str, float] = ranking.BOOSTS,
    hits: int = ranking.HITS,
    cap: int = ranking.CAP,
) -> DataFrame:
    """``search`` for one query string, reading only what it needs.

    The query's own words become literals, so scans of terms and postings skip
    row groups; the hits are a written table, whose size Spark knows when it
    joins them to the documents.
    """
    ws = ws.child("search")
    queries = one_query(ws.spark, words)
    terms = queries.select(F.array_distinct(text.tokens(F.col("text")))).first()[0]
    among = F.col("term").isin(terms)
    narrowed = replace(
        index,
        segments=[replace(s, postings=s.postings.where(among), terms=s.terms.where(among)) for s in index.segments],
    )
    best = ws.save(all_scored(narrowed, queries, ws, boosts, hits), "hits")
    return _present(index, best, queries, ws, cap)
