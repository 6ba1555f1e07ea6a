"""Index and search queries over pages and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.catalog.crawling import OPEN_SQL, open_crawl
from crawlweave.catalog.registry import query, table
from crawlweave.catalog.shapes import body_sql, title_sql
from crawlweave.functions import text
from crawlweave.operators import index as idx
from crawlweave.operators import ranking
from crawlweave.plans import search as plan
from crawlweave.workspace import Workspace

QUERY_TEXTS = ("edtion nicht", "thanedble", "eauaux thedble")

# --- SQL shared by the checks -------------------------------------------------------

_PAGE_DOCS_SQL = f"""
docs AS (SELECT page_id AS doc_id, url, {title_sql()} AS title, {body_sql()} AS content
         FROM pages)"""

_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"

POSTINGS_SQL = f"""
toks AS (SELECT doc_id, 'title' AS field, {_TOKENS.format('title')} AS l FROM docs
         UNION ALL SELECT doc_id, 'content', {_TOKENS.format('content')} FROM docs),
words AS (SELECT doc_id, field, len(l) AS dl, unnest(l) AS term FROM toks),
postings AS (SELECT doc_id, field, dl, term, count(*) AS tf FROM words GROUP BY ALL),
terms AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
per_doc AS (SELECT DISTINCT doc_id, field, dl FROM postings),
corpus AS (SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS sum_dl, avg(dl) AS avgdl
           FROM per_doc GROUP BY 1)"""

SCORES_SQL = f"""
qwords AS (SELECT query_id, unnest({_TOKENS.format('text')}) AS term FROM queries),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM qwords GROUP BY ALL),
parts AS (SELECT q.query_id, p.doc_id, p.field,
            q.qtf * ln(1 + (c.n_docs - t.df + 0.5) / (t.df + 0.5)) * p.tf
              / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / c.avgdl))
              * CASE p.field WHEN 'title' THEN 3.0 ELSE 1.0 END AS w
          FROM qterms q JOIN postings p ON q.term = p.term
          JOIN terms t ON t.term = p.term AND t.field = p.field
          JOIN corpus c ON c.field = p.field),
sums AS (SELECT query_id, doc_id, field, sum(w) AS s FROM parts GROUP BY ALL),
scores AS (SELECT query_id, doc_id, round(max(s), 6) AS score FROM sums GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER
             (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit FROM scores),
best AS (SELECT * FROM ranked WHERE hit <= 80)"""

_FLAGS_SQL = r"""
flagged AS (SELECT b.query_id, b.hit, b.doc_id, d.url, d.title, d.content,
              regexp_extract(d.url, '^https?://[^/?#]*([^?#]*)', 1) AS path, lower(d.url) AS low
            FROM best b JOIN docs d ON b.doc_id = d.doc_id),
tiered AS (SELECT *, CASE WHEN contains(low, '/article/') OR contains(low, '/news/')
                OR regexp_matches(low, '\b(docid|articleid|newsid|storyid|id)=[0-9]+')
                OR regexp_matches(low, '/[0-9]{4}/[0-9]{2}/[0-9]{2}/')
                OR regexp_matches(low, '/[0-9]{6,}')
                OR len(list_filter(string_split(path, '/'), lambda s: s <> '')) >= 3
                THEN CAST(1 AS BIGINT) ELSE 2 END AS tier,
             row_number() OVER (PARTITION BY query_id, url ORDER BY hit) AS nth
           FROM flagged WHERE path NOT IN ('', '/')),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY hit) AS place,
             count(*) FILTER (WHERE tier = 1) OVER (PARTITION BY query_id) AS articles
           FROM tiered WHERE nth = 1),
results AS (SELECT query_id, CASE tier WHEN 1 THEN place ELSE articles + place END AS rank,
              tier, url, title, content
            FROM placed WHERE tier = 1 OR place <= greatest(50 - articles, 0))"""

_PASSAGE = r"[^.!?]{1,100}[.!?]+(?:\s+|$)|.{1,100}(?:\s+|$)|.{1,100}"


def _highlights_sql(field: str, words: str) -> str:
    passages = f"list_transform(regexp_extract_all(coalesce({field}, ''), '(?s){_PASSAGE}'), lambda p: trim(p, ' '))"
    has_word = rf"list_has_any(regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+'), {words})"
    pieces = r"regexp_extract_all(p, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')"
    marked = (
        f"list_transform({pieces}, lambda x: CASE WHEN list_contains({words}, lower(x)) "
        "THEN '<em>' || x || '</em>' ELSE x END)"
    )
    return (
        f"list_transform(list_filter({passages}, lambda p: {has_word}), "
        f"lambda p: array_to_string({marked}, ''))"
    )


_SNIPPETS_SQL = f"""
qlist AS (SELECT query_id, list_distinct({_TOKENS.format('text')}) AS words FROM queries),
shown AS (SELECT r.query_id, r.rank, r.tier, r.url, coalesce(
            {_highlights_sql('title', 'q.words')}[1],
            {_highlights_sql('content', 'q.words')}[1], '') AS snippet
          FROM results r JOIN qlist q ON r.query_id = q.query_id)"""

FIXED_QUERIES_SQL = "queries AS (SELECT * FROM (VALUES {}) AS v(query_id, text))".format(
    ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, t in enumerate(QUERY_TEXTS))
)

# Documents have no address, so one is made up from source and number; every
# twelfth is a homepage and some share an address with their neighbour.
_TEXT_DOCS_SQL = """
docs AS (SELECT doc_id, NULL AS title, text AS content,
           'https://www.' || replace(lower(source), ' ', '-') || '.example.org' ||
           CASE doc_id % 12 WHEN 0 THEN '/' WHEN 1 THEN '/news/' || doc_id
             WHEN 2 THEN '/a/b?docid=' || doc_id WHEN 3 THEN '/2024/01/05/' || doc_id
             WHEN 4 THEN '/' || (1000000 + doc_id) WHEN 5 THEN '/a/b/' || doc_id
             WHEN 6 THEN '/a?pid=' || doc_id // 24 ELSE '/p/' || doc_id END AS url
         FROM documents)"""

_ITEM_QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


# --- inputs ----------------------------------------------------------------------------


def text_docs(documents: DataFrame) -> DataFrame:
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 12
    host = F.concat(
        F.lit("https://www."), F.replace(F.lower("source"), F.lit(" "), F.lit("-")),
        F.lit(".example.org"),
    )
    path = (
        F.when(k == 0, "/")
        .when(k == 1, F.concat(F.lit("/news/"), n))
        .when(k == 2, F.concat(F.lit("/a/b?docid="), n))
        .when(k == 3, F.concat(F.lit("/2024/01/05/"), n))
        .when(k == 4, F.concat(F.lit("/"), (F.col("doc_id") + 1000000).cast("string")))
        .when(k == 5, F.concat(F.lit("/a/b/"), n))
        .when(k == 6, F.concat(F.lit("/a?pid="), F.floor(F.col("doc_id") / 24).cast("string")))
        .otherwise(F.concat(F.lit("/p/"), n))
    )
    return documents.select(
        "doc_id",
        F.concat(host, path).alias("url"),
        F.lit(None).cast("string").alias("title"),
        F.col("text").alias("content"),
    )


def index_of(spark: SparkSession, folder: str, name: str) -> plan.SearchIndex:
    """The index of a table, built anew for each query."""
    source = table(spark, folder, name)
    docs = plan.page_docs(source) if name == "pages" else text_docs(source)
    return plan.build_index(docs, Workspace(spark))


Search = Callable[[SparkSession, str, plan.SearchIndex], DataFrame]

#: Searches by query name, with the table they search, for an index built before.
SEARCHES: dict[str, tuple[str, Search]] = {}


def searching(name: str, source: str, sql: str) -> Callable[[Search], Search]:
    """Register a search as a query that builds the index first."""

    def enter(f: Search) -> Search:
        SEARCHES[name] = (source, f)
        query(name, sql)(lambda spark, folder: f(spark, folder, index_of(spark, folder, source)))
        return f

    return enter


def fixed_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUERY_TEXTS)), "query_id bigint, text string")


def item_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- queries -----------------------------------------------------------------------------


@query(
    "term_freq",
    f"WITH {_PAGE_DOCS_SQL}, {POSTINGS_SQL} SELECT doc_id, field, term, tf, dl FROM postings",
)
def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    docs = plan.page_docs(table(spark, folder, "pages"))
    return idx.postings(docs).select("doc_id", "field", "term", "tf", "dl")


@query(
    "doc_freq",
    f"WITH {_PAGE_DOCS_SQL}, {POSTINGS_SQL} SELECT field, term, df FROM terms",
)
def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    docs = plan.page_docs(table(spark, folder, "pages"))
    return idx.term_stats(idx.postings(docs))


@query(
    "corpus_stats",
    f"""WITH {_PAGE_DOCS_SQL}, {POSTINGS_SQL}
    SELECT field, n_docs, sum_dl, round(avgdl, 6) AS avgdl FROM corpus""",
)
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = plan.page_docs(table(spark, folder, "pages"))
    return idx.corpus_stats(idx.postings(docs)).withColumn("avgdl", F.round("avgdl", 6))


@query(
    "index_build",
    f"""WITH {_PAGE_DOCS_SQL}, {POSTINGS_SQL}
    SELECT p.field, p.term, CAST(sum(p.tf) AS BIGINT) AS total_tf, t.df, c.n_docs, c.sum_dl
    FROM postings p JOIN terms t ON t.field = p.field AND t.term = p.term
    JOIN corpus c ON c.field = p.field GROUP BY ALL""",
)
def index_build(spark: SparkSession, folder: str) -> DataFrame:
    docs = plan.page_docs(table(spark, folder, "pages"))
    built = plan.build_index(docs, Workspace(spark))
    totals = built.postings.groupBy("field", "term").agg(F.sum("tf").alias("total_tf"))
    return totals.join(built.terms, ["field", "term"]).join(
        built.corpus.drop("avgdl"), "field"
    )


@query(
    "index_append",
    f"""WITH {_PAGE_DOCS_SQL}, {POSTINGS_SQL}
    SELECT p.field, p.term, CAST(sum(p.tf) AS BIGINT) AS total_tf, t.df, c.n_docs, c.sum_dl
    FROM postings p JOIN terms t ON t.field = p.field AND t.term = p.term
    JOIN corpus c ON c.field = p.field GROUP BY ALL""",
)
def index_append(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the pages first, half of them with older texts, then all: the same as one build."""
    docs = plan.page_docs(table(spark, folder, "pages"))
    older = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", F.lit("older words"), F.col("content")))
    third = docs.where(F.col("doc_id") % 3 == 0)
    old = third.withColumn("content", F.coalesce(older, F.col("content")))
    first = plan.build_index(old, Workspace(spark))
    built = plan.add_documents(first, docs)
    totals = built.postings.groupBy("field", "term").agg(F.sum("tf").alias("total_tf"))
    return totals.join(built.terms, ["field", "term"]).join(
        built.corpus.drop("avgdl"), "field"
    )


_CRAWL_DOCS_SQL = rf"""{OPEN_SQL},
crawled AS (SELECT crawl_id, page_id AS pid, url FROM out1 WHERE message IS NULL),
docs AS (SELECT CAST('0x' || substr(md5(c.crawl_id || chr(10) || c.url), 1, 15) AS BIGINT) AS doc_id,
           c.url, {title_sql('s.html')} AS title, {body_sql('s.html')} AS content
         FROM crawled c JOIN site_pages s ON s.page_id = c.pid
         UNION ALL
         SELECT CAST('0x' || substr(md5(crawl_id || chr(10) || crawl_id || '/'), 1, 15) AS BIGINT),
           crawl_id || '/', 'Home', 'Pages of ' || crawl_id FROM sites)"""


@query(
    "crawl_search",
    f"""WITH {FIXED_QUERIES_SQL}, {_CRAWL_DOCS_SQL}, {POSTINGS_SQL}, {SCORES_SQL},
    {_FLAGS_SQL}, {_SNIPPETS_SQL} SELECT query_id, rank, url, snippet FROM shown""",
)
def crawl_search(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl all sites, index what came in, search it."""
    ws = Workspace(spark)
    docs = open_crawl(spark, folder).docs.select("doc_id", "url", "title", "content")
    found = plan.search(plan.build_index(docs, ws), fixed_queries(spark), ws)
    return found.select("query_id", "rank", "url", "snippet")


@searching(
    "bm25_topk",
    "pages",
    f"""WITH {FIXED_QUERIES_SQL}, {_PAGE_DOCS_SQL}, {POSTINGS_SQL}, {SCORES_SQL}
    SELECT query_id, doc_id, score, hit FROM best""",
)
def bm25_topk(spark: SparkSession, folder: str, index: plan.SearchIndex) -> DataFrame:
    return plan.top_scored(index, fixed_queries(spark), Workspace(spark))


@searching(
    "search_pages",
    "pages",
    f"""WITH {FIXED_QUERIES_SQL}, {_PAGE_DOCS_SQL}, {POSTINGS_SQL}, {SCORES_SQL},
    {_FLAGS_SQL}, {_SNIPPETS_SQL} SELECT query_id, rank, url, snippet FROM shown""",
)
def search_pages(spark: SparkSession, folder: str, index: plan.SearchIndex) -> DataFrame:
    found = plan.search(index, fixed_queries(spark), Workspace(spark))
    return found.select("query_id", "rank", "url", "snippet")


@searching(
    "search_batch",
    "documents",
    f"""WITH {_ITEM_QUERIES_SQL}, {_TEXT_DOCS_SQL}, {POSTINGS_SQL}, {SCORES_SQL},
    {_FLAGS_SQL}, {_SNIPPETS_SQL} SELECT query_id, rank, url, snippet FROM shown""",
)
def search_batch(spark: SparkSession, folder: str, index: plan.SearchIndex) -> DataFrame:
    found = plan.search(index, item_queries(spark, folder), Workspace(spark))
    return found.select("query_id", "rank", "url", "snippet")


@searching(
    "rerank_tiers",
    "documents",
    f"""WITH {_ITEM_QUERIES_SQL}, {_TEXT_DOCS_SQL}, {POSTINGS_SQL}, {SCORES_SQL},
    {_FLAGS_SQL} SELECT query_id, rank, tier, url FROM results""",
)
def rerank_tiers(spark: SparkSession, folder: str, index: plan.SearchIndex) -> DataFrame:
    ws = Workspace(spark)
    best = ws.save(plan.top_scored(index, item_queries(spark, folder), ws), "hits")
    hits = best.join(index.docs.select("doc_id", "url", "homepage", "article"), "doc_id")
    return ranking.rerank(hits).select(
        "query_id", "rank", F.col("tier").cast("bigint").alias("tier"), "url"
    )


_MARKED = ("the", "nicht", "que", "of")


@query(
    "highlight",
    f"""WITH {_PAGE_DOCS_SQL}
    SELECT doc_id, {_highlights_sql('title', str(list(_MARKED)))}[1] AS title_hit,
           array_to_string({_highlights_sql('content', str(list(_MARKED)))}, ' | ') AS content_hits
    FROM docs""",
)
def highlight(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _MARKED])
    docs = plan.page_docs(table(spark, folder, "pages"))
    return docs.select(
        "doc_id",
        F.get(text.highlights(F.col("title"), words), F.lit(0)).alias("title_hit"),
        F.array_join(text.highlights(F.col("content"), words), " | ").alias("content_hits"),
    )


@query(
    "highlight_best",
    rf"""WITH {_PAGE_DOCS_SQL},
    cut AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(content, ''), '(?s){_PASSAGE}'),
              lambda p: trim(p, ' ')) AS ps FROM docs),
    each AS (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS place FROM cut),
    rated AS (SELECT *, len(list_distinct(list_filter(
                regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+'),
                lambda w: list_contains({list(_MARKED)}, w)))) AS cover FROM each),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cover DESC, place) AS nth
             FROM rated WHERE cover > 0)
    SELECT d.doc_id, array_to_string(list_transform(
             regexp_extract_all(b.p, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'),
             lambda x: CASE WHEN list_contains({list(_MARKED)}, lower(x))
                            THEN '<em>' || x || '</em>' ELSE x END), '') AS content_hit
    FROM docs d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.nth = 1""",
)
def highlight_best(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _MARKED])
    docs = plan.page_docs(table(spark, folder, "pages"))
    return docs.select("doc_id", text.best_highlight(F.col("content"), words).alias("content_hit"))
