"""Index and scores against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlweave import Workspace
from crawlweave.plans import search as plan

WORDS = "ab cd ef gh ij kl mn op été naïve".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        title = " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 4)))
        body = " ".join(rnd.choices(WORDS, weights=range(1, 11), k=rnd.randrange(0, 30)))
        rows.append((i, f"https://x.org/{rnd.choice(['news/', 'p/', 'a/b/'])}{i}", title, body))
    df = spark.createDataFrame(rows, "doc_id bigint, url string, title string, content string")
    return rows, plan.build_index(df, Workspace(spark))


def scores(rows, query):
    out = {}
    for field, boost in ((2, 3.0), (3, 1.0)):
        docs = {r[0]: r[field].split() for r in rows if r[field]}
        avg = sum(map(len, docs.values())) / len(docs)
        for d, words in docs.items():
            tf, s = Counter(words), 0.0
            for t in query:
                if tf[t]:
                    df = sum(t in w for w in docs.values())
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    s += idf * tf[t] / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / avg))
            if s:
                out[d] = max(out.get(d, 0), boost * s)
    return out


def test_scores(spark, corpus):
    rows, index = corpus
    asked = {1: "ab Été", 2: "cd cd kl", 3: "zz"}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    got = plan.top_scored(index, queries, Workspace(spark), hits=20).collect()
    for q, words in asked.items():
        want = scores(rows, words.lower().split())
        best = sorted(((-round(s, 6), d) for d, s in want.items()))[:20]
        mine = [(-r.score, r.doc_id) for r in sorted(got, key=lambda r: r.hit) if r.query_id == q]
        assert [d for _, d in mine] == [d for _, d in best]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in best])


def test_content_only(spark, corpus):
    rows, index = corpus
    queries = spark.createDataFrame([(1, "ab")], "query_id bigint, text string")
    got = plan.top_scored(index, queries, Workspace(spark), boosts={"content": 1.0}).collect()
    body = [(r[0], r[1], "", r[3]) for r in rows]
    want = scores([*body, (-1, "", "zz", "")], ["ab"])
    assert {r.doc_id for r in got} == set(sorted(want, key=lambda d: (-round(want[d], 6), d))[:80])


def test_one_query_equals_batch(spark, corpus):
    _, index = corpus
    words = "naïve gh"
    one = plan.search_one(index, words, Workspace(spark)).collect()
    batch = plan.search(index, plan.one_query(spark, words), Workspace(spark)).collect()
    assert sorted(one) == sorted(batch) and one
    assert all("<em>" in r.snippet for r in one)
    assert plan.search_one(index, "zz", Workspace(spark)).count() == 0


def test_scans_skip_what_a_query_does_not_need(spark, corpus):
    _, index = corpus
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [ab,cd])" in plan_of(index.postings.where(F.col("term").isin("ab", "cd")))
    assert "EqualTo(doc_id,3)" in plan_of(index.docs.where(F.col("doc_id").isin(3)))
    narrow = plan_of(index.docs.select("doc_id", "url").where(~F.col("homepage")))
    assert "content" not in narrow


def test_no_shuffle_before_the_cut(spark, corpus):
    """Scoring stays in the buckets; only per-task best hits are exchanged."""
    _, index = corpus
    top = plan.top_scored(index, plan.one_query(spark, "ab"), Workspace(spark))
    text = top._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    before_cut = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_cut.splitlines()[1]
    counted = plan.idx.postings(index.docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counted


def test_added_documents(spark, ws, corpus):
    rows, whole = corpus
    schema = "doc_id bigint, url string, title string, content string"
    start = plan.build_index(spark.createDataFrame(rows[:60], schema), ws)
    grown = plan.add_documents(start, spark.createDataFrame(rows[40:100], schema))
    grown = plan.add_documents(grown, spark.createDataFrame(rows, schema))
    for name in ("docs", "postings", "terms"):
        got, want = (
            sorted(map(str, getattr(i, name).select(getattr(whole, name).columns).collect()))
            for i in (grown, whole)
        )
        assert got == want, name
    assert grown.corpus.count() == whole.corpus.count() == 2
    found = [sorted(plan.search_one(i, "ab cd", ws).collect()) for i in (grown, whole)]
    assert found[0] == found[1] and found[0]


def test_replaced_documents(spark, ws, corpus):
    """Documents added again with other texts are found by these, and by nothing else."""
    rows, whole = corpus
    schema = "doc_id bigint, url string, title string, content string"
    old = [(i, u, t, f"older {c} ab" if i % 2 else c) for i, u, t, c in rows[:60]]
    old[3] = (*old[3][:2], "", "")
    start = plan.build_index(spark.createDataFrame(old, schema), ws)
    dated = [(*r, 2) for r in rows] + [(i, u, "zz", "zz", 1) for i, u, _, _ in rows[20:90]]
    batch = spark.createDataFrame(dated, f"{schema}, seen int")
    grown = plan.add_documents(start, batch.where("doc_id < 100"), newest="seen")
    grown = plan.add_documents(grown, batch, newest="seen")
    for name in ("docs", "postings", "terms", "corpus"):
        got, want = (
            sorted(map(str, getattr(i, name).select(getattr(whole, name).columns).collect()))
            for i in (grown, whole)
        )
        assert got == want, name
    assert plan.search_one(grown, "older", ws).count() == 0


def test_two_searches_in_one_workspace(spark, ws, corpus):
    _, index = corpus
    found = [plan.search_one(index, q, ws) for q in ("ab cd", "naïve")]
    first, second = (f.collect() for f in found)
    assert first and second and first != second


def _asked(spark):
    rnd = random.Random(9)
    words = [*WORDS, "zz", "ab cd", "op op"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 5)))) for i in range(40)]
    return spark.createDataFrame(rows, "query_id bigint, text string")


def test_pruned_equals_unpruned(spark, ws):
    """Also where segments were added, whose mean lengths differ from those of the whole."""
    rnd = random.Random(4)

    def some(lo, hi, most):
        return [
            (i, f"https://x.org/p/{i}", rnd.choice(["", "ab", "gh mn"]), " ".join(rnd.choices(WORDS, weights=range(1, 11), k=rnd.randrange(most))))
            for i in range(lo, hi)
        ]

    schema = "doc_id bigint, url string, title string, content string"
    index = plan.build_index(spark.createDataFrame(some(0, 600, 30), schema), ws)
    queries = _asked(spark)
    for step, rows in enumerate([[], some(500, 900, 200), some(880, 1000, 6)]):
        if rows:
            index = plan.add_documents(index, spark.createDataFrame(rows, schema))
        for boosts in ({"title": 3.0, "content": 1.0}, {"content": 1.0}):
            want = plan.all_scored(index, queries, ws, boosts, hits=7)
            for share in (1.0, plan.PRUNE_SHARE):
                got = plan.top_scored(index, queries, ws, boosts, hits=7, prune_share=share)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (step, share)
    full, whole = plan.scored_documents(index, queries, ws, hits=7)
    assert 0 < full < whole / 3


def test_index_opens_again_and_folds(spark, ws, corpus):
    rows, whole = corpus
    schema = "doc_id bigint, url string, title string, content string"
    home = ws.child("kept")
    assert plan.open_index(home) is None
    plan.add_to(home, spark.createDataFrame(rows[:50], schema))
    changed = [(i, u, t, f"{c} new") for i, u, t, c in rows[40:120]]
    plan.add_to(home, spark.createDataFrame(changed, schema))
    plan.add_to(home, spark.createDataFrame(rows, schema))
    found = plan.open_index(home)
    assert [s.number for s in found.segments] == [0, 1, 2]
    assert plan.add_to(home, spark.createDataFrame(rows[:10], schema)).version == found.version
    folded = plan.fold_index(found)
    assert len(plan.open_index(home).segments) == 1
    for index in (found, folded, plan.open_index(home)):
        for name in ("docs", "postings", "terms"):
            got, want = (sorted(map(str, getattr(i, name).select(getattr(whole, name).columns).collect())) for i in (index, whole))
            assert got == want, name


def test_update_leaves_old_files_alone(spark, ws, corpus):
    """An update writes its own documents, and a failed one is as if it had not begun."""
    rows, _ = corpus
    schema = "doc_id bigint, url string, title string, content string"
    start = plan.build_index(spark.createDataFrame(rows, schema), ws)
    before = {f for s in start.segments for f in s.postings.inputFiles()}
    one = spark.createDataFrame([(rows[3][0], rows[3][1], "t", "changed")], schema)
    # An attempt that ends before the list of segments is written.
    plan._write_segment(1, one, start.home)
    assert len(plan.open_index(start.home).segments) == 1
    grown = plan.add_documents(start, one)
    assert {f for f in grown.segments[0].postings.inputFiles()} == before
    assert grown.segments[1].postings.select("doc_id").distinct().count() == 1
    live = grown.live(grown.segments[0].postings, grown.segments[0])
    text = live._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in text and "Write" not in text
    assert grown.docs.where("doc_id = 3").select("content").collect()[0][0] == "changed"


def test_peaks_are_dealt_out_once(spark, ws, monkeypatch):
    plans, save = {}, Workspace.save

    def noted(self, df, name, *given, **named):
        plans[name] = df._jdf.queryExecution().toString()
        return save(self, df, name, *given, **named)

    monkeypatch.setattr(Workspace, "save", noted)
    docs = spark.createDataFrame([(1, "u", "a", "b b")], "doc_id bigint, url string, title string, content string")
    index = plan.build_index(docs, ws)
    assert "rangepartitioning" not in plans["peaks"]
    assert sorted((r.field, r.term, r.docs) for r in index.segments[0].peaks.collect()) == [("content", "b", 1), ("title", "a", 1)]
