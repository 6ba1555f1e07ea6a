"""The stages one by one, each against brute force on what it was given."""

import pytest
from brute import brute_lines, brute_near

import corpus_pipeline
from crawlweave import Workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = ws.save(stage(spark, docs, FOLDER), name)
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (_, _, before, after) in stages.items():
        assert after[: len(before)] == before
        assert name == "source_mix" or after == before


def test_languages_keep_clean_documents(stages):
    before, after, *_ = stages["language_id"]
    assert len(after) >= 0.99 * len(before)


def test_lines(stages):
    before, after, *_ = stages["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in before], 10, True)
    kept = {d: t for (d, text), t in want.items() if t or not text}
    assert {r.doc_id: r.text for r in after} == kept
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    before, after, *_ = stages["near_dedup"]
    want = brute_near([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {root for _, root in want.values()}


def test_contaminated_go(stages):
    before, after, *_ = stages["decontamination"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) < len(before)


def test_mix(stages):
    before, after, *_ = stages["source_mix"]
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] and 0 < r.taken <= 3 * r.size for r in after)
    for source in {r.source for r in after}:
        own = [r for r in after if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
