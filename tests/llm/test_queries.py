"""The registered queries against their SQL, or against brute force."""

import collections
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, connect
from tokenizers import Tokenizer

from crawlweave.llm import queries

FOLDER = os.environ.get("CATALOG_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    return sorted(rows, key=lambda r: r.doc_id)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name])
    assert ok, note


def test_substrings(spark, documents):
    """Every word removed is repeated, and next to no run of 51 repeated words is left.

    Runs of seven words or fewer over and over are left out, as the operator says.
    """
    got = collections.defaultdict(list)
    for r in queries.op2_substring_dedup(spark, FOLDER).collect():
        got[r.doc_id].append(r)
    seen, gone, runs, caught = {}, 0, 0, 0
    for r in documents:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in (r.text or "").split()]
        repeated, long_run = np.zeros(len(words), bool), np.zeros(len(words), bool)
        for size, marks in ((15, repeated), (51, long_run)):
            for i in range(len(words) - size + 1):
                if seen.setdefault(tuple(words[i : i + size]), (r.doc_id, i)) != (r.doc_id, i):
                    marks[i : i + size] = True
        sentence = 0
        for unit in re.split(r"(?<=[.!?])\s+|\n", r.text or ""):
            key = ("unit", *unit.translate({c: c + 32 for c in range(65, 91)}).split())
            if len(key) > 1 and seen.setdefault(key, (r.doc_id, sentence)) != (r.doc_id, sentence):
                repeated[sentence : sentence + len(key) - 1] = True
            sentence += len(key) - 1
        removed = np.zeros(len(words), bool)
        for p in got[r.doc_id]:
            first = len(r.text[: p.start].split())
            removed[first : first + p.n_words] = True
            assert p.n_words >= 30 and len(r.text[p.start : p.end].split()) == p.n_words
        gone += removed.sum()
        assert not (removed & ~repeated).any()
        edges = np.flatnonzero(np.diff(np.r_[False, long_run, False]))
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            if len(set(words[lo:hi])) <= 7:  # a few words over and over are no fingerprint
                continue
            runs += 1
            caught += removed[lo:hi].any()
    assert gone > 0 and runs > 0 and caught >= 0.99 * runs


def test_languages(spark, documents):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, FOLDER).collect()}
    held = [r for r in documents if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in got.values() if r.held_out} == {r.doc_id for r in held}
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert len(got) == len(documents) and right >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_tokens(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False)) for r in documents}
    got = queries.op5_token_counts(spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_scores(spark, documents):
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in documents}
    held = {d for d in tokens if zlib.crc32(str(d).encode()) % 5 == 1}
    counts = collections.Counter(t for d, ts in tokens.items() if d not in held for t in ts)
    total, types = sum(counts.values()), len(counts)
    got = queries.op10_lm_scores(spark, FOLDER).collect()
    assert len(got) == len(tokens)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(own), total)
        assert r.n_known == sum(t in counts for t in own)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    apart = [r for r in got if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
