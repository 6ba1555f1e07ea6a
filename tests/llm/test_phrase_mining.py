"""Phrase counts and scores against plain counting."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from crawlweave.llm import phrase_mining


def brute_counts(rows, longest):
    """Occurrences of all phrases of one to ``longest`` words by language."""
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts


def brute_top(rows, min_count, longest, top):
    out = set()
    for lang, counts in brute_counts(rows, longest).items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        scored = []
        for p, a in often.items():
            inside = any(
                len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, c in often.items()
            )
            if not inside:
                cuts = [(1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], n, score))
        for rank, (_, _, p, *rest) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), *rest))
    return out


def some_rows(n=250):
    rnd = random.Random(6)
    words = ["the", "of", "Ée", "x1", "new", "york", "city", "a", "b", "THE", "\t", "-"]
    ends = [" ", " ", " ", "  ", ". ", ",", "\n", "\x0b", "? "]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(40)))
        rows.append((rnd.choice(["en", "de", None]), "the the the the the the " * (i % 3) + text))
    return [*rows, ("fr", None), ("fr", ""), (None, " \t\n")]


def test_trie_bursts_and_spills():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(1, 30, (6000, 5)).astype(np.uint32)
    rows[rnd.random(6000) < 0.6, 0] = 7  # one word begins most runs
    rows[rnd.random(6000) < 0.3, 3:] = 0
    trie = phrase_mining.HatTrie(5, burst=20, entries=500)
    for lo in range(0, 6000, 700):
        trie.add(rows[lo : lo + 700])
    bursts = len(trie.inner)
    keys, counts = trie.runs()
    got = collections.Counter()
    for key, n in zip(map(tuple, keys.tolist()), counts.tolist(), strict=True):
        got[key] += n
    assert got == collections.Counter(map(tuple, rows.tolist()))
    assert bursts or len(trie.spilled) > 3
    for data, _ in trie.spilled:
        run = [data[i : i + 20] for i in range(0, len(data), 20)]
        assert run == sorted(run)


def test_a_container_is_fed_once_for_a_first_word(monkeypatch):
    calls = []

    class Counted(collections.Counter):
        def update(self, *given):
            calls.append(given)
            super().update(*given)

    monkeypatch.setattr(phrase_mining, "Counter", Counted)
    trie = phrase_mining.HatTrie(3, burst=1000)
    trie.add(np.array([[1 + i % 2, i + 1, 5] for i in range(200)], np.uint32))
    assert len([c for c in calls if c]) <= 4
    keys, counts = trie.runs()
    assert sorted(map(tuple, keys.tolist())) == sorted((1 + i % 2, i + 1, 5) for i in range(200))
    assert counts.tolist() == [1] * 200


def test_counts_over_many_partitions(spark, ws, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        phrases, words, totals = phrase_mining.phrase_counts(df, ws, min_count=3)
        names = {r.id: (r.lang, r.word) for r in words.collect()}
        got = {(names[r.ids[0]][0], tuple(names[i][1] for i in r.ids)): r.n for r in phrases.collect()}
        sums = {r.lang: r.total for r in totals.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    counts = brute_counts(rows, 5)
    assert got == {(g, p): c for g, of in counts.items() for p, c in of.items() if c >= 3 and len(p) > 1}
    assert {g: n for g, n in sums.items()} == {
        g: sum(c for p, c in of.items() if len(p) == 1) for g, of in counts.items() if of
    }


def held_rows(spark, blocks=7):
    """A row per block and word, as blocks send them; every block has the word ``w0``."""
    rows = [
        (b, i + 1, lang, f"w{i}", 1 + (i + b) % 3)
        for b in range(blocks)
        for lang in ("de", "en")
        for i in range(40)
        if (i * b) % (5 + i % 2) == 0
    ]
    return rows, spark.createDataFrame(rows, "block bigint, at int, lang string, word string, n bigint")


def test_words_stay_the_rows_that_blocks_sent(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "BUCKETS", 3)  # so many words share a bucket
    rows, held = held_rows(spark)
    sums = collections.Counter()
    for _, _, lang, word, n in rows:
        sums[lang, word] += n
    got = phrase_mining.common_words(held.repartition(5), 6).collect()
    want = {(b, at, lang, word, sums[lang, word]) for b, at, lang, word, _ in rows if sums[lang, word] >= 6}
    assert len(got) == len(want) < len(rows) and {(r.block, r.at, r.lang, r.word, r.n) for r in got} == want
    ids = {(r.lang, r.word, r.id) for r in got}
    names = {x[:2] for x in ids}
    assert len(ids) == len(names) == len({x[2] for x in ids}) and min(x[2] for x in ids) > 0
    assert names == {k for k, n in sums.items() if n >= 6}


def test_more_words_than_numbers_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "BUCKETS", 1 << 30)
    monkeypatch.setattr(phrase_mining.F, "xxhash64", lambda *_: F.lit(7))  # all in one bucket
    with pytest.raises(ArithmeticException):
        phrase_mining.common_words(held_rows(spark)[1], 1).collect()


def test_blocks_learn_numbers_without_a_join_by_word(spark, ws, monkeypatch):
    df = spark.createDataFrame(some_rows(60), "lang string, text string").repartition(3)
    joined, kind = [], type(df)
    plain = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: joined.append(on) or plain(self, other, on, how))
    phrases, _, _ = phrase_mining.phrase_counts(df, ws, min_count=3)
    assert phrases.count() and joined and ["lang", "word"] not in joined


def test_scores_and_ranks(spark, ws):
    rows = some_rows(120)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("id", F.lit("x"))
    got = phrase_mining.collocations(df.repartition(4), ws, min_count=4, top=25)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 4, 5, 25)


def test_odd_phrases(spark, ws, odd, none):
    got = phrase_mining.collocations(odd, ws, min_count=2).collect()
    want = brute_top([(r.lang, r.text) for r in odd.collect()], 2, 5, 2000)
    assert {tuple(r) for r in got} == want and want
    assert phrase_mining.collocations(none, ws.child("e")).count() == 0
