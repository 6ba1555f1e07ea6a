"""Operators on small tables with every odd case, and against brute force."""

import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import brute_lines, brute_near, brute_passages
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlweave.llm import (
    chat_format,
    chat_template,
    decontamination,
    embedding_dedup,
    graph,
    hashing,
    language_id,
    line_dedup,
    minhash_dedup,
    mixing,
    ngram_lm,
    substring_dedup,
    token_counts,
)
from crawlweave.llm.rows import keyed, packed

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_hashes_follow_words():
    texts = ["ab", "cd AB", None, "", "x" * 200_000 + " ab", "é ab"]
    data, at = packed(pa.array(texts))
    words, first = hashing.word_hashes(data, at)
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(words) == len(want) and len(set(words.tolist())) == len(set(want))
    assert {w: h for w, h in zip(want, words.tolist())}[b"ab"] == words[0]
    assert first.tolist() == [0, 1, 3, 3, 3, 5, 7]


def test_components(spark, ws):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (5, 5)]
    links += [(1000, 1000 + i) for i in range(1, 50)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(df, ws, "c").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == 100
    assert all(got[1000 + i] == 1000 for i in range(50))
    assert graph.components(df.where("a < 0"), ws.child("e"), "c").count() == 0


# --- lines -------------------------------------------------------------------------------


@pytest.mark.parametrize("keep_first", [True, False])
def test_lines_spread_over_partitions(spark, ws, keep_first):
    """One line in every document, so its run crosses every partition."""
    rnd = random.Random(1)
    rows = [
        (i, "\n".join(["same line", *(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(6))), " SAME line\t"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    bitmaps = line_dedup.line_bitmaps(df, ws, min_docs=5, keep_first=keep_first)
    got = line_dedup.with_kept_text(keyed(df), bitmaps).collect()
    want = brute_lines(rows, 5, keep_first)
    assert {(r._id, r._text): r._kept for r in got} == want


def test_odd_lines(spark, ws, odd, none):
    bitmaps = line_dedup.line_bitmaps(odd, ws, min_docs=2, keep_first=True)
    got = line_dedup.with_kept_text(keyed(odd), bitmaps).collect()
    assert len(got) == odd.count()
    by = {(r._id, r._text): r for r in got}
    assert (by[2, None].n_lines, by[2, None].n_dropped, by[2, None]._kept) == (1, 0, "")
    assert by[1, "Alpha beta\n  Gamma\n\nalpha BETA\n"].n_dropped == 1
    assert by[5, "Alpha beta"]._kept == "" and by[5, "Alpha beta"].n_dropped == 1
    kept = line_dedup.drop_lines(odd, ws.child("d"), min_docs=2)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert line_dedup.drop_lines(none, ws.child("e")).count() == 0


# --- substrings --------------------------------------------------------------------------


def test_units_tile_the_text():
    text = "One two. Three!  four\nfive a.b c?\n\n...six"
    found = list(substring_dedup.units(text))
    assert [text[a:b] for a, b, _, _ in found] == [
        "One two. ", "Three!  ", "four\n", "five a.b c?\n\n", "...six",
    ]
    assert [n for *_, n in found] == [2, 1, 1, 3, 1]


def test_passage_in_most_documents(spark, ws):
    passage = " ".join(f"w{i}" for i in range(60)) + ". "
    rows = [(i, f"Start {i} here. {passage}The end of {i}.") for i in range(300)]
    rows += [(1000 + i, f"Nothing in common {i} at all. Really {i}.") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = substring_dedup.repeated_passages(df, ws).collect()
    assert sorted(r._id for r in got) == list(range(1, 300))
    assert {r.first_id for r in got} == {0}
    assert all(dict(rows)[r._id][r.start : r.end] == passage for r in got)
    cleaned = substring_dedup.drop_passages(df, ws.child("d"))
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[7] == "Start 7 here. The end of 7." and passage in texts[0]


def test_odd_substrings(spark, ws, odd, none):
    got = substring_dedup.repeated_passages(odd, ws, min_words=1).collect()
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    want = brute_passages(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), 1)
    assert {(r._id, r.start, r.end, r.n_words, r.first_id) for r in got} == want
    cleaned = substring_dedup.drop_passages(odd, ws.child("d"), min_words=1)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert substring_dedup.repeated_passages(none, ws.child("e")).count() == 0


def test_passages_without_sentence_ends(spark, ws):
    """Every 51 words that stand in an earlier document lose words, wherever the passage lies."""
    rnd = random.Random(11)

    def noise(n):
        return [f"n{rnd.randrange(10**9)}" for _ in range(n)]

    def stopped(words, every, stop="."):
        return [w + stop if i % every == every - 1 else w for i, w in enumerate(words)]

    rows = []
    for kind in range(120):
        size = rnd.randrange(51, 75)
        passage = noise(size)
        if kind % 4 == 0:  # three sentences, the outer ones shared in part
            passage = stopped(passage, 25)
        elif kind % 4 == 1:
            passage = stopped(passage, 9, "\u3002")
        elif kind % 4 == 2:  # a stop in the middle, a changed word next to either end
            passage = stopped(passage, size // 2)
        for copy in range(2):
            before, after = noise(rnd.randrange(3, 40)), noise(rnd.randrange(3, 40))
            space = "\u00a0" if kind % 8 == 3 and copy else " "
            rows.append((2 * kind + copy, space.join([*before, *passage, *after])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring_dedup.repeated_passages(df, ws).collect()
    removed = {i: set() for i, _ in rows}
    for r in got:
        text = dict(rows)[r._id]
        lo = len(text[: r.start].split())
        assert len(text[r.start : r.end].split()) == r.n_words >= 30
        removed[r._id].update(range(lo, lo + r.n_words))
    seen = set()
    for i, text in rows:
        words = text.split()
        windows = [(p, tuple(words[p : p + 51])) for p in range(len(words) - 50)]
        shared = {p + j for p, window in windows if window in seen for j in range(51)}
        seen.update(window for _, window in windows)
        assert len(shared) >= 51 if i % 2 else not shared
        assert len(shared - removed[i]) <= 2 * substring_dedup.EDGE
        assert removed[i] <= shared


# --- language ----------------------------------------------------------------------------


def test_odd_languages(spark, ws, odd, none):
    rows = [
        (100 + i, t, lang, "s")
        for i in range(40)
        for t, lang in (("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"))
    ]
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    )
    model = language_id.fit(docs, F.lit(True), ws)
    assert model.languages == ["de", "en"]
    got = language_id.predict(docs.select("doc_id", F.col("text").alias("_text")), model).collect()
    for r in got:
        if not r._text or not any(c.isalpha() for c in r._text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r._text and r._text.startswith("der hund"):
            assert r.lang_pred == "de" and r.score > 0.5
    kept = language_id.keep_identified(odd, ws.child("k"))
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    assert language_id.fit(none, F.lit(True), ws.child("n")).languages == []
    assert language_id.keep_identified(none, ws.child("e")).count() == 0


def test_temperature():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3))
    logits[np.arange(4000), labels] += 1.5
    assert abs(language_id.temperature(logits * 4, labels) / language_id.temperature(logits, labels) - 4) < 0.1


# --- mixing ------------------------------------------------------------------------------


def test_targets():
    got = {s: t for s, _, t in mixing.targets([("a", 10), ("b", 100), (None, 100), ("c", 0)], (5, 2, 1), 3)}
    assert got["a"] == 30 and got["c"] == 0 and abs(sum(got.values()) - 210) < 1e-9
    assert abs(got["b"] / got[None] - 2 / 5) < 1e-9  # b weighs 2, c 1, null 5 again
    assert mixing.targets([], (1,), 3) == [] and mixing.targets([("a", 0)], (1,), 3)[0][2] == 0


def test_mix(spark, ws, odd, none):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(20), "en", rnd.choice(["big"] * 6 + ["mid", "low", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(df, ws).collect()
    again = {r._id: r.taken for r in mixing.mix(df.repartition(3), ws.child("2")).collect()}
    assert {r._id: r.taken for r in got} == again
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    taken = mixing.take_mix(odd.withColumn("size", F.lit("clash")), ws.child("o"))
    assert taken.columns[-4:] == ["size", "source_size", "target", "taken"]
    assert taken.where("text is null").count() == 0 and taken.count() > 0
    assert mixing.mix(none, ws.child("e")).count() == 0


# --- tokens ------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, ws):
    rnd = random.Random(4)
    pieces = [" ", "  ", "\n", "\n\n", "\t", " ", "a", "Don't", "x,", "end.", "12", "<|endoftext|>",
              "é", "日本", "...", "'s", " \n", "\r\n", "🙂", "　", "!?", ",.", "a.,"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(40))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    counter = token_counts.Counter(token_counts.tokenizer_version(TOKENIZER)[0])
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.counts(texts) == want


def test_cache(spark, ws, odd, none):
    cache = ws.path("cache")
    first = token_counts.count_tokens(odd, ws, TOKENIZER, cache)
    got = {(r._id, r.n_bytes): r.n_tokens for r in first.collect()}
    assert first.count() == odd.count() and got[2, 0] == 0 and got[6, 120003] == 30001
    stored = spark.read.parquet(cache)
    distinct = odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert stored.count() == distinct
    assert token_counts.count_tokens(odd, ws, TOKENIZER, cache).count() == odd.count()
    assert spark.read.parquet(cache).count() == distinct  # nothing encoded twice
    other = token_counts.count_tokens(odd, ws, public_tokenizers.path("word_bpe_49k.json"), cache)
    assert other.count() == odd.count() and spark.read.parquet(cache).count() == 2 * distinct
    assert token_counts.count_tokens(none, ws.child("e"), TOKENIZER).count() == 0


def test_cache_that_two_jobs_wrote(spark, ws, odd):
    caches = [ws.path("one"), ws.path("two")]
    want = [token_counts.count_tokens(odd, ws, TOKENIZER, c).collect() for c in caches][0]
    spark.read.parquet(caches[1]).write.mode("append").parquet(caches[0])
    got = token_counts.count_tokens(odd, ws, TOKENIZER, caches[0]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


# --- near duplicates ---------------------------------------------------------------------


def test_family_of_edited_copies(spark, ws, monkeypatch):
    """Copies edited apart: many pairs are close to the limit on either side."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rnd = random.Random(9)
    origin = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(origin)
        for _ in range(rnd.randrange(9)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((500 - i, " ".join(words)))
    rows += [(1000 + i, rows[i % 7][1].upper()) for i in range(30)]
    rows += [(2000 + i, " ".join(f"y{rnd.randrange(50)}" for _ in range(rnd.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r._id: (r.n_shingles, r.component) for r in minhash_dedup.near_duplicates(df, ws).collect()}
    assert got == brute_near(rows)


def test_keys_cover_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash_dedup.PLACES).astype(np.uint16)
        b = a.copy()
        places = rng.choice(minhash_dedup.PLACES, minhash_dedup.DISTANCE, replace=False)
        b[places] ^= rng.integers(1, 1 << 16, len(places)).astype(np.uint16)
        keys = minhash_dedup.chunk_keys(np.stack([a, b]))
        shared = np.flatnonzero(keys[0] == keys[1])
        assert len(shared)
        assert minhash_dedup.first_slots(a, b[None])[0] in shared


def test_near_duplicates_of_each_text_of_an_id(spark, ws):
    texts = [[f"t{i}w{k}" for k in range(100)] for i in range(12)]
    rows, want = [], {}
    for i in range(0, 12, 2):
        near = list(texts[i + 1])
        near[50] = "changed"
        # Two texts under one id, and near copies of both, and an exact one, under others.
        rows += [(i, " ".join(texts[i])), (i, " ".join(texts[i + 1])), (100 + i, " ".join(near))]
        other = list(texts[i])
        other[20] = "other"
        rows += [(200 + i, " ".join(other)), (300 + i, " ".join(texts[i + 1]))]
        want |= {i: i, 100 + i: i, 200 + i: i, 300 + i: i}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, ws).collect()
    assert len(got) == len(rows) and {r._id: r.component for r in got} == want


def test_odd_near_duplicates(spark, ws, odd, none):
    got = minhash_dedup.near_duplicates(odd, ws).collect()
    assert len(got) == odd.count()
    assert all(r.kept for r in got if r._id is None or not r.n_shingles)
    kept = minhash_dedup.drop_near_duplicates(odd, ws.child("d"))
    assert kept.columns == odd.columns
    assert minhash_dedup.near_duplicates(none, ws.child("e")).count() == 0


def test_near_vectors(spark, ws, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(250, 24))
    group = base[0] + 0.1 * rng.normal(size=(120, 24))
    pairs = base[1:60] + 0.2 * rng.normal(size=(59, 24))
    vectors = np.concatenate([base, group, pairs, base[:5], base[:5] * 2])
    n = len(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24),
           (n + 4, [None] + [1.0] * 23), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    result = embedding_dedup.near_vectors(df.withColumn("key", F.lit(1)), ws).collect()
    got = {r._id: r for r in result}
    assert len(result) == len(rows) + len(odd)
    found = sum(got[i].n_links for i in range(n))
    assert all(got[i].n_links <= close[i].sum() - 1 for i in range(n))
    assert found >= 0.95 * (close.sum() - n)
    assert all(got[i].component == 0 for i in range(250, 370))
    for i in [*range(n, n + 5), None]:
        assert (got[i].n_links, got[i].component, got[i].kept) == (0, i, True)
    assert got[n + 6].component == n + 5 and got[n + 6].n_links == 1
    assert embedding_dedup.near_vectors(df.where("vec_id = -1"), ws.child("e")).count() == 0


# --- benchmark ---------------------------------------------------------------------------


def test_odd_contamination(spark, ws, odd, none):
    items = spark.createDataFrame(
        [(1, "Alpha, beta!"), (2, None), (3, "?!"), (None, "alpha beta"), (10, "one " * 40), (11, "zzz")],
        "item_id bigint, text string",
    ).withColumn("win", F.lit("clash"))
    got = decontamination.contamination(odd, items, ws).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r._id].append(r)
    assert all(r.item_ids == ["", "1"] for r in by[5] if r.n_words == 2)
    one = by[6][0]
    assert (one.n_words, one.n_hit, one.item_ids, one.contaminated) == (30001, 30000, ["10"], True)
    assert [(r.n_words, r.contaminated) for r in by[2]] == [(0, False)]
    kept = decontamination.drop_contaminated(odd, items, ws.child("d"))
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0
    assert decontamination.contamination(none, items, ws.child("e")).count() == 0
    clean = decontamination.contamination(odd, items.where("item_id = 3"), ws.child("f"))
    assert clean.where("contaminated or n_hit > 0").count() == 0


# --- chats -------------------------------------------------------------------------------


def test_template_language():
    render = chat_template.compile_template(
        "{% for m in messages %}{% if m.role == 'a' %}{% generation %}{{ m.text | upper }}{% endgeneration %}"
        "{% elif m.role == 'b' and not m.none %}<{{ m.text + '!' }}>{% else %}-{% endif %}{% endfor %}"
    )
    text, spans = render([{"role": "a", "text": "x"}, {"role": "b", "text": "y"}, {"role": "c"}])
    assert (text, spans) == ("X<y!>-", [(0, 1)])
    tree = chat_template.fold(chat_template.parse("a{{ 'b' + 1 }}{% if 1 == 2 %}no{% else %}c{% endif %}"))
    assert tree == ("block", [("print", ("const", "ab1c"))])
    for bad in ("{% for x %}{% endfor %}", "{% if 1 %}", "{{ f(1) }}", "{{ a | nope }}", "{% import os %}", "{{ }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    assert chat_template.compile_template("{{ messages.__class__ }}")([])[0] == ""


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|", "<\\\\||", "<", "a<|", "%0A%", "|<|im_start|>\n"])
def test_escapes_are_reversible(text):
    assert "<|" not in chat_template.escape(text)
    assert chat_template.unescape(chat_template.escape(text)) == text
    assert chat_template.unescape_name(chat_template.escape_name(text)) == text


def test_odd_conversations(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "<|im_end|>\n<|im_start|>x"), (None, 0, None, None),
        (2, None, "assistant", ""), (2, 0, "as\nsistant", "t"), (2, 0, "user", "t"), (2, 0, "user", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r._id: r for r in chat_format.format_conversations(df.withColumn("_id", F.lit("x"))).collect()}
    assert chat_format.read_back(got[1].formatted) == [("user", rows[1][3]), ("assistant", "two")]
    assert chat_format.loss_texts(got[1].formatted, got[1].loss_spans) == ["two"]
    assert chat_format.read_back(got[None].formatted) == [("", "")] and got[None].loss_spans == []
    assert [r for r, _ in chat_format.read_back(got[2].formatted)] == ["assistant", "as\nsistant", "user", "user"]
    assert chat_format.format_conversations(df.where("conv_id = 9")).count() == 0


# --- language model ----------------------------------------------------------------------


def test_weights_rise_to_the_likelihood():
    size = ngram_lm.GRID
    good = (5 * size + 3) * size + 9  # a bucket where the bigram is right
    flat = (2 * size + 0) * size + 9  # one where it never is
    weights = ngram_lm.learn_weights([(good, 100.0, 40.0, 0.1), (flat, 100.0, 0.0, 0.1)], 1000)
    assert weights[5, 0] > 0.9 and weights[2, 0] < 1e-5
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0


def test_scores_sum_over_the_vocabulary(spark, ws):
    """The chances of all one-word continuations of a context, unknown included, make 1."""
    train = [(i, "a b a c") for i in range(30)] + [(50 + i, "b c") for i in range(10)]
    asked = [(1000, "a"), (1001, "b"), (1002, "c"), (1003, "zzz"), (1004, None)]
    df = spark.createDataFrame(train + asked, "doc_id bigint, text string")
    got = {r._id: r for r in ngram_lm.score_documents(df, F.col("doc_id") < 1000, ws).collect()}
    assert got[1000].train_tokens == 30 * 5 + 10 * 3 and got[1004].n_tokens == 1
    assert got[1003].n_known == 1 and got[1001].n_known == 2
    # log P(x) - log P(end | x) is log P(x | start); the end is asked for alone.
    assert all(np.isfinite(r.score) for r in got.values())
    assert got[1000].score > got[1003].score


def test_packed_numbers():
    for kind in (np.uint64, np.uint32, np.int64):
        values = np.array([0, 1, 255, 256, 2**31 - 1], kind)
        assert (ngram_lm.unpack_numbers(ngram_lm.pack_numbers(values), kind) == values).all()


def test_odd_scores(spark, ws, odd, none):
    got = ngram_lm.score_documents(odd, F.col("doc_id") != 6, ws).collect()
    assert len(got) == odd.count()
    assert all(not r.train for r in got if r._id in (None, 6))
    assert all(r.n_tokens == 1 for r in got if r._id in (2, 3, 4))
    nothing = ngram_lm.score_documents(odd, F.lit(False), ws.child("n")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in nothing)
    assert ngram_lm.score_documents(none, F.lit(True), ws.child("e")).count() == 0


def test_equal_rows_are_taken_once_each(spark, ws):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", None), (2, "e " * 100, "y"), (None, "f g", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [tuple(r) for r in mixing.mix(docs, ws, (1, 9, 1)).select("_id", "source", "taken").collect()]
    got = mixing.take_mix(docs, ws.child("t"), weights=(1, 9, 1)).collect()
    assert collections.Counter((r.doc_id, r.source, r.taken) for r in got) == collections.Counter(w for w in want if w[2])
    half = mixing.take_mix(docs, ws.child("h"), weights=(1, 40, 40), max_epochs=1).collect()
    assert sum(r.taken for r in half if r.source == "x") == int(max(r.target for r in half if r.source == "x"))
