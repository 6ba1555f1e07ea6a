"""Alignment of two tokenizers against a plain version."""

import collections
import hashlib
import os

import public_tokenizers
import pytest
import sentencepiece
from test_bpe_codec import some_texts
from tokenizers import Tokenizer

from crawlweave.llm import bpe_codec, queries, token_alignment

FOLDER = os.environ.get("CATALOG_FOLDER", "/root/testdata/sf0.001")
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Rows by place of the text, by the letter of the definition."""
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    spelled = bpe_codec.token_bytes(bpe_codec.plain_byte_bpe(bpe_codec.read_model(A)))

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], collections.Counter()
    for text in texts:
        a, b = [], []
        if text:
            a = left.encode(" " + text, add_special_tokens=False).ids
            b = right.encode(text)
            whole = (" " + text).encode()
            if b"".join(spelled[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
                a, b = [], []

        def ends(ids, of):
            at, out = 0, []
            for i in ids:
                at += len(of(i))
                out.append(at)
            return out

        ea, eb = ends(a, spelled.__getitem__), ends(b, piece)
        common = sorted(set(ea) & set(eb))
        group = lambda e: sum(c < e for c in common)  # noqa: B023, E731
        groups = [([], []) for _ in common]
        for ids, at, side in ((a, ea, 0), (b, eb, 1)):
            for i, e in zip(ids, at, strict=True):
                groups[group(e)][side].append(i)
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        counts.update(set(links))
        docs.append((a, b, groups, links))
    highest = collections.Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for a, b, groups, links in docs:
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if written else ""
        best = sum(counts[k] == highest[k[0]] for k in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[k] for k in links), digest))
    return out


def found(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r[0]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.fixture
def small(monkeypatch):
    """Joins by group in many parts."""
    monkeypatch.setattr(token_alignment, "LINKS", 5)


def test_odd_strings(spark, ws):
    texts = [t[:60] for t in some_texts(300, 7)] + ["", None, "a▁b", "<|endoftext|> </s>", "日本語のテキスト" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got, pairs = token_alignment.aligned(rows, ws, A, B)
    assert found(got) == dict(enumerate(brute(texts)))
    assert pairs.where("best").count() >= pairs.select("a").distinct().count()


def test_slices_and_parts(small):
    """The same numbers whatever the cuts, without Spark."""
    pair = token_alignment.Pair(bpe_codec.read_model(A), open(B, "rb").read())
    texts = [t.encode() for t in some_texts(40, 8)]
    a, b = zip(*map(pair.encode, texts), strict=True)
    whole, cells = token_alignment.align(list(a), list(b), pair)
    one = [token_alignment.align([x], [y], pair) for x, y in zip(a, b, strict=True)]
    assert [int(n["n_links"][0]) for n, _ in one] == whole["n_links"].tolist()
    assert sum(c.num_rows for _, c in one) == cells.num_rows
    assert [n["groups"].to_pylist()[0] for n, _ in one] == whole["groups"].to_pylist()


def test_odd_rows(spark, ws, odd, none):
    got, _ = token_alignment.aligned(odd, ws, A, B)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in rows if r._id in (2, 3))
    same = [r for r in rows if r._id == 5 and r.n_a == max(x.n_a for x in rows if x._id == 5)]
    assert all(r.n_groups > 0 and r.n_best <= r.n_links <= r.count_sum for r in same)
    assert token_alignment.aligned(none, ws.child("e"), A, B)[0].count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs]), strict=True))
    assert found(queries.op12_token_alignment(spark, FOLDER)) == want
