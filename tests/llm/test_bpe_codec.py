"""Encoding at forced boundaries against the library."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crawlweave.llm import bpe_codec, queries

FOLDER = os.environ.get("CATALOG_FOLDER", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = (
    "a b à à  é ñ 中 文 X 1 23 ' 's 'll ! ... - : ) | . , ▁ <|endoftext|> <|endof word  the ".split(" ")
    + ["  ", "\n", "\t", " ", "　", "\r\n", "​", "́", "\x00", "\U0001f642", " the", "à ", "¦.", "\x85"]
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randrange(14))) for _ in range(n)]


def test_same_ids_as_the_library(library):
    codec, decoder = bpe_codec.Codec(bpe_codec.read_model(PATH)), bpe_codec.Decoder(bpe_codec.read_model(PATH))
    for text in some_texts(6000):
        ids = codec.encode(text.encode())
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_special_strings_as_plain_text():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    codec = bpe_codec.Codec(bpe_codec.read_model(PATH), specials=False)
    for text in some_texts(500, 2):
        got = np.frombuffer(codec.encode(text.encode()), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_no_merge_crosses_a_forced_boundary():
    codec = bpe_codec.Codec(bpe_codec.read_model(PATH))
    letters, rnd = sorted(bpe_codec.byte_alphabet()), random.Random(3)
    cut = 0
    for _ in range(2000):
        part = "".join(rnd.choices(letters, k=rnd.randrange(1, 12)))
        pieces = codec.fragments(part)
        cut += len(pieces) > 1
        assert "".join(pieces) == part
        whole = [t.id for t in codec._merge.tokenize(part)]
        assert whole == [t.id for p in pieces for t in codec._merge.tokenize(p)]
    assert cut > 1000


def test_memory_is_given_back(monkeypatch):
    monkeypatch.setattr(bpe_codec, "MEMO", 50)
    codec = bpe_codec.Codec(bpe_codec.read_model(PATH))
    fresh = bpe_codec.Codec(bpe_codec.read_model(PATH))
    for text in some_texts(300, 4):
        assert codec.encode(text.encode()) == fresh.encode(text.encode())
        assert len(codec._pieces) < 100


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.read_model(public_tokenizers.path("word_bpe_49k.json"))


def test_odd_rows(spark, odd, none, library):
    encoded = bpe_codec.encode_documents(odd, PATH)
    got = bpe_codec.decode_documents(encoded, PATH).collect()
    assert len(got) == odd.count()
    texts = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert {(r._id, r.decoded) for r in got} == texts
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert bpe_codec.decode_documents(bpe_codec.encode_documents(none, PATH), PATH).count() == 0


def test_query(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_bpe_codec(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert mine.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
