"""Byte-pair encoding and decoding by forced boundaries.

A merge only ever makes a token of the vocabulary. So two neighbouring bytes that
stand side by side inside no token are never joined, whatever surrounds them:
between them is a certain cut, and the fragments on its two sides can be encoded
independently and put together again. The table of such pairs is read off the
vocabulary once.

A text is cut twice. Where no token has the two bytes side by side, it falls apart at
once between a visible byte and a space or line feed, behind a line feed, and between
Latin letters and punctuation; the splitting rule breaks at these places, too. The ids
of each such piece are remembered while the worker lives (``MEMO`` pieces, then it
begins anew: only speed depends on it). A new piece is split as the tokenizer's
own rule says, each part is cut at forced boundaries, and the merges run on the
fragments. A text with other white space is one piece: the splitting rule looks
ahead over white space, which is the only thing that reaches across a cut.

Added tokens in a text become their ids, as the library does by default, or stay
plain text with ``specials=False``.

Rows are encoded where they lie; nothing is shuffled or collected, and a text that
many rows hold is no burden on any one task.

Defined cases: a null text encodes as the empty text, which has no ids; bytes that
are not UTF-8 are read as U+FFFD; rows keep their number, repeated ones included;
ids outside the vocabulary do not decode to anything; an empty table gives an empty
table; other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.rows import raw_texts, slices

MEMO = 400_000
LONGEST = 64  # bytes of a piece that is remembered

_ASCII_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: ASCII and Latin-1 letters, which any splitting rule keeps together.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
_ASCII_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
#: UTF-8 of all white space but space and line feed.
OTHER_SPACE = re.compile(
    rb"[\x09\x0b-\x0d\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80"
    rb"|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the others for what follows U+00FF.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(others)}


def plain_byte_bpe(model: bytes) -> dict:
    """The tokenizer file's content, or an error if it is another kind than is handled here."""
    spec = json.loads(model)
    bpe, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        bpe["type"] == "BPE"
        and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )
    if not plain:
        raise ValueError("not a byte-level BPE tokenizer without normaliser, prefix space and stripping tokens")
    return spec


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id; added tokens are their text."""
    of = byte_alphabet()
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *added]) + 1)
    for token, i in spec["model"]["vocab"].items():
        out[i] = added[i] if i in added else bytes(map(of.__getitem__, token))
    for i, text in added.items():
        out[i] = text
    return out


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """``[a, b]``: whether byte ``b`` follows byte ``a`` inside some token."""
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        data = np.frombuffer(token, np.uint8)
        inside[data[:-1], data[1:]] = True
    return inside


def certain_cuts(inside: np.ndarray) -> re.Pattern:
    """Pieces that end where the pair table and the splitting rule both cut."""

    def joined(before, after) -> bytes:
        """Looks at the place between two bytes: they stand side by side in a token."""
        pairs = [b"(?<=\\x%02x)\\x%02x" % (a, b) for a in before for b in after if inside[a, b]]
        return b"|".join(pairs) or rb"[^\x00-\xff]"

    marks = [b for b in range(0x21, 0x7F) if b not in _ASCII_LETTERS]
    ends = [*_ASCII_LETTERS, *range(0x80, 0xC0)]
    visible = [b for b in range(256) if b not in _ASCII_SPACE]
    before_space = joined(visible, [0x20, 0x0A])
    end = rb"(?!" + joined(ends, [0x20, 0x0A, *marks]) + rb")(?=[^A-Za-z\x80-\xff]|\Z)"
    return re.compile(
        b"|".join(
            [
                rb"\n(?=[^ \n])(?!" + joined([0x0A], visible) + rb")",
                _WORD.pattern + end,
                rb"[!-/:-@\[-`{-~]+(?=[ \n]|\Z)(?!" + before_space + rb")",
                rb"[ \n]*[^ \n]+(?:(?=" + before_space + rb")[ \n]+[^ \n]+)*",
                rb"[ \n]+\Z",
            ]
        )
    )


class Codec:
    """Exact ids of texts; it remembers pieces and fragments."""

    def __init__(self, model: bytes, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = plain_byte_bpe(model)
        library = Tokenizer.from_str(model.decode("utf-8"))
        self._split, self._merge = library.pre_tokenizer, library.model
        self.bytes_of = token_bytes(spec)
        inside = pairs_inside(self.bytes_of)
        letter = {b: c for c, b in byte_alphabet().items()}
        self._joined = {letter[a] + letter[b] for a, b in np.argwhere(inside)}
        self._cut = certain_cuts(inside)
        self._letter_of = {b: c for c, b in byte_alphabet().items()}
        added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]} if specials else {}
        self._added = {k: np.uint32(i).tobytes() for k, i in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self._special = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        self._pieces: dict[bytes, bytes] = {}
        self._fragments: dict[str, bytes] = {}

    def fragments(self, part: str) -> list[str]:
        """``part``, in the byte alphabet, cut where no token reaches across."""
        at = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self._joined]
        return [part[a:b] for a, b in zip([0, *at], [*at, len(part)], strict=True)] if at else [part]

    def _fragment(self, fragment: str) -> bytes:
        known = self._fragments.get(fragment)
        if known is None:
            ids = [t.id for t in self._merge.tokenize(fragment)]
            known = np.array(ids, "<u4").tobytes()
            if len(fragment) <= LONGEST:
                self._fragments[fragment] = known
        return known

    def _piece(self, piece: bytes) -> bytes:
        if _WORD.fullmatch(piece):  # one part by any splitting rule
            parts = [piece.decode("latin-1").translate(self._letter_of)]
        else:
            parts = [part for part, _ in self._split.pre_tokenize_str(piece.decode("utf-8"))]
        return b"".join(self._fragment(f) for part in parts for f in self.fragments(part))

    def _plain(self, text: bytes) -> bytes:
        if OTHER_SPACE.search(text):
            return self._piece(text)
        pieces, memo = self._cut.findall(text), self._pieces
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            new = [piece for piece in set(pieces) if piece not in memo]
            memo.update({piece: self._piece(piece) for piece in new})
            out = b"".join(map(memo.__getitem__, pieces))
            for piece in new:
                if len(piece) > LONGEST:
                    del memo[piece]
            return out

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8, little-endian unsigned 32-bit each."""
        if len(self._pieces) > MEMO:
            self._pieces = {}
        if len(self._fragments) > MEMO // 2:
            self._fragments = {}
        if self._special is None or not self._special.search(text):
            return self._plain(text) if text else b""
        out, done = [], 0
        for found in self._special.finditer(text):
            out += [self._plain(text[done : found.start()]) if found.start() > done else b"", self._added[found[0]]]
            done = found.end()
        out.append(self._plain(text[done:]) if done < len(text) else b"")
        return b"".join(out)


class Decoder:
    """Texts of ids; those outside the vocabulary stand for nothing."""

    def __init__(self, model: bytes):
        self.bytes_of = token_bytes(plain_byte_bpe(model))

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(self.bytes_of):
            numbers = numbers[numbers < len(self.bytes_of)]
        whole = b"".join(map(self.bytes_of.__getitem__, numbers.tolist()))
        return whole.decode("utf-8", "replace")


def utf8_texts(column: pa.Array) -> list[bytes]:
    """The bytes of each text, empty for null, with U+FFFD for what is not UTF-8."""
    return [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in raw_texts(column)]


@lru_cache(maxsize=4)
def shared_codec(model: bytes, specials: bool = True) -> Codec:
    """One codec per worker process, so that later tasks find what it remembers."""
    return Codec(model, specials)


@lru_cache(maxsize=4)
def _shared_decoder(model: bytes) -> Decoder:
    return Decoder(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read()
    plain_byte_bpe(model)
    return model


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    specials: bool = True,
) -> DataFrame:
    """``_id, n_tokens, ids`` of each row; ``ids`` are little-endian 32-bit numbers."""
    model = read_model(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model, specials)
        for batch in slices(batches, "_text"):
            ids = [codec.encode(t) for t in utf8_texts(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["_id", "n_tokens", "ids"],
            )

    schema = T.StructType(
        [
            T.StructField("_id", rows.schema["_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of ``encode_documents`` with their ``decoded`` text."""
    model = read_model(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _shared_decoder(model)
        for batch in slices(batches, "ids"):
            texts = [decoder.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
            )

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
