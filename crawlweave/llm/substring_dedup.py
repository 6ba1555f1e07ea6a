"""Substring dedup by hashed sentences and by fingerprints that need no stops.

A text is tiled into units: lines, cut again after ``.``, ``!`` or ``?`` with
white space behind. Units are normalised (A-Z as a-z, white space runs as one
space) and hashed to 128 bits. Besides, of every ``WINDOW`` runs of ``SHINGLE``
words that follow each other, the one of least hash is a fingerprint. The choice
looks at nothing else, so two texts that share ``SHINGLE + WINDOW - 1`` = 30 words
share a fingerprint there, wherever their sentences begin, and also without stops.

All occurrences of a hash are ranked by document, then place; the earliest stays
and the others are repeats. A fingerprint is extended word by word to both sides
as far as its earliest occurrence goes on alike; ``WINDOW - 1`` words will do, as
behind them the shared run has its next fingerprint. Repeats that touch are one
passage, and a passage of ``min_words`` words or more is removed, without up to
``EDGE`` words next to a sentence end, where the rest is long enough. Offsets are
code points of the original text.

Occurrences are range-partitioned by hash and rank, so a passage that a third
of all documents hold is spread over as many partitions as it fills. A sorted
partition needs no memory: every row but the first of its hash is a repeat, and
carries the words around it (16 bits of hash each, so about one end in 65,000 is
a word too far). Only the hashes at a partition's two ends depend on the neighbours:
their earliest occurrences, at most two per partition, are found by one aggregate
and sent to all tasks.

Defined cases: a text that is null, empty or white space has no units; rows that
agree in id and text are one document; a null id ranks first; repeats inside one
document count; runs of one to seven words over and over are no fingerprints; with
``min_words`` under 30, shorter passages are found as whole units; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.hashing import shingle_hashes, word_hashes
from crawlweave.llm.rows import join_keyed, keyed, packed, rows_back, slices, with_rest
from crawlweave.workspace import Workspace

MIN_WORDS = 30
SHINGLE = 15
WINDOW = 16
EDGE = 3
SAMPLE = 16  # one document in so many is hashed to find the partitions' bounds
_SIDE = WINDOW - 1

_UNIT = re.compile(r"[^.!?\n]*(?:[.!?](?!\s)[^.!?\n]*)*(?:[.!?]\s+|\n\s*|[.!?]?\Z)")
_OTHER_SPACE = re.compile(r"[^\S \t\n\r\f\v]")
_WORD = re.compile(r"\S+")
_NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)
_ASCII_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def units(text: str) -> Iterator[tuple[int, int, bytes, int]]:
    """``start, end, digest, words`` of the units with a word; they tile the text."""
    for m in _UNIT.finditer(text):
        if m.start() == m.end():
            continue
        words = m[0].translate(_ASCII_UPPER).split()
        if words:
            key = " ".join(words).encode("utf-8", "surrogatepass")
            yield m.start(), m.end(), hashlib.blake2b(key, digest_size=16).digest(), len(words)


def _spaced(text: str) -> str:
    """``text`` with a space for any white space that is not among the six of ``word_hashes``."""
    plain = text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return text if plain else _OTHER_SPACE.sub(" ", text)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, hash, first word, words around`` of the fingerprints of many texts.

    The words around are ``_SIDE`` to the left, the nearest first, and as many to
    the right: a number from 1 to 65535 each, 0 beyond the text.
    """
    words, first = word_hashes(*packed(texts))
    count = len(words)
    span = SHINGLE + WINDOW - 1
    if count < span:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2 * _SIDE), np.uint16))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = shingle_hashes(words, SHINGLE)
    for period in range(1, SHINGLE // 2 + 1):
        same = np.r_[0, np.cumsum(words[period:] == words[:-period])]
        hashes[same[SHINGLE - period :] - same[: len(same) - SHINGLE + period] == SHINGLE - period] = _NO_HASH
    least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).argmin(axis=1) + np.arange(count - span + 1)
    at = np.zeros(len(hashes), bool)
    at[least[row[: count - span + 1] == row[span - 1 :]]] = True
    at = np.flatnonzero(at & (hashes != _NO_HASH))
    away = np.arange(_SIDE)
    around = np.concatenate([at[:, None] - 1 - away, at[:, None] + SHINGLE + away], axis=1)
    own = row[at][:, None]
    inside = (around >= first[own]) & (around < first[own + 1])
    short = ((words >> np.uint64(32)) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    sides = np.where(inside, short[np.clip(around, 0, count - 1)], np.uint16(0))
    return row[at], hashes[at], at - first[row[at]], sides


def _hash_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text", 4 << 20):
        rows, digests, starts, words = [], [], [], []
        texts = [text or "" for text in batch.column("_text").to_pylist()]
        for row, text in enumerate(texts):
            before = 0
            for _, _, digest, n in units(text):
                rows.append(row)
                digests.append(digest)
                starts.append(before)
                words.append(n)
                before += n
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        spaced = pa.array([_spaced(t) for t in texts], pa.large_string())
        row, h, first, sides = fingerprints(spaced)
        ends = np.r_[np.zeros(len(rows), np.int32), np.arange(1, len(row) + 1, dtype=np.int32) * sides.itemsize * 2 * _SIDE]
        offsets = np.r_[np.int32(0), ends].astype(np.int32)
        valid = np.packbits(np.r_[np.zeros(len(rows), bool), np.ones(len(row), bool)], bitorder="little")
        at = pa.array(np.r_[np.array(rows, np.int64), row])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[halves[:, 0], h.view(np.int64)]),
                pa.array(np.r_[halves[:, 1], np.zeros(len(row), np.int64)]),
                batch.column("_id").take(at),
                batch.column("_key").take(at),
                pa.array(np.r_[np.array(starts, np.int32), first.astype(np.int32)]),
                pa.array(np.r_[np.array(words, np.int32), np.full(len(row), SHINGLE, np.int32)]),
                pa.Array.from_buffers(
                    pa.binary(), len(ends), [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(sides.tobytes())]
                ),
            ],
            _NAMES,
        )


_NAMES = ["h1", "h2", "_id", "_key", "start", "words", "around"]


def _extended(batch: pa.RecordBatch, at: np.ndarray, first: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``start, words`` of all rows, those at ``at`` as far as the words around agree with ``first``."""
    start, words = batch.column("start").to_numpy().copy(), batch.column("words").to_numpy().copy()
    if len(at):
        own = b"".join(batch.column("around").take(pa.array(at)).to_pylist())
        own = np.frombuffer(own, np.uint16).reshape(-1, 2, _SIDE)
        other = np.frombuffer(b"".join(first), np.uint16).reshape(-1, 2, _SIDE)
        alike = np.cumprod((own == other) & (own != 0), axis=2, dtype=np.int32).sum(axis=2, dtype=np.int32)
        start[at] -= alike[:, 0]
        words[at] += alike.sum(axis=1, dtype=np.int32)
    return start, words


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition that are not the first occurrence of their digest.

    Fingerprints of ``role`` 0 are extended, and no longer need the words around.

    ``role`` 0: a repeat, with the document of its first occurrence; 1: a repeat
    of the partition's first digest; 2: the partition's first row; 3: where the
    partition's last digest first occurs.
    """
    key, head, first_key = None, None, None

    def emit(batch, role, first_id):
        columns = [*[batch.column(c) for c in _NAMES], role, first_id]
        return pa.RecordBatch.from_arrays(columns, [*_NAMES, "role", "first_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (h1[0], h2[0])
        heads = pa.Table.from_batches(
            [head if head is not None else batch.slice(0, 1), batch.take(pa.array(np.flatnonzero(new)))]
        ).combine_chunks()
        own = heads.take(pa.array(np.cumsum(new))).combine_chunks().to_batches()[0]
        repeat = np.zeros(len(h1), bool)
        for column in ("_key", "start"):
            repeat |= batch.column(column).to_numpy() != own.column(column).to_numpy()
        role = np.zeros(len(h1), np.int32)
        if first_key is None:
            first_key = (h1[0], h2[0])
            role[0] = 2
        role[(h1 == first_key[0]) & (h2 == first_key[1]) & (role == 0)] = 1
        keep = pa.array(repeat | (role == 2))
        out = emit(batch, pa.array(role), own.column("_id")).filter(keep)
        if out.num_rows:
            around = out.column("around")
            done = out.column("role").to_numpy() == 0
            at = np.flatnonzero(done & around.is_valid().to_numpy(zero_copy_only=False))
            firsts = own.column("around").filter(keep).take(pa.array(at)).to_pylist()
            start, words = _extended(out, at, firsts)
            around = pc.if_else(pa.array(done), pa.scalar(None, around.type), around)
            columns = [*out.columns[:4], pa.array(start), pa.array(words), around, *out.columns[7:]]
            yield pa.RecordBatch.from_arrays(columns, out.schema.names)
        key, head = (h1[-1], h2[-1]), own.slice(len(h1) - 1, 1)
    if head is not None:
        yield emit(head, pa.array([3], pa.int32()), head.column("_id"))


def _settle(known: dict[tuple[int, int], tuple]):
    """Repeats only, each with the document of the earliest occurrence.

    ``known`` has the earliest occurrence of the digests at partitions' ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role = batch.column("role").to_numpy()
            keep = role < 3
            first = batch.column("first_id")
            start, words = batch.column("start"), batch.column("words")
            unsure = np.flatnonzero((role == 1) | (role == 2))
            if len(unsure):
                ids = first.to_pylist()
                around = batch.column("around").is_valid().to_numpy(zero_copy_only=False)
                at_first = []
                asked = batch.take(pa.array(unsure)).select(["h1", "h2", "_id", "_key", "start"])
                for row, (h1, h2, *rank) in zip(
                    unsure, zip(*(c.to_pylist() for c in asked.columns), strict=True), strict=True
                ):
                    at = known[h1, h2]
                    ids[row] = at[0]
                    keep[row] = tuple(rank) != at[:3]
                    if around[row]:
                        at_first.append(at[3])
                first = pa.array(ids, first.type)
                start, words = map(pa.array, _extended(batch, unsure[around[unsure]], at_first))
            columns = [*batch.columns[:4], start, words, *batch.columns[6:-1], first]
            out = pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))
            if out.num_rows:
                yield out

    return run


def _runs(repeats: list[dict]) -> Iterator[list[tuple]]:
    """Repeats that overlap or touch, as ``begin, end, first_id`` in words."""
    spans = [(r["start"], r["start"] + r["words"], r["first_id"]) for r in repeats]
    run, last = [], -1
    for span in sorted(spans, key=lambda s: (s[0], -s[1], s[2] is not None, s[2] or 0)):
        if run and span[0] > last:
            yield run
            run = []
        last = max(last, span[1]) if run else span[1]
        run.append(span)
    if run:
        yield run


def _passages(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, words, firsts = [], [], [], [], []
            texts = batch.column("_text")
            for row, repeats in enumerate(batch.column("repeats").to_pylist()):
                long = [r for r in _runs(repeats) if max(s[1] for s in r) - r[0][0] >= min_words]
                if not long:
                    continue
                text = texts[row].as_py()
                begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                stops = [0, *accumulate(len(m[0].split()) for m in _UNIT.finditer(text))]
                for spans in long:
                    begin, end = spans[0][0], max(s[1] for s in spans)
                    inner = stops[bisect_left(stops, begin)]
                    if inner - begin <= EDGE and end - inner >= min_words:
                        begin = inner
                    inner = stops[bisect_right(stops, end) - 1]
                    if end - inner <= EDGE and inner - begin >= min_words:
                        end = inner
                    rows.append(row)
                    starts.append(begins[begin])
                    ends.append(begins[end])
                    words.append(end - begin)
                    firsts.append(next(s[2] for s in spans if s[1] > begin))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(at),
                    batch.column("_key").take(at),
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                    pa.array(words, pa.int32()),
                    pa.array(firsts, batch.column("_id").type),
                ],
                ["_id", "_key", "start", "end", "n_words", "first_id"],
            )

    return run


def _rank(h1, h2, id_, key, start) -> tuple:
    return h1, h2, id_ is not None, id_ if id_ is not None else 0, key, start


def _range_bounds(rows: DataFrame, schema: T.StructType, order: list[str], width: int) -> list[tuple]:
    """Where partitions begin, one entry each, from every ``SAMPLE``-th document's hashes.

    Only the balance of partitions depends on it: hashing a sample costs a part of
    what hashing all rows a second time would.
    """
    sample = rows.where(F.pmod(F.xxhash64("_key"), F.lit(SAMPLE)) == 0)
    begins = (
        sample.mapInArrow(_hash_units, schema)
        .select(*order)
        .repartitionByRange(width, *order)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(F.struct(*order)).alias("at"))
        .collect()
    )
    return sorted(_rank(*r["at"]) for r in begins)[1:]


def _placed(bounds: list[tuple]):
    """Hashed units with the partition they belong to."""
    heads = np.array([b[0] for b in bounds], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _hash_units(batches):
            h1 = batch.column("h1").to_numpy()
            part = np.searchsorted(heads, h1, "left").astype(np.int32)
            ties = np.flatnonzero(np.searchsorted(heads, h1, "right") > part)
            if len(ties):  # units whose first 64 bits are a bound's
                asked = batch.take(pa.array(ties)).select(["h1", "h2", "_id", "_key", "start"])
                ranks = zip(*(c.to_pylist() for c in asked.columns), strict=True)
                part[ties] = [bisect_right(bounds, _rank(*r)) for r in ranks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return run


def repeated_passages(
    docs: DataFrame,
    ws: Workspace,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_id, _key, start, end, n_words, first_id`` of each passage to remove.

    ``first_id`` is the document that keeps the passage's first words.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType

    def fields(*named):
        return [T.StructField(name, k) for name, k in named]

    place = fields(("_id", kind), ("_key", T.LongType()))
    span = fields(("start", T.IntegerType()), ("end", T.IntegerType()))
    unit = fields(("h1", T.LongType()), ("h2", T.LongType())) + place
    unit += fields(("start", T.IntegerType()), ("words", T.IntegerType()), ("around", T.BinaryType()))
    order = ["h1", "h2", "_id", "_key", "start"]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _range_bounds(rows, T.StructType(unit), order, width)
    found = ws.save(
        rows.mapInArrow(_placed(bounds), T.StructType([*unit, T.StructField("part", T.IntegerType())]))
        .repartitionById(width, "part")
        .drop("part")
        .sortWithinPartitions(*order)
        .mapInArrow(_repeats, T.StructType(unit + fields(("role", T.IntegerType()), ("first_id", kind)))),
        "repeats",
    )
    earliest = F.min(F.struct("_id", "_key", "start", "around")).alias("at")
    cut = found.where("role >= 2").groupBy("h1", "h2").agg(earliest)
    known = {(r.h1, r.h2): tuple(r.at) for r in cut.collect()}  # two a partition at most
    repeats = (
        found.mapInArrow(_settle(known), found.schema)
        .groupBy("_id", "_key")
        .agg(F.collect_set(F.struct("start", "words", "first_id")).alias("repeats"))
    )
    schema = T.StructType(place + span + fields(("n_words", T.IntegerType()), ("first_id", kind)))
    # Only the texts tell where a word begins. Equal rows have the same passages.
    joined = join_keyed(rows, repeats.hint("shuffle_hash"), "inner")
    return joined.mapInArrow(_passages(min_words), schema).distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(
            batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True
        ):
            for span in sorted(spans or (), key=lambda s: -s["start"]):
                text = text[: span["start"]] + text[span["end"] :]
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(kept, pa.string())], [*batch.schema.names, "_kept"]
        )


def drop_passages(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """``docs`` without repeated passages; ``n_chars`` follows the text."""
    spans = (
        repeated_passages(docs, ws, **options)
        .groupBy("_id", "_key")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    joined = join_keyed(with_rest(docs), spans)
    schema = T.StructType([*joined.schema.fields, T.StructField("_kept", T.StringType())])
    return rows_back(joined.mapInArrow(_cut, schema), docs, F.col("_kept"))
