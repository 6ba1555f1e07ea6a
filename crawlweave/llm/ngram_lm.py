"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of a bigram, a unigram and the
uniform distribution. The mixture weights depend on how often the context was
seen, in buckets of doubling frequency, and are learned by
expectation-maximisation on held-out counts: every tenth training document, with
its own counts deleted.

Counts are exact and cover all training documents. What moves is packed:

1. Documents are written once in blocks of about ``BLOCK`` bytes of text, as the
   tasks that read them find them; a block keeps its number from then on.
2. A block sends its distinct n-gram hashes, sorted and cut by hash range, with
   their training counts. A hash range adds up what all blocks sent, however
   common an n-gram is, and answers each block with the totals, in the order in
   which that block asked.
3. A block and its answers meet in one task, which has all it needs to score its
   documents.

Tokens are words between ASCII white space, A-Z as a-z, told apart by 64-bit
hashes, and an end; the first word's context is the start, seen once per
training document.

Defined cases: a null text has the end token only; rows keep their number,
repeated ones included (each counts); with nothing to learn from, known counts
are 0 and every token has the same chance; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.llm.hashing import mix, word_hashes
from crawlweave.llm.rows import packed, slices
from crawlweave.workspace import Workspace

BLOCK = 6 << 20
BUCKETS = 24
GRID = 64
ROUNDS = 60

_END = np.uint64(0x51ED270B7A2C9F13)
_START = np.uint64(0x2F0B4C47D1A5E669)
_UNIGRAM = np.uint64(0x7C15D0E2B85A36F1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its number, whether it is for the weights, its rows as Arrow."""
    number = TaskContext.get().partitionId() << 24
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def close(tune: bool) -> pa.RecordBatch:
        nonlocal number
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held[tune]).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=options) as out:
            out.write_table(table)
        held[tune], size[tune] = [], 0
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([tune]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "tune", "data"],
        )

    for batch in slices(batches, "_text", BLOCK // 4):
        for tune in (False, True):
            mask = batch.column("_tune")
            part = batch.filter(mask if tune else pa.array(~mask.to_numpy(zero_copy_only=False)))
            if part.num_rows:
                held[tune].append(part.select(["_id", "_text", "_train"]))
                size[tune] += int(packed(part.column("_text"))[1][-1])
                if size[tune] >= BLOCK:
                    yield close(tune)
    for tune in (False, True):
        if held[tune]:
            yield close(tune)


class Block:
    """The tokens of a block's documents, end tokens included."""

    def __init__(self, data: bytes):
        self.rows = pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()
        text = self.rows.column("_text").combine_chunks()
        words, first = word_hashes(*packed(text))
        n = len(first) - 1
        self.last = first[1:] + np.arange(n)  # where each document's end token is
        self.first = first[:-1] + np.arange(n)
        token = np.empty(len(words) + n, np.uint64)
        is_word = np.ones(len(token), bool)
        is_word[self.last] = False
        token[is_word], token[~is_word] = words, _END
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.first] = _START
        self.unigram = mix(token ^ _UNIGRAM)
        self.bigram = mix(context * _PAIR + token)
        train = self.rows.column("_train").to_numpy()
        self.train = np.repeat(train, self.last - self.first + 1)

    def distinct(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct grams and their training counts."""
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        return ordered[new], np.add.reduceat(self.train[order].astype(np.int64), new)


def pack_numbers(values: np.ndarray) -> bytes:
    """Byte by byte across all numbers, so that empty high bytes cost nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    limits = [(i << 64) // ranges for i in range(1, ranges)]
    inner = np.searchsorted(keys, np.array(limits, np.uint64))
    return np.r_[0, inner, len(keys)]


def _ask(ranges: int):
    """``range, block`` with packed grams and counts, for both orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                block = Block(data.as_py())
                for order, grams in ((1, block.unigram), (2, block.bigram)):
                    keys, counts = block.distinct(grams)
                    cuts = _cuts(keys, ranges)
                    out = []
                    for r in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[r], cuts[r + 1])
                        steps = np.diff(keys[part], prepend=np.uint64(0))
                        out.append((int(r), number, order, pack_numbers(steps), pack_numbers(counts[part].astype(np.uint32))))
                    columns = zip(*out, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["range", "block", "order", "keys", "counts"],
                    )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one hash range, for each block that asked; block -1: tokens and types."""
    out = []
    for order in (1, 2):
        part = table.filter(pa.array(table.column("order").to_numpy() == order))
        if not part.num_rows:
            continue
        keys = [np.cumsum(unpack_numbers(k, np.uint64)) for k in part.column("keys").to_pylist()]
        counts = [unpack_numbers(c, np.uint32) for c in part.column("counts").to_pylist()]
        whole = np.concatenate(keys)
        distinct, place = np.unique(whole, return_inverse=True)
        totals = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
        at = 0
        for number, asked in zip(part.column("block").to_pylist(), keys, strict=True):
            answer = totals[place[at : at + len(asked)]]
            at += len(asked)
            out.append((number, order, part.column("range")[0].as_py(), pack_numbers(answer), 0, 0))
        if order == 1:
            out.append((-1, 1, 0, b"", int(totals.sum()), int((totals > 0).sum())))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["block", "order", "range", "totals", "tokens", "types"],
    )


def _counts(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of each token, of its bigram and of its context."""
    found = []
    for order, grams in ((1, block.unigram), (2, block.bigram)):
        part = answers.filter(pa.array(answers.column("order").to_numpy() == order)).sort_by("range")
        totals = np.concatenate([unpack_numbers(t, np.int64) for t in part.column("totals").to_pylist()])
        found.append(totals[np.unique(grams, return_inverse=True)[1]])
    unigram, bigram = found
    context = np.empty_like(unigram)
    context[1:] = unigram[:-1]
    context[block.first] = unigram[block.last]  # starts are seen as often as ends
    return unigram, bigram, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else by doubling frequency."""
    return np.minimum(np.frexp(np.maximum(context, 0))[1], BUCKETS - 1)


def _share(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.asarray(b) > 0, a / b, 0.0)


def _log_cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cell = np.floor(-np.log10(p) * 6) + 1
    return np.where(p > 0, np.clip(cell, 1, GRID - 1), 0).astype(np.int64)


def _held_out_cells(tokens: int):
    """Held-out tokens summed in cells of like bigram and unigram estimates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = BUCKETS * GRID * GRID
        sums = np.zeros((3, size))
        for data in left.column("data").to_pylist():
            block = Block(data)
            unigram, bigram, context = _counts(block, right)
            for lo, hi in zip(block.first, block.last + 1, strict=True):
                s = slice(lo, hi)
                own = []
                for grams in (block.unigram[s], block.bigram[s]):
                    _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
                    own.append(count[place])
                one, two = unigram[s] - own[0], bigram[s] - own[1]
                before = context[s].copy()
                before[1:] -= own[0][:-1]
                before[0] -= 1
                p2, p1 = _share(two, before), _share(one, tokens - (hi - lo))
                cell = (bucket(before) * GRID + _log_cell(p2)) * GRID + _log_cell(p1)
                for row, weight in enumerate((None, p2, p1)):
                    sums[row] += np.bincount(cell, weight, size)
        at = np.flatnonzero(sums[0])
        return pa.Table.from_arrays([pa.array(at), *[pa.array(row[at]) for row in sums]], ["cell", "n", "p2", "p1"])

    return run


def learn_weights(cells: list[tuple[int, float, float, float]], types: int) -> np.ndarray:
    """Mixture weights by bucket (bigram, unigram, uniform), by expectation-maximisation."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if cells:
        cell, n, p2, p1 = (np.array(c, float) for c in zip(*cells, strict=True))
        which = (cell // (GRID * GRID)).astype(int)
        p = np.stack([p2 / n, p1 / n, np.full(len(n), 1 / (types + 1))], axis=1)
        for _ in range(ROUNDS):
            share = weights[which] * p
            share *= (n / share.sum(axis=1))[:, None]
            for k in range(3):
                total = np.bincount(which, share[:, k], BUCKETS)
                weights[:, k] = np.where(np.bincount(which, n, BUCKETS) > 0, total, weights[:, k])
            weights /= weights.sum(axis=1, keepdims=True)
    # No bucket may rule out a token that is new to it.
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def _score(weights: np.ndarray, tokens: int, types: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for data in left.column("data").to_pylist():
            block = Block(data)
            unigram, bigram, context = _counts(block, right)
            w = weights[bucket(context)]
            p = w[:, 0] * _share(bigram, context) + w[:, 1] * _share(unigram, float(tokens)) + w[:, 2] / (types + 1)
            base = (unigram + 0.5) / (tokens + 0.5 * (types + 1))
            parts.append(
                pa.Table.from_arrays(
                    [
                        block.rows.column("_id"),
                        block.rows.column("_train"),
                        pa.array(block.last - block.first + 1),
                        pa.array(np.add.reduceat((unigram > 0).astype(np.int64), block.first)),
                        pa.array(np.add.reduceat(np.log10(base), block.first)),
                        pa.array(np.add.reduceat(np.log10(p), block.first)),
                    ],
                    ["_id", "train", "n_tokens", "n_known", "base_score", "score"],
                )
            )
        return pa.concat_tables(parts)

    return run


def score_documents(
    docs: DataFrame,
    train: Column,
    ws: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_id, train, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``train`` says which rows are learned from. Both scores are log10 of the
    chance of the whole text; the base has half a count added to each unigram.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    learn = F.coalesce(train, F.lit(False))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        learn.alias("_train"),
        (learn & (F.pmod(F.xxhash64(F.col(id_col), F.lit("tune")), F.lit(10)) == 0)).alias("_tune"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    blocks = ws.save(rows.mapInArrow(_blocks, "block bigint, tune boolean, data binary"), "blocks")
    ranges = max(width, blocks.count())
    asked = blocks.select("block", "data").mapInArrow(
        _ask(ranges), "range bigint, block bigint, order int, keys binary, counts binary"
    )
    answers = ws.save(
        asked.groupBy("range").applyInArrow(
            _answer,
            "block bigint, order int, range bigint, totals binary, tokens bigint, types bigint",
        ),
        "answers",
    )
    totals = answers.where("block = -1").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(totals[0] or 0), int(totals[1] or 0)

    told = answers.where("block >= 0").select("block", "order", "range", "totals")
    tuned = blocks.where("tune").select("block", "data")
    numbers = tuned.select(F.col("block").alias("t"))
    told_tuned = told.join(numbers, F.col("block") == F.col("t"), "left_semi")
    cells = (
        tuned.groupBy("block")
        .cogroup(told_tuned.groupBy("block"))
        .applyInArrow(_held_out_cells(tokens), "cell bigint, n double, p2 double, p1 double")
        .groupBy("cell")
        .agg(F.sum("n"), F.sum("p2"), F.sum("p1"))
        .collect()
    )
    weights = learn_weights(sorted(tuple(c) for c in cells), types)
    scored = (
        blocks.select("block", "data")
        .groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInArrow(
            _score(weights, tokens, types),
            f"_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double",
        )
    )
    return scored.select(
        "_id",
        "train",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
