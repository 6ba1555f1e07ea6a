"""Alignment of two tokenizers' tokens by the bytes they cover, as an Arrow pipeline.

Both tokenizers cut a space and the text behind it into tokens. Where tokens of both
end at the same byte, the text falls into groups; within a group every token of one
is linked with every token of the other. Per slice of documents the token lists are
flattened with their parents' indices, ends are cumulative sums that begin anew in
each document, and a hash join on document and end finds the common ends. Tokens
are counted by group and id with ``Table.group_by`` and joined by group, so what is
made are distinct pairs of ids with their number, never the links one by one; a
group of very many tokens is joined in parts of ``LINKS`` rows.

Documents are put into blocks of about ``BLOCK`` bytes of text. A block sends one row
per pair of ids with the number of its documents that hold it; Spark adds them up,
which gives each pair its count and each id its highest. The answers go back to the
block that asked, as many rows as it sent, and are added up per document there.

The exchange grows with the blocks' distinct pairs, each sent once, so a text that a
third of all rows hold weighs no more than the others. The only broadcast is the
highest count of each id, a row per entry of a vocabulary.

Defined cases: a null or empty text has no tokens, nor has one whose tokens do not
spell a space and the text again (as the second tokenizer takes U+2581 for a space);
their numbers are 0 and their groups ''. Special strings in texts are plain text.
Every row counts as a document, repeated ones included; an empty table gives an empty
table; other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm import bpe_codec
from crawlweave.llm.ngram_lm import pack_numbers, unpack_numbers
from crawlweave.llm.rows import slices
from crawlweave.workspace import Workspace

SLICE = 2 << 20  # bytes of text aligned at once
BLOCK = 16 << 20  # bytes of text that ask for counts together
LINKS = 4_000_000  # rows of one join by group
MEMO = 500_000


class Pair:
    """Ids of the same text by both tokenizers; pieces are remembered."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        import sentencepiece

        self.a = bpe_codec.Codec(byte_model, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.a_bytes = self.a.bytes_of
        self.b_bytes = [self._bytes(i) for i in range(self.b.vocab_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        own = bpe_codec.pairs_inside(self.b_bytes)
        if own[0x0A].any():
            raise ValueError("a piece goes on behind a line feed")
        self.cut = bpe_codec.certain_cuts(bpe_codec.pairs_inside(self.a_bytes) | own)
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}

    def _bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def _ids(self, piece: bytes) -> tuple[bytes, bytes]:
        """``piece`` may begin with the space that the second tokenizer adds by itself."""
        text = piece.decode("utf-8")
        if text[0] == " ":
            b = self.b.encode(text[1:], num_threads=1) if len(text) > 1 else self.b.encode("\n ", num_threads=1)[2:]
        else:  # no piece reaches across a line feed
            b = self.b.encode("\n" + text, num_threads=1)[2:]
        if b"".join([self.b_bytes[i] for i in b]) != piece:
            b = None
        return self.a._piece(piece), None if b is None else np.array(b, "<u4").tobytes()

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids by both of a space and ``text``; nothing if a side does not spell it again."""
        if not text:
            return b"", b""
        text = b" " + text
        if bpe_codec.OTHER_SPACE.search(text):
            found = [self._ids(text)]
        else:
            pieces, memo = self.cut.findall(text), self.memo
            try:
                found = list(map(memo.__getitem__, pieces))
            except KeyError:
                if len(memo) > MEMO:
                    memo.clear()
                new = [piece for piece in set(pieces) if piece not in memo]
                memo.update({piece: self._ids(piece) for piece in new})
                found = list(map(memo.__getitem__, pieces))
                for piece in new:
                    if len(piece) > bpe_codec.LONGEST:
                        del memo[piece]
        a, b = zip(*found, strict=True)
        return (b"".join(a), b"".join(b)) if None not in b else (b"", b"")


@lru_cache(maxsize=2)
def _shared(byte_model: bytes, piece_model: bytes) -> Pair:
    return Pair(byte_model, piece_model)


def _flat(ids: list[bytes], length: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """``doc, end, id`` of all tokens in order, and where each document's begin."""
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
    tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(tokens))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    sums = pc.cumulative_sum(pa.array(length[tokens])).to_numpy()
    before = np.concatenate([[0], sums])[at[:-1]]
    ends = sums - before[doc.to_numpy()] if len(tokens) else sums
    return pa.table({"doc": doc, "end": ends, "id": flat, "at": np.arange(len(tokens))}), at


def _counted(group: np.ndarray, ids: pa.Array, name: str) -> pa.Table:
    """``g, name, n``: how often each id occurs in each group."""
    counts = pa.table({"g": group, name: ids}).group_by(["g", name], use_threads=False).aggregate([([], "count_all")])
    return counts.rename_columns({"count_all": f"n_{name}"})


def _pairs(a: pa.Table, b: pa.Table, sizes: np.ndarray) -> Iterator[pa.Table]:
    """``g, a, b, n`` for groups; ``sizes`` is the number of ids of ``b`` by group."""
    a = a.sort_by("g")
    fan = np.cumsum(sizes[a.column("g").to_numpy()])
    lo = 0
    while lo < a.num_rows:
        hi = max(int(np.searchsorted(fan, (fan[lo - 1] if lo else 0) + LINKS, "right")), lo + 1)
        part = a.slice(lo, hi - lo).join(b, "g", join_type="inner", use_threads=False)
        yield part.append_column("n", pc.multiply(part.column("n_a"), part.column("n_b"))).select(["g", "a", "b", "n"])
        lo = hi


def _written(tokens: pa.Table, starts: np.ndarray) -> pa.Array:
    """Ids of each group in decimal, with commas."""
    texts = tokens.column("id").combine_chunks().cast(pa.large_string())
    lists = pa.LargeListArray.from_arrays(pa.array(starts), texts)
    return pc.binary_join(lists, pa.scalar(",", pa.large_string()))


def align(a_ids: list[bytes], b_ids: list[bytes], pair: Pair) -> tuple[dict, pa.Table]:
    """Numbers and group texts of documents, and ``doc, a, b, n`` of their linked ids."""
    n_docs = len(a_ids)
    a, a_at = _flat(a_ids, pair.a_length)
    b, b_at = _flat(b_ids, pair.b_length)
    common = a.select(["doc", "end", "at"]).join(
        b.select(["doc", "end", "at"]).rename_columns(["doc", "end", "b_at"]),
        ["doc", "end"],
        join_type="inner",
        use_threads=False,
    )
    closes = np.zeros(a.num_rows + 1, np.int64), np.zeros(b.num_rows + 1, np.int64)
    closes[0][common.column("at").to_numpy() + 1] = 1
    closes[1][common.column("b_at").to_numpy() + 1] = 1
    a_group, b_group = (np.cumsum(c)[:-1] for c in closes)
    n_groups = common.num_rows
    a_size, b_size = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    a_starts, b_starts = (np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in (a_size, b_size))
    group_doc = a.column("doc").to_numpy()[a_starts[:-1]]
    groups = np.bincount(group_doc, minlength=n_docs)
    links = np.bincount(group_doc, a_size * b_size, minlength=n_docs).astype(np.int64) if n_groups else groups
    both = pc.binary_join_element_wise(_written(a, a_starts), _written(b, b_starts), pa.scalar("|", pa.large_string()))
    doc_starts = np.concatenate([[0], np.cumsum(groups)]).astype(np.int64)
    whole = pc.binary_join(
        pa.LargeListArray.from_arrays(pa.array(doc_starts), both), pa.scalar(";", pa.large_string())
    )
    numbers = {"n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": groups, "n_links": links, "groups": whole}

    single = (a_size == 1) & (b_size == 1)
    alone_a, alone_b = a_starts[:-1][single], b_starts[:-1][single]
    ids_a, ids_b = a.column("id").combine_chunks(), b.column("id").combine_chunks()
    cells = [
        pa.table(
            {
                "doc": group_doc[single].astype(np.int64),
                "a": ids_a.take(pa.array(alone_a)),
                "b": ids_b.take(pa.array(alone_b)),
                "n": np.ones(len(alone_a), np.int64),
            }
        )
    ]
    in_a, in_b = np.flatnonzero(~single[a_group]), np.flatnonzero(~single[b_group])
    count_a = _counted(a_group[in_a], ids_a.take(pa.array(in_a)), "a")
    count_b = _counted(b_group[in_b], ids_b.take(pa.array(in_b)), "b")
    sizes = np.bincount(count_b.column("g").to_numpy(), minlength=n_groups)
    for part in _pairs(count_a, count_b, sizes):
        doc = pa.array(group_doc[part.column("g").to_numpy()].astype(np.int64))
        cells.append(pa.table({"doc": doc, "a": part.column("a"), "b": part.column("b"), "n": part.column("n")}))
    per_doc = pa.concat_tables(cells).group_by(["doc", "a", "b"], use_threads=False).aggregate([("n", "sum")])
    return numbers, per_doc.rename_columns({"n_sum": "n"})


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class _Block:
    """Aligned documents that ask for counts together."""

    def __init__(self, number: int, kind: pa.DataType):
        self.number, self.kind = number, kind
        self.ids: list[pa.Array] = []
        self.numbers: dict[str, list] = {k: [] for k in (*_NUMBERS, "digest")}
        self.cells: list[pa.Table] = []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, a_ids: list[bytes], b_ids: list[bytes], pair: Pair, n_bytes: int) -> None:
        numbers, cells = align(a_ids, b_ids, pair)
        for k in _NUMBERS:
            self.numbers[k].append(numbers[k])
        self.numbers["digest"] += [
            hashlib.sha256(x.encode()).hexdigest() if x else "" for x in numbers["groups"].to_pylist()
        ]
        self.ids.append(ids)
        doc = pc.add(cells.column("doc"), pa.scalar(self.docs, pa.int64()))
        self.cells.append(cells.set_column(0, "doc", doc))
        self.docs += len(ids)
        self.bytes += n_bytes

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row per document, then a row per pair of ids that the block holds."""
        cells = pa.concat_tables(self.cells).combine_chunks()
        a, b = (cells.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
        coded = pc.dictionary_encode(pa.array(a << 32 | b))
        pair = coded.indices.to_numpy().astype(np.uint32)
        held = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        doc = cells.column("doc").to_numpy()
        order = np.lexsort((pair, doc))
        pair, n = pair[order], cells.column("n").to_numpy()[order].astype(np.uint32)
        cuts = np.searchsorted(doc[order], np.arange(self.docs + 1))
        packed = [
            (pack_numbers(np.diff(pair[lo:hi], prepend=np.uint32(0))), pack_numbers(n[lo:hi])) if hi > lo else (b"", b"")
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)
        ]

        def batch(size: int, **columns) -> pa.RecordBatch:
            given = {"block": pa.array(np.full(size, self.number, np.int64)), **columns}
            return pa.RecordBatch.from_arrays(
                [given[f.name] if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema
            )

        yield batch(
            self.docs,
            _id=pa.chunked_array(self.ids, self.kind).combine_chunks(),
            **{k: pa.array(np.concatenate(self.numbers[k]).astype(np.int64)) for k in _NUMBERS},
            digest=pa.array(self.numbers["digest"], pa.string()),
            pairs=pa.array([p for p, _ in packed], pa.binary()),
            times=pa.array([t for _, t in packed], pa.binary()),
        )
        keys = coded.dictionary.to_numpy()
        yield batch(
            len(keys),
            pair=pa.array(np.arange(len(keys), dtype=np.int32)),
            a=pa.array((keys >> 32).astype(np.int32)),
            b=pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
            docs=pa.array(held.column("count_all").to_numpy().astype(np.int64)),
        )


def _blocks(byte_model: bytes, piece_model: bytes, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _shared(byte_model, piece_model)
        number = TaskContext.get().partitionId() << 32
        kind = schema.field("_id").type
        block = _Block(number, kind)
        for batch in slices(batches, "_text", SLICE):
            texts = bpe_codec.utf8_texts(batch.column("_text"))
            a_ids, b_ids = zip(*map(pair.encode, texts), strict=True)
            block.add(batch.column("_id").cast(kind), list(a_ids), list(b_ids), pair, sum(map(len, texts)))
            if block.bytes >= BLOCK:
                yield from block.rows(schema)
                number += 1
                block = _Block(number, kind)
        if block.docs:
            yield from block.rows(schema)

    return run


def _answer(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over each document's links, from the counts of its block's pairs."""
    counts = np.zeros(answers.num_rows, np.int64)
    best = np.zeros(answers.num_rows, np.int64)
    at = answers.column("pair").to_numpy()
    counts[at] = answers.column("count").to_numpy()
    best[at] = answers.column("best").to_numpy()
    sums, bests = [], []
    for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        if not pairs:
            sums.append(0)
            bests.append(0)
            continue
        which = np.cumsum(unpack_numbers(pairs, np.uint32), dtype=np.int64)
        n = unpack_numbers(times, np.uint32).astype(np.int64)
        sums.append(int((counts[which] * n).sum()))
        bests.append(int((best[which] * n).sum()))
    out = docs.select(["_id", *_NUMBERS])
    out = out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    return out.append_column("groups_sha256", docs.column("digest"))


def aligned(
    docs: DataFrame,
    ws: Workspace,
    byte_bpe_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Rows per document, and ``a, b, count, best`` of each pair of ids ever linked.

    Documents have ``_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    """
    byte_model = bpe_codec.read_model(byte_bpe_path)
    with open(piece_path, "rb") as f:
        piece_model = f.read()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_field = T.StructField("_id", rows.schema["_id"].dataType)
    numbers = [T.StructField(k, T.LongType()) for k in _NUMBERS]
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            id_field,
            *numbers,
            T.StructField("digest", T.StringType()),
            T.StructField("pairs", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
            *[T.StructField(k, T.IntegerType()) for k in ("pair", "a", "b")],
            T.StructField("docs", T.LongType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    blocks = ws.save(rows.mapInArrow(_blocks(byte_model, piece_model, arrow), schema), "blocks")
    asked = blocks.where("a is not null").select("block", "pair", "a", "b", "docs")
    counts = ws.save(asked.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
    # A row per entry of the first vocabulary at most.
    highest = ws.save(counts.groupBy("a").agg(F.max("count").alias("highest")), "highest")
    judged = counts.join(F.broadcast(highest), "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    answers = asked.join(judged, ["a", "b"]).select(F.col("block").alias("asker"), "pair", "count", F.col("best").cast("bigint").alias("best"))
    given = blocks.where("a is null").select("block", "_id", *_NUMBERS, "digest", "pairs", "times")
    out = T.StructType(
        [
            id_field,
            *numbers,
            *[T.StructField(k, T.LongType()) for k in ("n_best", "count_sum")],
            T.StructField("groups_sha256", T.StringType()),
        ]
    )
    return given.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_answer, out), judged
