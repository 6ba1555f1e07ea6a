"""Line dedup by range-partitioned line hashes.

Every line becomes a 128-bit digest of its key. Digests are range-partitioned
together with document and position, so a line that a third of all documents
hold is spread over as many partitions as it fills; each partition is read as a
sorted stream in which the occurrences of a line follow each other. A run that
touches neither end of its partition is decided there. The runs at the two ends
may go on next door; they are at most two keys per partition and are decided by
one aggregate over all partitions, as is a run that fills a whole batch of rows. What comes back per document is a compressed
keep bitmap, not text.

Defined cases: a null or empty text is one empty line; a key shorter than
``min_chars`` code points is never dropped; rows that agree in id and text are
one document and get the same bitmap; a null id sorts first and is an id like
any other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.rows import join_keyed, keyed, raw_texts, rows_back, slices, with_rest
from crawlweave.workspace import Workspace

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def pack_bits(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def line_key(line: bytes) -> bytes:
    """Bytes outside A-Z and ASCII white space stay as they are."""
    return line.strip(_SPACE).lower()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            digests, rows, places = [], [], []
            for row, text in enumerate(raw_texts(batch.column("_text"))):
                for place, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (
                        len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars
                    ):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        rows.append(row)
                        places.append(place)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    batch.column("_id").take(at),
                    batch.column("_key").take(at),
                    pa.array(places, pa.int32()),
                ],
                ["h1", "h2", "_id", "_key", "pos"],
            )

    return run


def _decide_runs(min_docs: int, keep_first: bool):
    """Rows of a sorted partition that are dropped, or that belong to a run at its ends."""

    def out(table: pa.Table, take: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
        if take.any():
            part = table.filter(pa.array(take))
            yield from part.append_column("edge", pa.array(np.full(part.num_rows, edge))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the run that is still open
        open_key, first = None, True  # first: the open run's rows are passed on as they come
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.slice(batch.num_rows - 1).select(["h1", "h2"]).to_pylist()[0]
            if open_key == ends and all(
                batch.column(c)[0].as_py() == ends[c] for c in ("h1", "h2")
            ):
                # A run this long is settled like one at an end, so nothing is held back.
                for rows in [*held, batch]:
                    yield from out(pa.Table.from_batches([rows]), np.ones(rows.num_rows, bool), True)
                held, first = [], True
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if first and open_key == {"h1": int(h1[0]), "h2": int(h2[0])}:
                new[0] = False  # goes on with the first run of the partition
            doc = table.column("_key").to_numpy()
            begins = np.flatnonzero(new)
            last = begins[-1] if len(begins) else 0
            new_doc = new.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            ids = np.cumsum(new) - 1  # -1: the rest of the first run
            counts = np.bincount(ids[new_doc & (ids >= 0)], minlength=len(begins))
            common = np.zeros(len(h1), bool)
            common[ids >= 0] = counts[ids[ids >= 0]] >= min_docs
            at_start = ids == -1
            if first and open_key is None:
                at_start |= ids == 0
            closed = np.arange(len(h1)) < last
            yield from out(table, at_start & (closed | (last == 0)), True)
            yield from out(table, common & closed & ~at_start & ~(new & keep_first), False)
            if last > 0 or not at_start.any():
                first = False
                held = table.slice(last).to_batches()
            else:
                held = []
            open_key = ends
        if held:
            table = pa.Table.from_batches(held)
            yield from out(table, np.ones(table.num_rows, bool), True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = batch.column("n_lines").to_pylist()
        drops = batch.column("drops").to_pylist()
        maps = []
        for n, gone in zip(counts, drops, strict=True):
            keep = np.ones(n, bool)
            keep[gone or []] = False
            maps.append(pack_bits(keep))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_key"),
                batch.column("n_lines"),
                pa.array([len(x or ()) for x in drops], pa.int64()),
                pa.array(maps, pa.binary()),
            ],
            ["_id", "_key", "n_lines", "n_dropped", "keep"],
        )


def line_bitmaps(
    docs: DataFrame,
    ws: Workspace,
    min_docs: int = 2,
    min_chars: int = 1,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_id, _key, n_lines, n_dropped, keep`` per document.

    A line whose key is found in ``min_docs`` documents goes everywhere, except
    that with ``keep_first`` its first occurrence by id and position stays.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType
    place = [T.StructField("_id", kind), T.StructField("_key", T.LongType())]
    hashes = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    pos = T.StructField("pos", T.IntegerType())
    lines = ws.save(
        rows.mapInArrow(_hash_lines(min_chars), T.StructType([*hashes, *place, pos])), "lines"
    )
    order = ["h1", "h2", "_id", "_key", "pos"]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ws.save(
        lines.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _decide_runs(min_docs, keep_first),
            T.StructType([*hashes, *place, pos, T.StructField("edge", T.BooleanType())]),
        ),
        "found",
    )
    at_edge = found.where("edge")
    per_doc = at_edge.groupBy("h1", "h2", "_key").agg(
        F.min(F.struct("_id", "_key", "pos")).alias("first")
    )
    # Written first: two rows a partition, and one for each line that fills a batch.
    totals = ws.save(
        per_doc.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("first").alias("first"))
        .where(F.col("n") >= min_docs),
        "ends",
    )
    late = at_edge.join(totals, ["h1", "h2"])
    if keep_first:
        late = late.where(~F.struct("_id", "_key", "pos").eqNullSafe(F.col("first")))
    drops = (
        found.where("not edge")
        .select("_id", "_key", "pos")
        .unionByName(late.select("_id", "_key", "pos"))
        .groupBy("_id", "_key")
        .agg(F.collect_set("pos").alias("drops"))
    )
    text = F.coalesce(F.col("_text"), F.lit(""))
    sizes = rows.select(
        "_id",
        "_key",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        .cast("bigint")
        .alias("n_lines"),
    )
    schema = T.StructType(
        [
            *place,
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("keep", T.BinaryType()),
        ]
    )
    return join_keyed(sizes.distinct(), drops).mapInArrow(_bitmaps, schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text", 4 << 20):
        kept = []
        for text, n, gone, bits in zip(
            raw_texts(batch.column("_text")),
            batch.column("n_lines").to_pylist(),
            batch.column("n_dropped").to_pylist(),
            batch.column("keep").to_pylist(),
            strict=True,
        ):
            if gone:
                lines = text.split(b"\n")
                text = b"\n".join(lines[i] for i in np.flatnonzero(unpack_bits(bits, n)))
            kept.append(text)
        column = pa.array(kept, pa.binary()).cast(pa.string())
        names = [*batch.schema.names, "_kept"]
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names)


def with_kept_text(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Add ``_kept``, ``n_lines`` and ``n_dropped`` to rows with ``_id, _key, _text``."""
    joined = join_keyed(rows, bitmaps)
    schema = T.StructType([*joined.schema.fields, T.StructField("_kept", T.StringType())])
    return joined.mapInArrow(_apply, schema)


def drop_lines(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """``docs`` with common lines taken out of ``text`` and ``n_chars`` counted anew.

    A document that loses all its text goes; one that was empty before stays.
    """
    done = with_kept_text(with_rest(docs), line_bitmaps(docs, ws, **options))
    text = F.when(F.col("n_dropped") > 0, F.col("_kept")).otherwise(F.col("_text"))
    emptied = (F.col("n_dropped") > 0) & (F.length("_kept") == 0)
    return rows_back(done.where(~emptied), docs, text)
