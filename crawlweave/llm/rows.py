"""Reading rows the same way in every operator.

An operator selects the columns it needs under names of its own, so further
columns of a table, whatever their names, never meet its own. Rows that agree
in id and text are one document; ``row_key`` is the hash of both that tells
them apart from rows that share only the id (a null id included).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(
        F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_key`` and ``_text`` of each row."""
    return docs.select(
        F.col(id_col).alias("_id"),
        row_key(id_col, text_col).alias("_key"),
        F.col(text_col).alias("_text"),
    )


def with_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``keyed``, with all columns of the row in the struct ``_row``."""
    return docs.select(
        F.col(id_col).alias("_id"),
        row_key(id_col, text_col).alias("_key"),
        F.col(text_col).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"),
    )


def rows_back(df: DataFrame, docs: DataFrame, text: Column | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` again, with ``text`` for the text; ``n_chars`` follows it."""
    out = []
    for name, kind in docs.dtypes:
        if name == text_col:
            value = F.col("_text") if text is None else text
        elif name == "n_chars" and text is not None:
            same = text.eqNullSafe(F.col("_text"))
            value = F.when(same, F.col("_row").getField(name)).otherwise(F.length(text)).cast(kind)
        else:
            value = F.col("_row").getField(name)
        out.append(value.alias(name))
    return df.select(*out)


def join_keyed(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on ``_id`` and ``_key``; a null id meets a null id."""
    r = right.withColumnRenamed("_id", "_rid").withColumnRenamed("_key", "_rkey")
    on = (F.col("_key") == F.col("_rkey")) & F.col("_id").eqNullSafe(F.col("_rid"))
    joined = left.join(r, on, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop("_rid", "_rkey")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each text begins and ends."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
        kind = np.int64
    else:
        column = column.cast(pa.binary()).fill_null(b"")
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each take about ``limit`` bytes, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = packed(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(at, at[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
