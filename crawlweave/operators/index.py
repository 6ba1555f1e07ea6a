"""Inverted-index relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import text

FIELDS = ("title", "content")


def postings(docs: DataFrame, fields: Sequence[str] = FIELDS, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, field, term, tf, dl)``: counts per document, with field length.

    When ``docs`` is partitioned by ``doc_id`` this needs no shuffle; otherwise
    counts are combined per task first. Columns of a document in ``keep`` stay.
    """
    per_field = F.array(
        *[
            F.struct(F.lit(f).alias("field"), text.tokens(F.col(f)).alias("toks"))
            for f in fields
        ]
    )
    return (
        docs.select("doc_id", *keep, F.explode(per_field).alias("_f"))
        .select("doc_id", *keep, "_f.field", "_f.toks", F.size("_f.toks").cast("bigint").alias("dl"))
        .select("doc_id", *keep, "field", "dl", F.explode("toks").alias("term"))
        .groupBy("doc_id", *keep, "field", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """``(field, term, df)``: in how many documents each term occurs."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def corpus_stats(postings: DataFrame) -> DataFrame:
    """``(field, n_docs, sum_dl, avgdl)`` over documents that have the field."""
    per_doc = postings.groupBy("doc_id", "field").agg(F.max("dl").alias("dl"))
    return per_doc.groupBy("field").agg(
        F.count("*").alias("n_docs"),
        F.sum("dl").alias("sum_dl"),
        F.avg("dl").alias("avgdl"),
    )
