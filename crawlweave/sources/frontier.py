"""Frontier records on the wire. The same code serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.schemas import RECORD_JSON


def decode_records(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed records from a message column; null payloads are skipped.

    A payload that is itself a JSON string is unwrapped first.
    """
    keep = [c for c in messages.columns if c != value]
    raw = F.col(value)
    inner = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    text = F.when(raw.startswith('"'), inner).otherwise(raw)
    record = F.from_json(text, RECORD_JSON)
    return (
        messages.where(raw.isNotNull())
        .select(*keep, record.alias("_r"))
        .select(
            *keep,
            F.col("_r.crawlId").alias("crawl_id"),
            F.col("_r.url").alias("url"),
            F.col("_r.baseUrl").alias("base_url"),
            F.col("_r.distance").alias("distance"),
            F.timestamp_millis("_r.startTime").alias("start_time"),
            F.timestamp_millis("_r.maxTime").alias("max_time"),
            F.col("_r.maxDistance").alias("max_distance"),
            F.col("_r.maxUrls").alias("max_urls"),
        )
    )


def encode_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON message per record, null fields left out."""
    wire = F.struct(
        F.col("crawl_id").alias("crawlId"),
        F.col("base_url").alias("baseUrl"),
        "url",
        "distance",
        F.col("max_distance").alias("maxDistance"),
        F.unix_millis("start_time").alias("startTime"),
        F.unix_millis("max_time").alias("maxTime"),
        F.col("max_urls").alias("maxUrls"),
    )
    return records.select(*keep, F.to_json(wire).alias("value"))


def split_undecodable(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that carry a crawl and a URL, and those that do not."""
    ok = F.col("crawl_id").isNotNull() & F.col("url").isNotNull()
    return decoded.where(ok), decoded.where(~ok)
