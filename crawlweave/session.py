"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every deployment wants, whatever its size.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app_name: str = "crawlweave",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the base settings; ``conf`` adds to or overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
