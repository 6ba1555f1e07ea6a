"""Starting streams and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlweave.workspace import Workspace

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 100) -> DataFrame:
    """Stream of the Parquet files in ``folder`` that match ``name``.

    A table ``name`` may be a folder of files, too; all of them are read then.
    """
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if whole.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(whole):
        folder, name = f"{folder}/{name}", "*"
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(folder)
    )


def message_stream(spark: SparkSession, fmt: str, options: dict[str, str]) -> DataFrame:
    """Stream of messages with their text in ``value``, from the earliest on."""
    reader = spark.readStream.format(fmt).option("startingOffsets", "earliest")
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State grows with the crawl, so it must not live in executor heaps."""
    current = spark.conf.get(_PROVIDER, "")
    if "RocksDB" not in current:
        spark.conf.set(_PROVIDER, _ROCKSDB)


#: Run what is there and end; pass another trigger to keep running.
AVAILABLE_NOW = {"availableNow": True}


def append_to_files(
    stream: DataFrame,
    ws: Workspace,
    name: str,
    partition_by: tuple[str, ...] = (),
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Into the Parquet table ``name`` of ``ws``, exactly once.

    Table and progress lie in the workspace: ``Workspace.named`` gives the same
    one to a job that starts again, which then goes on where it stopped.
    """
    _keep_state_on_disk(ws.spark)
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", ws.path(name))
        .option("checkpointLocation", ws.path(f"{name}-progress"))
        .trigger(**trigger)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def each_batch(
    stream: DataFrame,
    ws: Workspace,
    name: str,
    change: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """A folder per micro-batch under ``name``; it resumes like ``append_to_files``.

    A batch that is run again overwrites its own folder. ``change`` is applied
    to each batch when it runs, so tables it reads are as of then.
    """
    _keep_state_on_disk(ws.spark)

    def write(batch: DataFrame, number: int) -> None:
        out = change(batch) if change else batch
        out.write.mode("overwrite").parquet(f"{ws.path(name)}/batch={number}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", ws.path(f"{name}-progress"))
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def send_messages(
    stream: DataFrame,
    ws: Workspace,
    name: str,
    fmt: str,
    options: dict[str, str],
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Send the rows' ``value`` to a sink, the other end of ``message_stream``."""
    return (
        stream.select("value").writeStream.outputMode("append")
        .format(fmt)
        .options(**options)
        .option("checkpointLocation", ws.path(f"{name}-progress"))
        .trigger(**trigger)
        .start()
    )


def latest_rows(ws: Workspace, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Newest row per key of a table written with ``each_batch`` in update mode.

    Batches folded by ``compact_rows`` come from its newest table.
    """
    rows = ws.load(name)
    done = ws.compacted(name)
    if done is not None:
        number, base = done
        rows = base.unionByName(rows.where(F.col("batch") > number).select(base.columns))
    return _newest(rows, keys).drop("batch")


def _newest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch")
    return rows.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")


def compact_rows(ws: Workspace, name: str, keys: tuple[str, ...], upto: int) -> None:
    """Fold the batches up to ``upto``, all of them finished, into one table.

    Later reads take it and the batches after it. Run it between micro-batches.
    What an earlier call folded is removed: a reader that began before this call
    still finds its files, one that began before the last call may not.
    """
    rows = ws.load(name)
    done = ws.compacted(name)
    if done is not None:
        number, base = done
        if upto <= number:
            return
        rows = base.unionByName(rows.where(F.col("batch") > number).select(base.columns))
    ws.save(_newest(rows.where(F.col("batch") <= upto), keys), f"{name}-upto-{upto}")
    if done is not None:
        ws.drop_folded(name, number)
