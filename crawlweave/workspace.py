"""Tables written between the stages of a job.

A stage that feeds several later ones, or closes one turn of a loop, is written
as a Parquet table in the folder that ``spark.checkpoint.dir`` names. That cuts
the lineage, gives the optimizer real sizes, and outlives any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Narrow rows that make a bucket worth a task.
BUCKET_ROWS = 100_000

#: Spark's own limit on the buckets of a table.
MOST_BUCKETS = 100_000

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="crawlweave-")
    return _LOCAL_ROOTS[context.applicationId]


class Workspace:
    """One run's folder of intermediate tables."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.run_id = uuid.uuid4().hex[:12]
        self.root = f"{(root or shared_root(spark)).rstrip('/')}/crawlweave/{self.run_id}"
        self._tables: list[str] = []
        self._children: list[Workspace] = []

    def child(self, name: str) -> Workspace:
        """A fresh folder and table names of its own, for one call of a job."""
        made = Workspace(self.spark, self.path(name))
        self._children.append(made)
        return made

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(
        self,
        df: DataFrame,
        name: str,
        mode: str = "overwrite",
        partition_by: Sequence[str] = (),
    ) -> DataFrame:
        """Write ``df`` as a Parquet table and return the table."""
        path = self.path(name)
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(name))

    def save_bucketed(
        self,
        df: DataFrame,
        name: str,
        keys: Sequence[str],
        sort: Sequence[str] = (),
        buckets: int | None = None,
        placed: bool = False,
        mode: str = "overwrite",
    ) -> DataFrame:
        """Write ``df`` hash-bucketed on ``keys``; ``mode="append"`` adds to it.

        Joins and aggregates on a superset of ``keys`` then need no shuffle of
        this table. One repartition puts each bucket in one task, so the write
        leaves one file per bucket; ``placed`` says that ``df`` already lies that way.
        Only for keys without a heavy value. There are as many buckets as
        ``spark.sql.shuffle.partitions`` unless told otherwise: shuffles on the
        same keys then line up with them, and one setting fits both to the data.
        """
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(buckets, MOST_BUCKETS)
        table = f"crawlweave_{self.run_id}_{name}"
        writer = (
            (df if placed else df.repartition(buckets, *keys))
            .write.mode(mode)
            .format("parquet")
            .option("path", self.path(name))
            .bucketBy(buckets, *keys)
        )
        if sort:
            writer = writer.sortBy(*sort)
        writer.saveAsTable(table)
        if table not in self._tables:
            self._tables.append(table)
        return self.spark.table(table)

    @classmethod
    def named(cls, spark: SparkSession, name: str, root: str | None = None) -> Workspace:
        """The workspace of a job that can be started again under the same name."""
        made = cls(spark, root)
        made.run_id = name
        made.root = f"{(root or shared_root(spark)).rstrip('/')}/crawlweave/{name}"
        return made

    def compacted(self, name: str) -> tuple[int, DataFrame] | None:
        """The newest finished table of ``name`` folded up to a batch, and that batch."""
        numbers = self._numbered(f"{name}-upto-*")
        if not numbers:
            return None
        return max(numbers), self.load(f"{name}-upto-{max(numbers)}")

    def attach_bucketed(
        self, name: str, schema: StructType, keys: Sequence[str], sort: Sequence[str], buckets: int
    ) -> DataFrame:
        """A table that ``save_bucketed`` wrote, possibly in another session, under a new name."""
        table = f"crawlweave_{self.run_id}_{name}"
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        order = f"SORTED BY ({', '.join(sort)})" if sort else ""
        self.spark.sql(
            f"CREATE TABLE {table} ({listed}) USING parquet CLUSTERED BY ({', '.join(keys)}) {order} "
            f"INTO {buckets} BUCKETS LOCATION '{self.path(name)}'"
        )
        self._tables.append(table)
        return self.spark.table(table)

    def adopt(self, other: Workspace) -> None:
        """Let ``clean`` remove another workspace, too."""
        self._children.append(other)

    def _numbered(self, pattern: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        found = hadoop.Path(f"{self.path(pattern)}/_SUCCESS")
        files = found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found)
        return [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in files or ()]

    def drop_folded(self, name: str, upto: int) -> None:
        """Remove batches of ``name`` up to ``upto``, and tables folded before that one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        old = [f"{name}-upto-{k}" for k in self._numbered(f"{name}-upto-*") if k < upto]
        batches = hadoop.Path(f"{self.path(name)}/batch=*")
        files = batches.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.globStatus(batches) or ():
            folder = found.getPath().getName()
            if int(folder.partition("=")[2]) <= upto:
                old.append(f"{name}/{folder}")
        for folder in old:
            files.delete(hadoop.Path(self.path(folder)), True)

    def newest(self, name: str) -> int | None:
        """The greatest number of the finished tables ``name-<number>``."""
        return max(self._numbered(f"{name}-*"), default=None)

    def buckets_for(self, rows: int) -> int:
        """Buckets for a table that may grow to about ``rows`` narrow rows."""
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(most, MOST_BUCKETS, -(-rows // BUCKET_ROWS)))

    def clean(self) -> None:
        """Remove the run's files and table names, once its results are consumed."""
        while self._children:
            self._children.pop().clean()
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
