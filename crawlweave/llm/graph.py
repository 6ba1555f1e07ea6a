"""Connected components of a link table by alternating stars.

Each turn hangs the neighbours of every node on the smallest of them, first
those above the node, then those below, until nothing moves; the turns grow
with the logarithm of the longest chain. Every turn is a written table, so the
lineage stays short, and both sides of each join are plain tables whose heavy
nodes adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.workspace import Workspace


#: Links per task; the tasks of a turn follow the size of the table.
LINKS_PER_TASK = 250_000


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    n, total = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return n, total


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the smallest node reachable."""
    edges = ws.save(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{name}_0",
    )
    mark, turn = _mark(edges), 0
    while True:
        turn += 1
        tasks = 1 + mark[0] // LINKS_PER_TASK

        def save(df: DataFrame, step: str, tasks: int = tasks, turn: int = turn) -> DataFrame:
            return ws.save(df.coalesce(tasks), f"{name}_{turn}_{step}")

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(
            both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
            "up",
        )
        large = save(
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(),
            "large",
        )
        lowest = save(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        edges = save(
            large.join(lowest, "a")
            .where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select("a", F.col("m").alias("b")))
            .distinct(),
            "small",
        )
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
