"""Mixing sources to target weights by distributed prefix sums.

Each document gets a hash-random key. Rows are range-partitioned by source and
key, so a source of any size spreads over as many partitions as it fills; each
partition sums sizes along its sorted stream, and one total per partition and
source carries the sums across. A source's budget of words is its target cut to
whole words: full passes over the source first, then the documents in key order
up to the exact word, so the last one may be taken in part.

Targets: sources by code point, a null source last, weigh ``weights`` in turn
and share all words; a target stops at ``max_epochs`` times its source, and what
is over is shared again by weight until nothing is.

Defined cases: a null text has size 0; a source without words has target 0;
rows that agree in id and size may stand for each other; equal hash keys go by
id, then size; an empty table gives an empty table. One row per source is read
to the driver, and more than ``MAX_SOURCES`` sources are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.rows import join_keyed, row_key, rows_back, with_rest
from crawlweave.workspace import Workspace

MAX_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_key(id_col: str, seed: int) -> Column:
    """A hash of the id and the seed, as good as random and the same in every run."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), name)))


def targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[int], max_epochs: int
) -> list[tuple[str | None, int, float]]:
    """``(source, size, target)``: weighted shares of all words, none above its cap.

    Sources reach their caps in the order of cap over weight, so the capped ones
    are a prefix of that order.
    """
    if not sizes:
        return []
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "")))
    rows = [(s, n, weights[i % len(weights)], max_epochs * n) for i, (s, n) in enumerate(ordered)]
    left, weight = sum(n for _, n, _, _ in rows), sum(w for _, _, w, _ in rows)
    out: dict[str | None, float] = {}
    waiting = sorted(rows, key=lambda r: (r[3] / r[2], r[2]))
    for at, (source, _, w, cap) in enumerate(waiting):
        if cap * weight > w * left:
            for s, _, v, _ in waiting[at:]:
                out[s] = v * left / weight
            break
        out[source] = float(cap)
        left, weight = left - cap, weight - w
    return [(s, n, out[s]) for s, n, _, _ in rows]


def _prefix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``before``: words of the same source earlier in this partition."""
    seen: dict[str | None, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy()
        before = np.cumsum(size) - size
        codes = batch.column("source").dictionary_encode(null_encoding="encode")
        index = codes.indices.to_numpy()
        begins = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        names = codes.dictionary.to_pylist()
        for lo, hi in zip(begins, [*begins[1:], len(index)], strict=True):
            name = names[index[lo]]
            base = int(before[lo])
            before[lo:hi] += seen.get(name, 0) - base
            seen = {name: int(before[hi - 1] + size[hi - 1])}
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before)], [*batch.schema.names, "before"]
        )


def mix(
    docs: DataFrame,
    ws: Workspace,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``_id, _key, source, size, source_size, target, taken`` of each row of ``docs``."""
    spark = docs.sparkSession
    sized = ws.save(
        docs.select(
            F.col(id_col).alias("_id"),
            row_key(id_col, text_col).alias("_key"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "sized",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("n"))
    listed = [tuple(r) for r in per_source.limit(MAX_SOURCES + 1).collect()]
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    cuts = [
        (s, n, t, *(divmod(int(t), n) if n else (0, 0)))
        for s, n, t in targets(listed, weights, max_epochs)
    ]
    plan = spark.createDataFrame(
        cuts,
        "source string, source_size bigint, target double, epochs bigint, rest bigint",
    )
    order = ["source", "_random", "_id", "size"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sized.withColumn("_random", random_key("_id", seed))
    added = [T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())]
    schema = T.StructType([*keyed.schema.fields, *added])
    sums = ws.save(
        keyed.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_prefix_sums, schema),
        "sums",
    )
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        sums.groupBy("source", "part")
        .agg(F.sum("size").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    small = ws.save(
        bases.join(plan, bases["source"].eqNullSafe(plan["source"]))
        .select(bases["source"].alias("s"), F.col("part").alias("p"), "base", "source_size", "target", "epochs", "rest"),
        "bases",
    )
    place = F.col("base") + F.col("before")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - place))
    return sums.join(
        small, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    ).select(
        "_id",
        "_key",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + last).cast("bigint").alias("taken"),
    )


def take_mix(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size, source_size, target, taken``.

    Each row stands once, with its whole text: ``taken`` words of it, over as many
    passes as that takes, are the mix. Rows that agree in id, text and source have
    a ``taken`` each. Columns of these names are replaced.
    """
    added = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*added)
    source = options.get("source_col", "source")
    same = W.partitionBy("_id", "_key", "_source")
    mixed = (
        mix(docs, ws, **options)
        .where("taken > 0")
        .withColumnsRenamed({c: f"_{c}" for c in [*added, "source"]})
        .withColumn("_copy", F.row_number().over(same.orderBy(F.desc("_taken"))))
        .withColumnsRenamed({"_source": "_from", "_copy": "_nth"})
    )
    rows = with_rest(docs).withColumn("_source", F.col("_row").getField(source))
    rows = rows.withColumn("_copy", F.row_number().over(same.orderBy(F.lit(0))))
    both = (
        join_keyed(rows, mixed, "inner")
        .where(F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_copy") == F.col("_nth")))
        .withColumn("_row", F.struct("_row.*", *[F.col(f"_{c}") for c in added]))
    )
    taken = {f"_{c}": c for c in added}
    shape = docs.withColumns({f"_{c}": F.lit(0) for c in added})
    return rows_back(both, shape).withColumnsRenamed(taken)
