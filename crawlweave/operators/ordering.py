"""Running totals over groups of any size.

A window over a whole group puts that group in one task. Here the order key, a
whole number, is cut into blocks of ``2**BLOCK_BITS``; windows run inside
blocks, and block totals are summed the same way one level up. No window sees
more than one block of rows at the bottom, or one block of blocks above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BITS = 12


def running_before(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: Column,
    out: str,
    levels: int = 2,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows of the group that come earlier.

    ``order`` is a bigint, unique within the group; a null group is a group.
    ``df`` is read twice, so it should be a table or cheap to derive.
    """
    group = list(group)
    block, total, base = f"_block{levels}", f"_total{levels}", f"_base{levels}"
    marked = df.withColumn(block, F.shiftright(F.col(order), bits))
    keys = [*group, block]
    totals = marked.groupBy(*keys).agg(F.sum(value).alias(total))
    if levels > 1:
        totals = running_before(totals, group, block, F.col(total), base, levels - 1, bits)
    else:
        earlier = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
        totals = totals.withColumn(base, F.coalesce(F.sum(total).over(earlier), F.lit(0)))
    within = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(within), F.lit(0))
    named = {k: f"_of_{k}" for k in keys}
    bases = totals.select(*[F.col(k).alias(v) for k, v in named.items()], base)
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    return (
        marked.withColumn("_local", local)
        .join(bases, same)
        .withColumn(out, (F.col(base) + F.col("_local")).cast("bigint"))
        .drop(block, "_local", base, *named.values())
    )


def latest_as_of(
    asks: DataFrame,
    facts: DataFrame,
    group: str,
    time: str,
    value: Column,
    out: str,
    block_micros: int = 3_600_000_000,
) -> DataFrame:
    """``asks`` with ``out``: ``value`` of the newest of ``facts`` not later than the ask.

    Both have ``group`` and the timestamp ``time``; of facts at the same time the
    greatest value counts, and a fact without a group or time counts for nothing.
    Time is cut into blocks: windows run inside a block of a group, and what is
    newest before a block is carried over blocks, so a group with very many facts
    is no single task's work.
    """
    block = F.expr(f"unix_micros(`{time}`) div {block_micros}")
    told = facts.where(F.col(group).isNotNull() & F.col(time).isNotNull()).select(
        F.col(group).alias("_g"), block.alias("_b"), F.col(time).alias("_t"), value.alias("_v")
    )
    asked = asks.select(
        F.col(group).alias("_g"), block.alias("_b"), F.col(time).alias("_t"),
        F.struct(*asks.columns).alias("_ask"),
    )
    both = told.unionByName(asked, allowMissingColumns=True)
    within = W.partitionBy("_g", "_b").orderBy(
        "_t", F.col("_ask").isNotNull(), F.col("_v")
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    newest = F.last("_v", ignorenulls=True)
    blocks = both.groupBy("_g", "_b").agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_m")
    )
    earlier = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        F.col("_g").alias("_cg"),
        F.col("_b").alias("_cb"),
        F.last(F.col("_m._v"), ignorenulls=True).over(earlier).alias("_c"),
    )
    here = both.withColumn("_v", newest.over(within)).where(F.col("_ask").isNotNull())
    same = F.col("_g").eqNullSafe(F.col("_cg")) & F.col("_b").eqNullSafe(F.col("_cb"))
    return here.join(carried, same).select("_ask.*", F.coalesce("_v", "_c").alias(out))
