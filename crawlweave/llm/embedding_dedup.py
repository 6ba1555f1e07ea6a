"""Embedding near-dedup by a pivot-permutation index.

Reference points ("pivots") are ``PIVOTS`` vectors that lie far apart, picked one
after the other from a sample of ``SAMPLE`` vectors per dimension taken by hash;
being spread, they are not drawn into one dense group. Every vector is described by its ``NEAREST`` pivots in order of
closeness. Inverted lists are kept for each group of ``SHARED`` pivots among
these, so two vectors meet in a list exactly when the count of pivots they share
reaches ``SHARED``; lists of one are dropped before any vector moves. Inside a
list all cosines are computed in double precision, in bounded blocks. A pair
that meets in several lists is counted in the first of them only, so numbers of
links are added up without emitting pairs, and a spanning forest of each block's
links is enough for components.

Equal vectors collapse to one with a multiplicity first. The pivots are the only
thing fitted on a sample; every row is indexed, and no list is cut: one with more
than ``BLOCK`` rows is dealt over pairs of blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, are their own component and are kept; vectors of
different lengths never link; ids are whole numbers, equal rows that share an id
count once for each row; a row without an id links with nothing; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm.graph import components
from crawlweave.llm.hashing import mix
from crawlweave.workspace import Workspace

COSINE = 0.9
PIVOTS = 256
SAMPLE = 2048
NEAREST = 8
SHARED = 3
BLOCK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares stay in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.float64) for v in column.to_pylist()]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles."""
    for batch in batches:
        lists = batch.column("vector")
        flat = lists.flatten().cast(pa.float64())
        values = flat.to_numpy(zero_copy_only=False)
        bad = ~np.isfinite(values)
        sizes = np.array([len(v) if v is not None else 0 for v in lists], np.int64)
        ends = np.cumsum(sizes)
        good, packed = [], []
        for lo, hi in zip(ends - sizes, ends, strict=True):
            ok = hi > lo and not bad[lo:hi].any() and bool(values[lo:hi].any())
            good.append(ok)
            if ok:
                packed.append((values[lo:hi] + 0.0).tobytes())
        ids = batch.column("_id").filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], ["_id", "v"])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the closest pivots of each vector, closest first."""
    close = unit(vectors) @ pivots.T
    return np.argsort(-close, axis=1, kind="stable")[:, :nearest].astype(np.int32)


def list_keys(near: np.ndarray, dim: int, shared: int) -> np.ndarray:
    """The inverted lists of each vector: one for every ``shared`` of its pivots."""
    order = np.sort(near, axis=1).astype(np.uint64)
    shared = min(shared, order.shape[1])
    out = []
    for places in combinations(range(order.shape[1]), shared):
        key = np.full(len(order), dim, np.uint64)
        for place in places:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + order[:, place] + np.uint64(1))
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _by_dimension(vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = np.array([len(v) for v in vectors])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, np.stack([vectors[i] for i in at])


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: list[bytes] = [b""] * batch.num_rows
            for dim, at, block in _by_dimension(_rows(batch.column("v"))):
                for i, row in zip(at, nearest_pivots(block, pivots[dim], nearest), strict=True):
                    near[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.binary())], [*batch.schema.names, "near"]
            )

    return run


def _index(shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.frombuffer(x, np.int32) for x in batch.column("near").to_pylist()]
            dims = np.array([len(v) // 8 for v in batch.column("v").to_pylist()])
            reps = batch.column("rep").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keys = list_keys(np.stack([near[i] for i in at]), int(dim), shared)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(np.repeat(reps[at], keys.shape[1]))],
                    ["key", "rep"],
                )

    return run


class _Forest:
    """Union-find over the rows of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _compare(cosine: float, shared: int):
    """Sorted cells to counts (``b`` null) and links (``n`` 0)."""

    def one(key, rep, times, side, vectors, near):
        dim = vectors.shape[1]
        unit_rows = unit(vectors)
        first = np.flatnonzero(side != 1)
        second = np.flatnonzero(side != 0)
        close = unit_rows[first] @ unit_rows[second].T >= cosine
        if side[0] == 2:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        i, j = first[i], second[j]
        count = np.zeros(len(rep), np.int64)
        links = []
        forest = _Forest(len(rep))
        sorted_near = np.sort(near, axis=1)
        for lo in range(0, len(i), 1 << 16):
            x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            common = (sorted_near[x][:, :, None] == sorted_near[y][:, None, :]).any(axis=2)
            place = np.cumsum(common, axis=1)
            least = min(shared, near.shape[1])
            lead = np.sort(np.where(common & (place <= least), sorted_near[x], np.iinfo(np.int32).max), axis=1)
            mine = list_keys(lead[:, :least], dim, least)[:, 0] == key
            np.add.at(count, x[mine], times[y[mine]])
            np.add.at(count, y[mine], times[x[mine]])
            for p, q in zip(x[mine].tolist(), y[mine].tolist(), strict=True):
                if forest.join(p, q):
                    links.append((rep[p], rep[q]))
        some = np.flatnonzero(count)
        return [(rep[k], None, count[k]) for k in some] + [(p, q, 0) for p, q in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            cell, key, rep, times, side = (
                table.column(c).to_numpy() for c in ("cell", "key", "rep", "times", "side")
            )
            vectors = table.column("v").to_pylist()
            near = table.column("near").to_pylist()
            begins = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])])
            out = []
            for lo, hi in zip(begins, [*begins[1:], len(cell)], strict=True):
                s = slice(lo, hi)
                out += one(
                    key[lo], rep[s], times[s], side[s],
                    np.frombuffer(b"".join(vectors[s]), np.float64).reshape(hi - lo, -1),
                    np.frombuffer(b"".join(near[s]), np.int32).reshape(hi - lo, -1),
                )
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            at = int(np.searchsorted(cell, cell[-1], "left"))
            if at == 0 and held and held[-1].column("cell")[0].as_py() == cell[0]:
                held.append(batch)
                continue
            if held or at:
                yield from whole(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        if held:
            yield from whole(pa.Table.from_batches(held))

    return run


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``sample``, each the one furthest from those before it."""
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    return sample[chosen]


def pick_pivots(distinct: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """At most ``pivots`` unit vectors per dimension, from a bounded sample."""
    chosen: dict[int, np.ndarray] = {}
    dims = [r[0] for r in distinct.select((F.octet_length("v") / 8).cast("int")).distinct().collect()]
    for dim in dims:
        rows = (
            distinct.where(F.octet_length("v") == 8 * dim)
            .select("v", F.xxhash64("v").alias("h"))
            .orderBy("h", "v")
            .limit(SAMPLE)
            .collect()
        )
        chosen[dim] = spread(unit(np.stack([np.frombuffer(r.v, np.float64) for r in rows])), pivots)
    return chosen


def near_vectors(
    table: DataFrame,
    ws: Workspace,
    cosine: float = COSINE,
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
    shared: int = SHARED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``_id, n_links, component, kept`` of each row."""
    spark = table.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    usable = ws.save(
        rows.where(F.col("_id").isNotNull() & (F.size("vector") > 0)).mapInArrow(
            _clean, "_id bigint, v binary"
        ),
        "usable",
    )
    distinct = ws.save(
        usable.groupBy("v").agg(F.min("_id").alias("rep"), F.count("*").alias("times")), "distinct"
    )
    described = ws.save(
        distinct.mapInArrow(
            _describe(pick_pivots(distinct, pivots), nearest),
            "v binary, rep bigint, times bigint, near binary",
        ),
        "described",
    )
    lists = ws.save(described.mapInArrow(_index(shared), "key bigint, rep bigint"), "lists")
    several = ws.save(
        lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "several",
    )
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = (
        lists.join(several, "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
            "key",
            "rep",
            F.when(F.col("block") == F.col("other"), 2)
            .when(F.col("block") < F.col("other"), 0)
            .otherwise(1)
            .alias("side"),
        )
        .join(described, "rep")
    )
    found = ws.save(
        cells.repartition(width, "cell")
        .sortWithinPartitions("cell", "key")
        .mapInArrow(_compare(cosine, shared), "a bigint, b bigint, n bigint"),
        "found",
    )
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    linked = distinct.join(counts, F.col("rep") == F.col("a"), "left").select(
        "v", "rep", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    judged = usable.join(linked, "v").select("_id", "rep", "n_links")
    copies = judged.where("_id != rep").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    roots = components(
        found.where("b is not null").select("a", "b").unionByName(copies), ws, "all"
    )
    judged = judged.select(F.col("_id").alias("_jid"), "n_links").distinct().groupBy("_jid").agg(
        F.max("n_links").alias("n_links")
    )
    return (
        rows.select("_id")
        .join(judged, F.col("_id") == F.col("_jid"), "left")
        .join(roots, F.col("_id") == F.col("node"), "left")
        .select(
            "_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("root", "_id").alias("component"),
            F.coalesce(F.col("root") == F.col("_id"), F.lit(True)).alias("kept"),
        )
    )
