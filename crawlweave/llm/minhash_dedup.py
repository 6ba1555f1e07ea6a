"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gives ``PLACES`` minima of ``BITS`` bits. The
signature is cut into ``PLACES / CHUNK`` chunks. If two signatures differ in at
most ``DISTANCE`` places, some chunk differs in at most one (pigeonhole), so
each chunk is indexed once for every choice of one place to leave out: all
pairs within that distance share a key. At a similarity of 0.75 a place differs
with a chance of 1/4, and a pair is further apart than ``DISTANCE`` = 31 of 64
about once in 100,000; more similar pairs practically never.

1. Documents with equal sets collapse to one representative.
2. Keys are range-partitioned with the representative, so a key that a third of
   them share spreads over many partitions; sorted runs give the buckets that
   have more than one member.
3. The leader of a bucket is its member with most company over all its buckets,
   as an original has among its edited copies. Each member is checked against
   the leader it shares most keys with, on full sets. That links families in one
   step, without their pairs.
4. Buckets whose members are not all linked yet are finished exactly, in bounded
   blocks that hold signatures and texts: members of different components that
   are within the distance are checked on full sets there and then, each pair in
   the first bucket it shares, and only links that join something new come out.

No pair within a finished component is looked at, no bucket is cut, and nothing
is left unchecked.

Defined cases: a null text or one without words has an empty set, no links and
is kept; fewer words than a shingle make one shingle; ids are whole numbers,
rows that share an id are one node, whose texts are all compared (ids lie below
2**62 then); a row without an id links with nothing and is kept; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.graph import components
from crawlweave.llm.hashing import mix, shingle_hashes, word_hashes
from crawlweave.llm.rows import keyed, packed, rows_back, slices, with_rest
from crawlweave.workspace import Workspace

SHINGLE = 5
PERCENT = 75
PLACES, BITS, CHUNK = 64, 16, 4
DISTANCE = 2 * (PLACES // CHUNK) - 1
BLOCK = 1024

_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, at)
    total = np.full(max(len(words) - k + 1, 0), k, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(total)]
    total = mix(total)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(total[lo : hi - k + 1]))
        else:
            out.append(shingle_hashes(words[lo:hi], k))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``PLACES`` minima over the set, ``BITS`` bits of each."""
    out = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 4096):
        part = shingles[lo : lo + 4096]
        np.minimum(out, (_FACTORS[:, None] * part[None, :]).min(axis=1), out=out)
    return (mix(out) >> np.uint64(64 - BITS)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature: every chunk with one place left out."""
    n = len(signatures)
    chunks = signatures.reshape(n, PLACES // CHUNK, CHUNK).astype(np.uint64)
    number = np.arange(PLACES // CHUNK, dtype=np.uint64)
    out = []
    for left_out in range(CHUNK):
        key = np.broadcast_to(number * np.uint64(CHUNK) + np.uint64(left_out + 1), (n, len(number)))
        for place in range(CHUNK):
            if place != left_out:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + chunks[:, :, place])
        out.append(key)
    return np.concatenate(out, axis=1)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = shingle_sets(*packed(batch.column("_text")), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                ["_id", "_key", "n", "digest", "sig"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


def first_slots(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The first key that signature ``ours`` shares with each row of ``theirs``."""
    same = (theirs == ours).reshape(len(theirs), PLACES // CHUNK, CHUNK)
    differ = CHUNK - same.sum(axis=2)
    chunk = np.argmax(differ <= 1, axis=1)
    rows = np.arange(len(theirs))
    left_out = np.where(differ[rows, chunk] == 0, 0, np.argmin(same[rows, chunk], axis=1))
    return left_out * (PLACES // CHUNK) + chunk


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = chunk_keys(_matrix(batch.column("sig"))).view(np.int64)
        times = keys.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.reshape(-1)),
                pa.array(np.repeat(batch.column("rep").to_numpy(), times)),
                pa.array(np.tile(np.arange(times, dtype=np.int32), len(keys))),
            ],
            ["key", "rep", "slot"],
        )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those whose key has more than one.

    Rows of the first and the last key of the partition are all kept, since
    these keys may go on in the neighbouring partitions.
    """
    first_key, held = None, None  # the last row so far, if it stands alone
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        if first_key is None:
            first_key = last_key = key[0]
        same = key[1:] == key[:-1]
        several = np.r_[False, same] | np.r_[same, False] | (key == first_key) | (key == last_key)
        if held is not None:
            several[0] = key[0] == key[-1] or bool(same[0]) if len(same) else False
        held = None if several[-1] else batch.slice(len(key) - 1)
        last_key = key[-1] if several[-1] else None
        out = batch.filter(pa.array(several))
        if out.num_rows:
            yield out
    if held is not None:
        yield held


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "_text"):
        texts = batch.column("_text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_key"), pa.array([squeeze.compress(t) for t in texts], pa.binary())],
            ["_id", "_key", "packed"],
        )


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) < len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _check(k: int, percent: int):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        memo: dict[bytes, np.ndarray] = {}

        def shingles(text: bytes) -> np.ndarray:
            if text not in memo:
                if len(memo) >= 64:
                    memo.clear()
                raw = np.frombuffer(grow.decompress(text), np.uint8)
                memo[text] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
            return memo[text]

        for batch in batches:
            good = []
            for left, right in zip(
                batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True
            ):
                good.append(_similar(shingles(left), shingles(right), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Linked:
    """Which components the links found in this task have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def _finish(k: int, percent: int):
    """Links between components, cell by cell; rows come sorted by cell.

    In each cell the rows of the largest component are compared with the others
    only. A pair is looked at in the cell of the first key it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow, linked = zstandard.ZstdDecompressor(), _Linked()
        held: list[pa.RecordBatch] = []

        def links(root, rep, n, side, slot, sig, texts) -> Iterator[tuple[int, int]]:
            values, counts = np.unique(root, return_counts=True)
            largest = values[np.argmax(counts)]
            sets: dict[int, np.ndarray] = {}

            def shingles(i: int) -> np.ndarray:
                if i not in sets:
                    raw = np.frombuffer(grow.decompress(texts[i].as_py()), np.uint8)
                    sets[i] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                return sets[i]

            done = root == largest
            todo = ~done
            for i in np.flatnonzero(todo):
                todo[i] = False
                fits = (done | todo) & (root != root[i])
                fits &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
                fits &= (side != side[i]) | (side == 2)
                others = np.flatnonzero(fits)
                if not len(others):
                    continue
                far = (sig[others] != sig[i]).sum(axis=1)
                near = far <= DISTANCE
                others, far = others[near], far[near]
                mine = first_slots(sig[i], sig[others]) == slot
                for j in others[mine][np.argsort(far[mine], kind="stable")]:
                    x, y = linked.top(int(root[i])), linked.top(int(root[j]))
                    if x != y and _similar(shingles(i), shingles(j), percent):
                        linked.join(x, y)
                        yield int(rep[i]), int(rep[j])

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            table = table.combine_chunks()
            cell = table.column("cell").to_numpy()
            root, rep, n, side, slot = (
                table.column(c).to_numpy() for c in ("root", "rep", "n", "side", "slot")
            )
            sig = _matrix(table.column("sig").combine_chunks())
            texts = table.column("packed").combine_chunks()
            begins = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (slot[1:] != slot[:-1])])
            found = []
            for lo, hi in zip(begins, [*begins[1:], len(cell)], strict=True):
                s = slice(lo, hi)
                if (root[s] != root[lo]).any():
                    found += links(root[s], rep[s], n[s], side[s], slot[lo], sig[s], texts[lo:hi])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            at = int(np.searchsorted(cell, cell[-1], "left"))
            if at == 0 and held and held[-1].column("cell")[0].as_py() == cell[0]:
                held.append(batch)
                continue
            yield from whole(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        if held:
            yield from whole(pa.Table.from_batches(held))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("packed").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("packed").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        _check(k, percent), "a bigint, b bigint"
    )


def _near(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _numbered(first: DataFrame, ws: Workspace) -> DataFrame:
    """Add ``rep``, the node of each digest: its id, or if several digests have that
    id, a number above all ids for all but one, so that each text is compared.
    """
    several = first.groupBy("id").agg(F.count("*").alias("c"), F.min("key").alias("least"))
    more = first.join(several.where("c > 1"), "id").where("key != least").select("digest", "id")
    top = first.agg(F.max("id")).first()[0] or 0
    more = ws.save(
        more.select("digest", (F.lit(top) + 1 + F.monotonically_increasing_id()).alias("rep")), "more"
    )
    return first.join(more, "digest", "left").select(
        "digest", "id", "key", F.coalesce("rep", "id").alias("rep")
    )


def near_duplicates(
    docs: DataFrame,
    ws: Workspace,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_id, _key, n_shingles, component, kept`` of each row of ``docs``."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("bigint"))
    described = ws.save(
        rows.mapInArrow(
            _describe(shingle), "_id bigint, _key bigint, n bigint, digest binary, sig binary"
        ),
        "described",
    )
    able = described.where((F.col("n") > 0) & F.col("_id").isNotNull())
    first = able.groupBy("digest").agg(F.min(F.struct("_id", "_key")).alias("f"))
    first = ws.save(first.select("digest", F.col("f._id").alias("id"), F.col("f._key").alias("key")), "first")
    first = ws.save(_numbered(first, ws), "numbered")
    # One row per representative; rows that share an id meet again by ``copies``.
    own = described.join(
        first.select("digest", "rep", F.col("id").alias("_rid"), "key"), "digest"
    ).where((F.col("_id") == F.col("_rid")) & (F.col("_key") == F.col("key")))
    reps = ws.save(own.groupBy("rep", "_id", "key", "n").agg(F.min("sig").alias("sig")), "reps")
    copies = able.join(first.select("digest", "rep"), "digest").where("_id != rep").select(
        F.col("rep").alias("a"), F.col("_id").alias("b")
    )

    keys = reps.select("rep", "sig").mapInArrow(_index, "key bigint, rep bigint, slot int")
    buckets = ws.save(
        keys.repartitionByRange(width, "key", "rep")
        .sortWithinPartitions("key", "rep")
        .mapInArrow(_buckets, "key bigint, rep bigint, slot int"),
        "buckets",
    )
    sizes = ws.save(
        buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "sizes"
    )
    company = (
        buckets.join(sizes, "key").groupBy("rep").agg(F.sum("members").alias("company"))
        .join(reps.select("rep", "n"), "rep")
    )
    company = ws.save(company, "company")
    several = ws.save(
        buckets.select("key", "rep").join(company, "rep"), "several"
    )
    lead = several.groupBy("key").agg(F.max(F.struct("company", "rep", "n")).alias("l"))
    lead = ws.save(
        lead.select("key", F.col("l.rep").alias("leader"), F.col("l.n").alias("m")), "leaders"
    )
    best = (
        several.join(lead, "key")
        .where(F.col("rep") != F.col("leader"))
        .where(_near(F.col("n"), F.col("m"), percent))
        .groupBy("rep", "leader")
        .agg(F.count("*").alias("shared"))
        .groupBy("rep")
        .agg(F.max(F.struct("shared", "leader")).alias("s"))
        .select(F.col("s.leader").alias("a"), F.col("rep").alias("b"))
    )
    best = ws.save(best, "best")

    needed = company.select("rep").join(
        reps.select("rep", F.col("_id").alias("_rid"), "key"), "rep"
    )
    texts = rows.where(F.col("_text").isNotNull() & F.col("_id").isNotNull()).mapInArrow(
        _pack_texts, "_id bigint, _key bigint, packed binary"
    )
    sets = ws.save(
        texts.join(needed, (F.col("_id") == F.col("_rid")) & (F.col("_key") == F.col("key")))
        .dropDuplicates(["rep"])
        .select("rep", "packed"),
        "sets",
    )
    links = ws.save(_verified(best, sets, shingle, percent), "links")
    roots = ws.save(components(links, ws, "stars"), "roots")

    placed = ws.save(
        buckets.join(roots, F.col("rep") == F.col("node"), "left")
        .select("key", "slot", "rep", F.coalesce("root", "rep").alias("root")),
        "placed",
    )
    open_keys = ws.save(
        placed.groupBy("key")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"))
        .where("lo != hi")
        .select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")),
        "open_keys",
    )
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = (
        placed.join(open_keys, "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
            "slot",
            "rep",
            "root",
            F.when(F.col("block") == F.col("other"), 2)
            .when(F.col("block") < F.col("other"), 0)
            .otherwise(1)
            .alias("side"),
        )
        .join(reps.select("rep", "n", "sig").join(sets, "rep"), "rep")
    )
    late = ws.save(
        cells.repartition(width, "cell")
        .sortWithinPartitions("cell", "slot")
        .mapInArrow(_finish(shingle, percent), "a bigint, b bigint"),
        "late",
    )
    whole = components(
        links.unionByName(late).unionByName(copies), ws, "all"
    ).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    component = F.coalesce("_root", "_id")
    return described.join(whole, F.col("_id") == F.col("_node"), "left").select(
        "_id",
        "_key",
        F.col("n").alias("n_shingles"),
        component.alias("component"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id."""
    judged = near_duplicates(docs, ws, **options)
    gone = judged.where("not kept").select(F.col("_id").alias("_gone")).distinct()
    rows = with_rest(docs)
    return rows_back(rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti"), docs)
