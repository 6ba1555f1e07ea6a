"""Collocations by counting phrases in a HAT-trie.

Texts are cut into pieces at punctuation and line ends, pieces into words. Blocks of
about ``BLOCK`` bytes of text send each of their words once, with its number. One
shuffle brings a word's rows together, one per block that has it; windows over them
sum its occurrences, and where these reach ``min_count`` in its language, give it a
number, which goes back to the blocks. A rarer word is in no phrase that counts, so it
ends a run like a piece's end.

A block then counts, for every place, the run of up to ``longest`` words that begins
there, in a HAT-trie: a shallow trie over word numbers whose leaves are hash
containers of the words that follow; a container that grows beyond ``BURST`` entries
bursts into one per next word, and when the trie holds more than ``ENTRIES`` entries,
its largest subtrees are spilled whole, as sorted runs. The runs of all blocks are
range-partitioned by their words and merged: in a sorted partition the counts of all
prefixes are sums over neighbours. A prefix that touches an end of its partition may
go on next door; such prefixes, at most two per length and partition, are sent on
whatever their count, and one sum over what all partitions send settles them. So a
word that a third of all phrases begin with is spread over many partitions.

What is left, phrases of ``min_count`` occurrences, is scored with joins.

Defined cases: a null or empty text has no words; a null language is ``und``; rows
count as often as they occur; an empty table gives an empty table; other columns of
the table, whatever their names, are not looked at.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.ngram_lm import pack_numbers, unpack_numbers
from crawlweave.llm.rows import raw_texts, slices
from crawlweave.workspace import Workspace

MIN_COUNT = 100
LONGEST = 5
TOP = 2000

BLOCK = 16 << 20
BURST = 4096
ENTRIES = 1_000_000
FEED = 1 << 16  # places counted at once
BUCKETS = 1 << 16  # of words, by hash; a word's number is its bucket and its place in it
SAMPLE = 16  # one block in so many is counted beforehand to find the partitions' bounds

# What ends a piece, what ends a word, and lower case.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(_ENDS + b"\x09" + _UPPER, b"\n" * len(_ENDS) + b" " + _UPPER.lower())


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text, with a line feed where a piece ends."""
    return [w for w in text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ") if w]


class _Block:
    """Words of many texts as numbers of the block's own; 0 ends a piece."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.next = itertools.count(1)
        self.known: dict[str, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = []

    def add(self, lang: str, text: bytes) -> None:
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = defaultdict(self.next.__next__)
            known[b"\n"] = 0
        found = words_and_ends(text)
        self.parts.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
        self.parts.append(np.zeros(1, np.uint32))
        self.bytes += len(text)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row with the numbers of all words, then one per word."""
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream)
        columns: dict[str, list] = {"lang": [], "word": [], "at": []}
        for lang, known in self.known.items():
            del known[b"\n"]
            columns["lang"] += [lang] * len(known)
            columns["word"] += known.keys()
            columns["at"] += known.values()
        at = np.array(columns["at"], np.int64)
        size = len(at)
        words = {
            "block": pa.array(np.full(size, self.number, np.int64)),
            "stream": pa.nulls(size, pa.binary()),
            "at": pa.array(at.astype(np.int32)),
            "lang": pa.array(columns["lang"], pa.string()),
            "word": pa.array(columns["word"], pa.binary()).cast(pa.string()),
            "n": pa.array(counts[at].astype(np.int64) if size else at),
        }
        first = {"block": pa.array([self.number], pa.int64()), "stream": pa.array([pack_numbers(stream)], pa.binary())}
        yield pa.RecordBatch.from_arrays([first.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
        yield pa.RecordBatch.from_arrays([words[f.name] for f in schema], schema=schema)


_BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("stream", T.BinaryType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("block", pa.int64()), ("stream", pa.binary()), ("at", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]
    )
    number = TaskContext.get().partitionId() << 32
    block = _Block(number)
    for batch in slices(batches, "_text", 1 << 20):
        for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("_text")), strict=True):
            block.add(lang, text)
        if block.bytes >= BLOCK:
            yield from block.rows(schema)
            number += 1
            block = _Block(number)
    if block.parts:
        yield from block.rows(schema)


_key = itemgetter(0)


def _cells(words: np.ndarray) -> list[bytes]:
    """The rows of a matrix, each as bytes."""
    width = words.shape[1] * words.itemsize
    return np.ascontiguousarray(words).view(f"V{width}").ravel().tolist() if width else [b""] * len(words)


class HatTrie:
    """Counts of word runs: first word, then a container, or containers by second word.

    A run is its words as big-endian 32-bit numbers, 0 behind a shorter run's end, so
    that runs sort as bytes.
    """

    def __init__(self, longest: int, burst: int = BURST, entries: int = ENTRIES):
        self.width, self.burst, self.most = 4 * longest, burst, entries
        self.leaves: dict[bytes, Counter] = {}  # by first word
        self.inner: dict[bytes, dict[bytes, dict]] = {}  # by first word, then second
        self.size = 0
        self.spilled: list[tuple[bytes, np.ndarray]] = []

    def add(self, runs: np.ndarray) -> None:
        """Count the rows of ``runs``, word numbers as unsigned 32-bit integers."""
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        data = runs.astype(">u4")
        seconds, rests, ends = (_cells(data[:, x]) for x in np.s_[1:2, 1:, 2:])
        begins = np.flatnonzero(np.diff(runs[:, 0].astype(np.int64), prepend=-1))
        for first, lo, hi in zip(_cells(data[begins, :1]), begins.tolist(), [*begins[1:].tolist(), len(runs)], strict=True):
            children = self.inner.get(first)
            if children is None:
                leaf = self.leaves.get(first)
                if leaf is None:
                    leaf = self.leaves[first] = Counter()
                before = len(leaf)
                leaf.update(rests[lo:hi])
                self.size += len(leaf) - before
                if len(leaf) > self.burst:
                    children = self.inner[first] = {}
                    for rest, n in self.leaves.pop(first).items():
                        children.setdefault(rest[:4], {})[rest[4:]] = n
                continue
            for second, end in zip(seconds[lo:hi], ends[lo:hi], strict=True):
                leaf = children.get(second)
                if leaf is None:
                    leaf = children[second] = {}
                n = leaf.get(end, 0)
                leaf[end] = n + 1
                self.size += not n
        if self.size > self.most:
            self._spill(self.most // 2)

    def _spill(self, leave: int) -> None:
        """Turn whole subtrees into sorted runs, the largest first, until ``leave`` entries stay."""
        sizes = [(len(leaf), first) for first, leaf in self.leaves.items()]
        sizes += [(sum(map(len, children.values())), first) for first, children in self.inner.items()]
        for size, first in sorted(sizes, reverse=True):
            if self.size <= leave:
                break
            if first in self.leaves:
                parts = [(first, self.leaves.pop(first))]
            else:
                parts = [(first + second, leaf) for second, leaf in sorted(self.inner.pop(first).items(), key=_key)]
            keys, counts = [], []
            for prefix, leaf in parts:
                ends = sorted(leaf)
                keys += prefix, prefix.join(ends)  # each end behind the words before it
                counts += map(leaf.__getitem__, ends)
            self.spilled.append((b"".join(keys), np.array(counts, np.int64)))
            self.size -= size

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """All runs counted, sorted within each subtree, and their counts."""
        self._spill(0)
        data = b"".join(keys for keys, _ in self.spilled)
        counts = [n for _, n in self.spilled]
        return (
            np.frombuffer(data, ">u4").reshape(-1, self.width // 4),
            np.concatenate(counts) if counts else np.zeros(0, np.int64),
        )


def _packed(rows: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Runs and counts two numbers to a column, in the order of the runs."""
    halves = [*rows.T, *[np.zeros(len(rows), np.int64)] * ((rows.shape[1] + 1) % 2), counts]
    return [a.astype(np.int64) << 32 | b.astype(np.int64) for a, b in zip(halves[::2], halves[1::2], strict=True)]


def _unpacked(columns: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    halves = [h for c in columns for h in (c >> 32, c & 0xFFFFFFFF)]
    return np.stack(halves[:longest], axis=1), halves[-1]


def _columns(longest: int) -> list[str]:
    return [f"c{i}" for i in range((longest + 2) // 2)]


def _block_runs(longest: int, streams: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a block in the words' numbers, and their counts."""
    trie = HatTrie(longest)
    for stream in streams.column("stream").to_pylist():
        local = unpack_numbers(stream, np.uint32)
        number = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
        number[answers.column("at").to_numpy()] = answers.column("id").to_numpy()
        words = np.concatenate([number[local], np.zeros(longest, np.uint32)])
        begins = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        for lo in range(0, len(begins), FEED):
            rows = words[begins[lo : lo + FEED, None] + np.arange(longest)]
            rows[np.cumsum(rows == 0, axis=1) > 0] = 0
            trie.add(rows)
    return trie.runs()


def _count_runs(longest: int, bounds: list[tuple]):
    """Packed runs of a block, with the partition that their words belong to."""
    names = _columns(longest)
    heads = np.array([b[0] for b in bounds], np.int64)

    def run(streams: pa.Table, answers: pa.Table) -> pa.Table:
        packed = _packed(*_block_runs(longest, streams, answers))
        part = np.searchsorted(heads, packed[0], "left")
        ties = np.flatnonzero(np.searchsorted(heads, packed[0], "right") > part)
        # The count must not tell equal runs apart, so a bound's own is 0.
        bare = [c[ties] for c in packed[:-1]] + [packed[-1][ties] & ~0xFFFFFFFF]
        part[ties] = [bisect_right(bounds, r) for r in zip(*(c.tolist() for c in bare), strict=True)]
        made = pa.table([*map(pa.array, packed), pa.array(part.astype(np.int32))], names=[*names, "part"])
        return pa.Table.from_batches(made.to_batches(FEED), made.schema)  # sent batch by batch

    return run


def _merge(longest: int, min_count: int):
    """Counts of all prefixes of two words and more in a sorted partition.

    Those that reach ``min_count``, and those at the partition's two ends.
    """
    names = [f"w{i}" for i in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[tuple, int] | None] = [None] * (longest + 1)  # by length
        at_start = [True] * (longest + 1)

        def emit(k: int, prefixes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            full = np.zeros((len(prefixes), longest), np.int32)
            full[:, :k] = prefixes
            return pa.RecordBatch.from_arrays(
                [*(pa.array(full[:, i]) for i in range(longest)), pa.array(counts)], [*names, "n"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, n = _unpacked([batch.column(c).to_numpy() for c in _columns(longest)], longest)
            new = np.zeros(len(rows), bool)
            new[0] = True
            new[1:] = rows[1:, 0] != rows[:-1, 0]
            for k in range(2, longest + 1):
                new[1:] |= rows[1:, k - 1] != rows[:-1, k - 1]
                begins = np.flatnonzero(new)
                sums = np.add.reduceat(n, begins)
                prefixes = rows[begins, :k]
                last = open_[k]
                if last is not None:
                    if last[0] == tuple(prefixes[0].tolist()):
                        sums[0] += last[1]
                    else:
                        if last[0][-1] and (at_start[k] or last[1] >= min_count):
                            yield emit(k, np.array([last[0]], np.int32), np.array([last[1]], np.int64))
                        at_start[k] = False
                open_[k] = (tuple(prefixes[-1].tolist()), int(sums[-1]))
                closed = sums[:-1] >= min_count
                if len(closed):
                    closed[0] |= at_start[k]
                    at_start[k] = False
                keep = np.flatnonzero(closed & (prefixes[:-1, -1] > 0))
                if len(keep):
                    yield emit(k, prefixes[keep], sums[keep])
        for k in range(2, longest + 1):
            last = open_[k]
            if last is not None and last[0][-1]:
                yield emit(k, np.array([last[0]], np.int32), np.array([last[1]], np.int64))

    return run


def common_words(held: DataFrame, min_count: int) -> DataFrame:
    """``block, at, lang, word, n, id`` of the words of ``min_count`` occurrences or more.

    ``held`` has a row for each block and word. The rows stay those of ``held``, so
    there are never more; ``n`` is the word's sum over all blocks, and ``id`` its number
    from 1, small as long as words are few.
    """
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS))
    place = F.dense_rank().over(W.partitionBy("bucket").orderBy("lang", "word")).cast("bigint") - 1
    return (
        held.withColumn("bucket", bucket)
        .repartition("bucket")  # serves both windows
        .withColumn("n", F.sum("n").over(W.partitionBy("bucket", "lang", "word")))
        .where(F.col("n") >= min_count)
        # An error beyond 2**15 words of a bucket, about 2**31 words in all.
        .withColumn("id", (place * BUCKETS + F.col("bucket") + 1).cast("int"))
        .drop("bucket")
    )


def phrase_counts(
    docs: DataFrame,
    ws: Workspace,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    lang_col: str = "lang",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ids, n`` of the phrases, ``id, lang, word, n`` of the words and ``lang, total``.

    Phrases and words are those of ``min_count`` occurrences or more, phrases those
    of two to ``longest`` words; the total counts all words.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("_text"))
    blocks = ws.save(rows.mapInArrow(_read, _BLOCKS), "blocks")
    held = blocks.where("at is not null").select("block", "at", "lang", "word", "n")
    totals = ws.save(held.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    # Written once: the sample of blocks and all blocks are both answered from it.
    common = ws.save(common_words(held, min_count), "common")
    words = ws.save(common.select("id", "lang", "word", "n").distinct(), "words")

    answers = common.select(F.col("block").alias("asker"), "at", "id")
    streams = blocks.where("stream is not null").select("block", "stream")
    names, columns = [f"w{i}" for i in range(longest)], _columns(longest)
    packed = T.StructType([*[T.StructField(c, T.LongType()) for c in columns], T.StructField("part", T.IntegerType())])
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(of: DataFrame, asked: DataFrame, bounds: list[tuple]) -> DataFrame:
        both = of.groupBy("block").cogroup(asked.groupBy("asker"))
        return both.applyInArrow(_count_runs(longest, bounds), packed)

    # Bounds of the partitions, one entry each, from a sample of blocks: only the
    # balance of partitions depends on them, and the runs need not be written first.
    some = streams.select("block").orderBy(F.xxhash64("block")).limit(max(1, streams.count() // SAMPLE))
    some = ws.save(some, "sampled")
    bare = [*columns[:-1], (F.col(columns[-1]).bitwiseAND(F.lit(-1 << 32))).alias(columns[-1])]
    begins = (
        counted(streams.join(some, "block"), answers.join(some.withColumnRenamed("block", "asker"), "asker"), [])
        .select(*bare)
        .repartitionByRange(width, *columns)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(F.struct(*columns)).alias("at"))
        .collect()
    )
    bounds = sorted(tuple(r["at"]) for r in begins)[1:]
    runs_of = T.StructType([*[T.StructField(c, T.IntegerType()) for c in names], T.StructField("n", T.LongType())])
    merged = (
        counted(streams, answers, bounds)
        .repartitionById(width, "part")
        .drop("part")
        .sortWithinPartitions(*columns)
        .mapInArrow(_merge(longest, min_count), runs_of)
        .groupBy(*names)
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
    )
    ids = F.filter(F.array(*names), lambda w: w > 0)
    return ws.save(merged.select(ids.alias("ids"), "n"), "phrases"), words, totals


def collocations(
    docs: DataFrame,
    ws: Workspace,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    A phrase's score is that of its weakest cut into two, 1000 times the number of
    its occurrences over the number that its two parts' own would let expect. One
    that has a longer one around it each time it occurs is left out.
    """
    phrases, words, totals = phrase_counts(docs, ws, min_count, longest, lang_col, text_col)
    key = F.array_join("ids", " ")
    every = phrases.select(key.alias("key"), "n").unionByName(words.select(F.col("id").cast("string").alias("key"), "n"))

    def part(begin, size, name):
        return F.array_join(F.slice("ids", begin, size), " ").alias(name)

    # A phrase that a longer one holds each time lies in one that is longer by one word.
    longer = phrases.where(F.size("ids") > 2)
    inner = longer.select(part(F.lit(1), F.size("ids") - 1, "key"), "n").unionByName(
        longer.select(part(F.lit(2), F.size("ids") - 1, "key"), "n")
    )
    around = inner.groupBy("key").agg(F.max("n").alias("around"))
    alone = ws.save(
        phrases.withColumn("key", key)
        .join(around, "key", "left")
        .where(F.col("around").isNull() | (F.col("around") < F.col("n")))
        .select("key", "ids", F.col("n").alias("a")),
        "alone",
    )
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1))).select(
        "key",
        "a",
        "k",
        F.element_at("ids", 1).alias("id"),
        part(F.lit(1), F.col("k"), "left"),
        part(F.col("k") + 1, F.size("ids") - F.col("k"), "right"),
    )
    scored = (
        cuts.join(every.select(F.col("key").alias("left"), F.col("n").alias("l")), "left")
        .join(every.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
        .join(words.select("id", "lang"), "id")
        .join(totals.withColumnRenamed("total", "n"), "lang")
    )
    exact = [f"CAST({c} AS DECIMAL(19,0))" for c in ("a", "n", "l", "r")]
    score = F.expr("CAST((1000 * {} * {}) DIV ({} * {}) AS BIGINT)".format(*exact))
    best = scored.groupBy("key", "lang", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    spelled = (
        alone.select("key", F.posexplode("ids").alias("pos", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("key")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.join(spelled, "key")
        .select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
