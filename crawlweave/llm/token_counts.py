"""Token counts through a digest cache.

Counts are stored under two digests: that of the content and that of the
tokenizer's version. Rows join the cache on both; only contents that are not
there are encoded, each once, and their counts are appended. Copies collapse
inside each task before anything moves, so a text that a third of all rows hold
reaches its task once per batch, compressed.

Encoding inside a task: the tokenizer's own splitting always breaks between a
visible character and a following space or line feed, so a text is cut there,
and the count of each piece is remembered while the task lives (``MEMO`` pieces,
then it begins anew: only speed depends on it). A text with any other white
space is given to the tokenizer whole.

Defined cases: a null text counts as the empty text; special strings in a text
are handled as the tokenizer does by default; rows keep their number, repeated
ones included; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.rows import slices
from crawlweave.workspace import Workspace

MEMO = 400_000
CACHE = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("tokenizer", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)

_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def content_digest(text: Column) -> Column:
    """SHA-256 of the bytes; the tokenizers counted here do not normalise further."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def tokenizer_version(path: str) -> tuple[bytes, str]:
    """The tokenizer file's bytes, and the digest of these with the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        data = f.read()
    return data, hashlib.sha256(data + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Exact token counts of texts, remembering pieces."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode("utf-8"))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        parts = re.findall(r'"type":\s*"(\w+)"', model.decode("utf-8"))
        self.by_piece = self.tokenizer.normalizer is None and "ByteLevel" in parts
        self.memo: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        out = []
        for lo in range(0, len(texts), 512):
            part = self.tokenizer.encode_batch_fast(texts[lo : lo + 512], add_special_tokens=False)
            out.extend(len(e) for e in part)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Remember ``pieces``, taking a line feed in front and a mark at the end apart."""
        memo = self.memo
        split, cores = [], set()
        for piece in pieces:
            core, extra = piece, []
            if len(core) > 1 and core[0] == "\n" and core[1] not in " \n":
                extra.append("\n")
                core = core[1:]
            if len(core) > 2 and core[-1] in ".," and core[-2].isascii() and core[-2].isalpha():
                extra.append(core[-1])
                core = core[:-1]
            split.append((piece, core, extra))
            cores.update([core, *extra])
        new = [c for c in cores if c not in memo]
        memo.update(zip(new, self.encode(new), strict=True))
        for piece, core, extra in split:
            memo[piece] = memo[core] + sum(memo[e] for e in extra)

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        if len(self.memo) > MEMO:
            self.memo = {}
        whole = [i for i, t in enumerate(texts) if not self.by_piece or _OTHER_SPACE.search(t)]
        by_whole = dict(zip(whole, self.encode([texts[i] for i in whole]), strict=True))
        for i, text in enumerate(texts):
            if i in by_whole:
                out.append(by_whole[i])
                continue
            pieces = _PIECE.findall(text)
            try:
                out.append(sum(map(self.memo.__getitem__, pieces)))
            except KeyError:
                self._learn({p for p in pieces if p not in self.memo})
                out.append(sum(map(self.memo.__getitem__, pieces)))
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed text per digest and batch."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        first = list({d: i for i, d in reversed(list(enumerate(digests)))}.values())
        texts = batch.column("_text").take(pa.array(first, pa.int64())).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([digests[i] for i in first], pa.binary()),
                pa.array([squeeze.compress((t or "").encode()) for t in texts], pa.binary()),
            ],
            ["digest", "packed"],
        )


def _encode(model: bytes, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = Counter(model), set()
        grow = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 1 << 20):
            fresh = {}
            for digest, text in zip(
                batch.column("digest").to_pylist(), batch.column("packed").to_pylist(), strict=True
            ):
                if digest not in seen and digest not in fresh:
                    fresh[digest] = grow.decompress(text).decode("utf-8")
            seen.update(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(fresh), pa.binary()),
                    pa.array([version] * len(fresh), pa.string()),
                    pa.array(counter.counts(list(fresh.values())), pa.int64()),
                ],
                ["digest", "tokenizer", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame,
    ws: Workspace,
    tokenizer_path: str,
    cache: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_id, n_bytes, n_tokens`` of each row.

    ``cache`` is a Parquet folder of earlier counts, kept in ``ws`` when not
    given. It holds a row per content and tokenizer version, or several equal ones
    where jobs that ran side by side met the same content.
    """
    spark = docs.sparkSession
    model, version = tokenizer_version(tokenizer_path)
    cache = cache or ws.path("token_cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)

    rows = docs.select(
        F.col(id_col).alias("_id"),
        content_digest(F.col(text_col)).alias("digest"),
        F.col(text_col).alias("_text"),
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = T.StructType([CACHE["digest"], T.StructField("packed", T.BinaryType())])
    (
        rows.select("digest", "_text")
        .join(stored().select("digest"), "digest", "left_anti")
        .mapInArrow(_pack, packed)
        .repartition(width, "digest")
        .mapInArrow(_encode(model, version), CACHE)
        .write.mode("append")
        .parquet(cache)
    )
    n_bytes = F.coalesce(F.octet_length(F.col("_text")), F.lit(0)).cast("bigint")
    sized = rows.select("_id", "digest", n_bytes.alias("n_bytes"))
    # Two jobs may have appended the same content; their counts are equal.
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return sized.join(counts, "digest").select(
        "_id", "n_bytes", "n_tokens"
    )
