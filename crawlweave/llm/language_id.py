"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF values of character n-grams (one to three characters around
each letter, lower-cased, everything but letters read as a space), hashed to
``SPACE`` places. TF is the share of a text's n-grams, IDF comes from document
counts over all documents that may be learned from. Weights are trained with
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties): the
training rows lie in ``SHARDS`` fixed shards, every epoch trains each shard in
its own task from the common state, and the states are averaged. The
probabilities are then calibrated by one temperature on rows kept apart.

Training reads a sample: about ``PER_CLASS`` rows per language for the weights
and a quarter as many for the temperature, picked by hash. The model is bounded
by ``SPACE`` times the number of languages. Predictions and document counts
cover every row and whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as
is every text when there is nothing to learn from; rows without a language
teach nothing; ties go to the language that sorts first; a null id is not held
out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.rows import row_key, rows_back, slices, with_rest
from crawlweave.workspace import Workspace

SPACE = 1 << 16
ORDERS = 3
PER_CLASS = 2000
SHARDS = 4
EPOCHS = 3
UNKNOWN = "und"


@dataclass(frozen=True)
class Penalty:
    """FTRL settings: step size, its smoothing, L1 and L2."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 8.0


@dataclass
class Model:
    """What a prediction needs; ``weights`` have IDF and temperature worked in."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SPACE, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams, one row per letter, and the first row of each text."""
    lowered = [t.lower() for t in texts]
    joined = "\0" + "\0".join(lowered) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    at = np.flatnonzero(letter)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    first = np.searchsorted(at, np.concatenate([[0], ends]) + 1 - 1)
    a, b, c = code[at - 1], code[at], code[at + 1]
    one = b * np.uint32(2654435761)
    two = (b * np.uint32(40503) + c + np.uint32(0x10000000)) * np.uint32(2246822519)
    three = ((a * np.uint32(40503) + b) * np.uint32(65599) + c + np.uint32(0x20000000)) * np.uint32(3266489917)
    out = np.stack([one, two, three], axis=1)
    return ((out ^ (out >> np.uint32(15))) & np.uint32(SPACE - 1)).astype(np.int64), first.astype(np.int64)


def _texts(batch: pa.RecordBatch, column: str = "_text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, seen = np.zeros(SPACE, np.int64), np.zeros(SPACE, bool)
    for batch in slices(batches, "_text", 4 << 20):
        grams, first = ngrams(_texts(batch))
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            seen[grams[lo:hi].reshape(-1)] = True
            counts += seen
            seen[:] = False
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse term frequencies of the sample."""
    for batch in slices(batches, "_text", 4 << 20):
        grams, first = ngrams(_texts(batch))
        at, tf = [], []
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            places, counts = np.unique(grams[lo:hi], return_counts=True)
            at.append(places.astype(np.int32).tobytes())
            tf.append((counts / max(1, counts.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("pick", "lang", "part")], pa.array(at, pa.binary()), pa.array(tf, pa.binary())],
            ["pick", "lang", "part", "at", "tf"],
        )


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """The state of one learner; row ``SPACE`` is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray, penalty: Penalty):
        self.z, self.n, self.p = z, n, penalty

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        step = softmax(x @ w)
        step[label] -= 1
        g = x[:, None] * step[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _rows(batch: pa.RecordBatch, idf: np.ndarray, scale: float):
    for at, tf in zip(batch.column("at").to_pylist(), batch.column("tf").to_pylist(), strict=True):
        places = np.frombuffer(at, np.int32)
        x = np.frombuffer(tf, np.float32).astype(np.float64) * idf[places] * scale
        yield np.append(places, SPACE), np.append(x, 1.0)


def _train(z: np.ndarray, n: np.ndarray, idf: np.ndarray, languages: list[str], penalty: Penalty):
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Ftrl(z.copy(), n.copy(), penalty), 0
        for batch in batches:
            labels = batch.column("lang").to_pylist()
            for (at, x), label in zip(_rows(batch, idf, penalty.scale), labels, strict=True):
                learner.learn(at, x, number[label])
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([learner.z.tobytes()], pa.binary()),
                    pa.array([learner.n.tobytes()], pa.binary()),
                ],
                ["z", "n"],
            )

    return run


def _logits(weights: np.ndarray, idf: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x @ weights[at]).tobytes() for at, x in _rows(batch, idf, scale)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(out, pa.binary())], ["lang", "logits"]
            )

    return run


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(
    docs: DataFrame,
    learn: Column,
    ws: Workspace,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_class: int = PER_CLASS,
    penalty: Penalty = Penalty(),
) -> Model:
    """Train on the rows of ``docs`` for which ``learn`` holds and a language is given."""
    named = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model()
    total = sum(sizes.values())
    texts = named.select(F.col(text_col).alias("_text"))
    counts = np.zeros(SPACE)
    for gram, n in (
        texts.mapInArrow(_document_counts, "gram bigint, n bigint")
        .groupBy("gram").agg(F.sum("n").alias("n")).collect()
    ):
        counts[gram] = n
    idf = np.log((1 + total) / (1 + counts)) + 1

    key = F.xxhash64(row_key(id_col, text_col), F.lit("sample"))
    chance = F.lit(0.0)
    for lang, n in sizes.items():
        chance = F.when(F.col(lang_col) == lang, min(1.0, per_class * 1.25 / n)).otherwise(chance)
    sample = named.select(
        key.alias("pick"),
        F.col(lang_col).alias("lang"),
        F.pmod(F.xxhash64(key), F.lit(5)).cast("int").alias("part"),
        chance.alias("chance"),
        F.col(text_col).alias("_text"),
    ).where((F.pmod("pick", F.lit(1_000_003)) / 1_000_003) < F.col("chance"))
    vectors = ws.save(
        sample.drop("chance").mapInArrow(
            _vectors, "pick bigint, lang string, part int, at binary, tf binary"
        ),
        "vectors",
    )
    shape = (SPACE + 1, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    shards = ws.save(
        vectors.where("part > 0").withColumn("shard", F.pmod(F.xxhash64("pick"), F.lit(SHARDS))), "shards"
    ).repartition(SHARDS, "shard").sortWithinPartitions("pick", "lang", "at")
    for _ in range(EPOCHS):
        states = shards.mapInArrow(
            _train(z, n, idf, languages, penalty), "z binary, n binary"
        ).collect()
        if states:
            z = np.mean([np.frombuffer(s.z).reshape(shape) for s in states], axis=0)
            n = np.mean([np.frombuffer(s.n).reshape(shape) for s in states], axis=0)
    weights = Ftrl(z, n, penalty).weights()
    apart = vectors.where("part = 0").mapInArrow(
        _logits(weights, idf, penalty.scale), "lang string, logits binary"
    ).collect()
    number = {lang: i for i, lang in enumerate(languages)}
    t = temperature(
        np.array([np.frombuffer(r.logits) for r in apart]).reshape(len(apart), len(languages)),
        np.array([number[r.lang] for r in apart], int),
    )
    scaled = weights[:SPACE] * (idf * penalty.scale / t)[:, None]
    return Model(languages, scaled.astype(np.float32), weights[SPACE] / t)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            labels, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            grams, first = ngrams(_texts(batch))
            count = np.diff(first)
            some = np.flatnonzero(count)
            if len(some) and model.languages:
                per_letter = model.weights[grams[:, 0]]
                for order in range(1, ORDERS):
                    per_letter += model.weights[grams[:, order]]
                sums = np.add.reduceat(per_letter.astype(np.float64), first[some], axis=0)
                p = softmax(sums / (ORDERS * count[some])[:, None] + model.bias)
                for i, best in zip(some, p.argmax(axis=1), strict=True):
                    labels[i] = model.languages[best]
                scores[some] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores)],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return run


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to rows with ``_text``."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(_predict(model), T.StructType([*rows.schema.fields, *added]))


def held_out(id_col: str = "doc_id", of: int = 4, remainder: int = 2) -> Column:
    checksum = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(checksum, F.lit(of)) == remainder, F.lit(False))


def keep_identified(docs: DataFrame, ws: Workspace, min_score: float = 0.5) -> DataFrame:
    """``docs`` without those that no language, or none with ``min_score``, fits."""
    model = fit(docs, ~held_out(), ws)
    judged = predict(with_rest(docs), model)
    return rows_back(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), docs)
