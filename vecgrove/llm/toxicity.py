r"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes (mod 2^bits) of its words, word pairs and pairs with one word left
out; each counts once. Words are runs of letters, digits and marks, lower-cased. Training follows
McMahan et al. (2013): per-coordinate learning rates, L1 and L2 terms, weights exist only where the
L1 term is overcome. The sparse weights are small and travel with the scoring function.

Training rows: labelled rows outside the held-out fold, at most ``max_train`` of them, taken by hash
of the id (a documented bound; at most ``max_train`` ids are broadcast to pick the texts). Features
are made on all executors; one task runs the sequential learner over them, in the order of the hash, and
holds ``max_bytes`` of features at most: a row that does not fit any more is left out (a second documented
bound, met by very long texts only). Every document is scored from its whole text.

Defined results: null or empty text has only the bias. Labels without a document, or null labels, are
ignored; several labels of a document count as toxic if one says so. Without any training row every
score is 0 (to within 1e-15). Bytes that are
no UTF-8 count as replacement characters. Repeated rows get the same score. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import batched, fold, hash_sample, kept, table

HELD_OUT = 2
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Words whose hash a worker remembers.
_CACHE_WORDS = 200_000


class Hasher:
    """Hashed features of texts, distinct and sorted."""

    def __init__(self, bits: int = 22):
        self.shift, self.known = np.uint64(64 - bits), {}

    def words(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        found = _TOKEN.findall(text.lower())
        for w in set(found):
            if w not in known:
                b = w.encode("utf-8", "surrogatepass")
                known[w] = (crc32(b) << 32 | crc32(b[::-1], 7)) or 1
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def __call__(self, text: str | None) -> np.ndarray:
        """All features with repeats, in no fixed order."""
        w = self.words(text or "")
        one, two, gap = _MIX
        parts = [w * one]
        if len(w) > 1:
            parts.append((w[:-1] * two ^ w[1:]) * one)
        if len(w) > 2:
            parts.append((w[:-2] * gap ^ w[2:]) * two)
        return (np.concatenate(parts) >> self.shift).astype(np.int32)


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


@dataclass
class Model:
    bits: int
    bias: float
    index: np.ndarray  # sorted features that have a weight
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def train_ftrl(
    rows: list[tuple[np.ndarray, int]],
    bits: int,
    alpha: float = 4.0,
    beta: float = 1.0,
    l1: float = 9.0,
    l2: float = 2.0,
    epochs: int = 4,
) -> Model:
    """Sequential FTRL-proximal over (distinct features, label). Defaults are those ``toxicity_choice`` finds."""
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    bz = bn = bias = 0.0

    def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for x, y in rows:
            w = solve(z[x], n[x])
            bias = -bz / ((beta + bn**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            rise = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - rise * w
            n[x] += g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * bias
            bn += g * g
    bias = -bz / ((beta + bn**0.5) / alpha)
    w = solve(z, n)
    index = np.flatnonzero(w)
    return Model(bits, float(bias), index.astype(np.int32), w[index].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 22, max_train: int = 12_000, max_bytes: int = 256 << 20) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    picked = (
        labels.select(labels[id_col].alias("id"), labels[label_col].alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL")
        .where(fold(F.col("id")) != HELD_OUT)
        .groupBy("id")
        .agg((F.max("label") > 0).cast("int").alias("label"))
    )
    picked = hash_sample(picked, "id", max_train)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(picked), "id").select("id", "text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = kept(f"toxicity {bits}", lambda: Hasher(bits))
        for b in batches:
            x = [np.unique(hashed(_text(t.as_py()))).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array(x, pa.binary())], ["id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, size = [], None, 0
        for b in batches:
            for i, label, x in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), strict=True):
                x = x.as_py()
                if (i, x) != last and size + len(x) <= max_bytes:  # repeated rows are one row
                    rows.append((np.frombuffer(x, np.int32), label))
                    size += len(x)
                last = (i, x)
        if rows:
            model = train_ftrl(rows, bits)
            columns = ([model.bias], [model.index.tobytes()], [model.weight.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.binary(), pa.binary()), strict=True)], ["bias", "at", "w"])

    # a fixed order that mixes the labels
    order = (F.crc32(F.col("id").cast("string")), "id", "x")
    made = (
        batched(texts).mapInArrow(features, "id bigint, label int, x binary")
        .repartition(1)
        .sortWithinPartitions(*order)
        .mapInArrow(learn, "bias double, at binary, w binary")
        .collect()
    )
    if not made:
        return Model(bits, -35.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
    m = made[0]
    return Model(bits, m["bias"], np.frombuffer(m["at"], np.int32), np.frombuffer(m["w"], np.float32))


def _scorer(sent: Broadcast) -> Callable[[pa.Array], np.ndarray]:
    own = Model(*sent.value)
    w, hashed = own.dense(), kept(f"toxicity {own.bits}", lambda: Hasher(own.bits))

    def run(texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts.cast(pa.binary())):
            x = hashed(_text(t.as_py()))
            x = np.unique(x[w[x] != 0])
            out[i] = own.bias + float(w[x].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.index, model.weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], ["id", "score"])

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return batched(picked).mapInArrow(run, "id bigint, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; each is judged where it is read, by its own text."""
    model = fit(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.index, model.weight))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(sent)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at)) < threshold))

    return batched(docs).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        "id",
        F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
