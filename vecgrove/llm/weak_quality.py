"""Quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, poor or abstain on each whole text, or nothing where
it is too short for them.
Expectation-maximisation over the counts of vote patterns (at most 4^8 of them, counted over all
documents) estimates how each labeller votes on good and on poor documents, and so the posterior of
each pattern. A hashed linear scorer is then trained on posteriors as soft labels, from at most
``max_train`` documents picked by hash of the id (a documented bound), and scores every document from
features the labellers do not use directly: shares of word shapes, of their last characters and of shape
pairs, each binned by powers of two. Shares under ``MIN_SHARE`` are no features.

Texts are read once: votes and hashed features go to a compact table in the shared folder.

Defined results: null or empty text has no words; the first labeller votes poor and the others
abstain. Repeated rows get the same result. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import batched, hash_sample, stored, table

#: MISSING: the text is too short for the labeller to tell; it then says nothing, unlike an abstention.
GOOD, POOR, ABSTAIN, MISSING = "+", "-", "0", "?"
BITS = 16
KEEP = 0.5
#: Least share of a text's words that makes a feature.
MIN_SHARE = 0.004
_SHAPE = bytes(
    ord("X") if 65 <= i <= 90 else ord("x") if 97 <= i <= 122 or i >= 128 else ord("0") if 48 <= i <= 57 else i for i in range(256)
)
_SYMBOLS = b"#*$%&|<>"
_OTHER = bytes(set(range(256)) - set(_SYMBOLS))


#: Shapes of a plain word, runs of a character cut to two.
_PLAIN = re.compile(rb"[(\"']?(?:X?x{1,2}|X|0{1,2})(?:['-]X?x{1,2})*[.,;:?!)\"']{0,2}")


def votes(text: bytes, words: list[bytes], shapes: list[bytes]) -> str:
    """One sign per labeller.

    Plain words, symbols, stutter, variety of words, capitals, exclamation, stops, variety of word
    pairs. Those that look for one kind of junk only (symbols, stutter, capitals, exclamation) never
    vote good.
    """
    n = len(words)
    if not n:
        return POOR + ABSTAIN * 7
    kinds = Counter(shapes)

    def high(x: float, good_from: float, poor_upto: float) -> str:
        return GOOD if x >= good_from else POOR if x <= poor_upto else ABSTAIN

    def junk(x: float, poor_from: float) -> str:
        return POOR if x >= poor_from else ABSTAIN

    step = 1 + n // 2000  # variety falls with length: long texts are judged on windows of about 2000 words
    windows = [words[i * n // step : (i + 1) * n // step] for i in range(step)]
    some = sum(len(set(w)) / len(w) for w in windows) / step
    pairs = sum(len(set(zip(w, w[1:], strict=False))) / max(1, len(w) - 1) for w in windows) / step
    stops = sum(c for s, c in kinds.items() if s[-1:] in (b".", b",", b";")) / n
    return "".join(
        (
            high(sum(c for s, c in kinds.items() if _PLAIN.fullmatch(s)) / n, 0.85, 0.6),
            junk(len(text.translate(None, _OTHER)) / n, 0.2),
            junk(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 0.3),
            high(some, 0.4, 0.2) if n >= 40 else MISSING,
            junk(sum(c for s, c in kinds.items() if s[:2] == b"XX") / n, 0.4),
            junk(text.count(b"!!") / n, 0.2),
            GOOD if 0.03 <= stops <= 0.4 else MISSING if n < 25 else POOR if stops < 0.01 else ABSTAIN,
            high(pairs, 0.75, 0.25) if n >= 25 else MISSING,
        )
    )


_RUN = re.compile(rb"(.)\1{2,}", re.S)


def _squeeze(shape: bytes, known: dict[bytes, bytes]) -> bytes:
    """The shape with runs of a character cut to two."""
    out = known.get(shape)
    if out is None:
        out = _RUN.sub(rb"\1\1", shape)
        if len(shape) <= 64 and len(known) < 1 << 18:
            known[shape] = out
    return out


def features(shapes: list[bytes]) -> list[int]:
    """Hashed (shape, share bin) and (shape pair, share bin)."""
    n = max(1, len(shapes))
    out = {crc32(b"n%d" % min(12, n.bit_length())) % (1 << BITS)}
    ends = Counter(s[-1:] for s in shapes)
    for tag, counts in ((b"w", Counter(shapes)), (b"p", Counter(zip(shapes, shapes[1:], strict=False))), (b"e", ends)):
        for key, c in counts.items():
            share = c / n
            if share >= MIN_SHARE:
                level = int(-np.log2(share)) if share < 1 else 0
                k = b" ".join(key) if isinstance(key, tuple) else key
                out.add(crc32(tag + k + b":%d" % level) % (1 << BITS))
    return sorted(out)


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for b in batches:
            signs, xs = [], []
            for t in b.column(1):
                text = t.as_py() or b""
                words = text.split()
                shapes = [_squeeze(s, known) for s in text.translate(_SHAPE).split()]
                signs.append(votes(text, words, shapes))
                xs.append(np.array(features(shapes), "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signs, pa.string()), pa.array(xs, pa.binary())], ["id", "votes", "x"])

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("binary").alias("text"))
    return batched(picked).mapInArrow(run, "id bigint, votes string, x binary")


def em(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good per vote pattern; P(vote | good or poor) per labeller, vote in the order + - 0."""
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2, 3))
    v = np.array([["+-0?".index(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    # start from the votes cast; a labeller that finds junk counts twice
    lead = (v == 0).sum(1) - 2 * (v == 1).sum(1)
    good = 1 / (1 + np.exp(-lead.astype(float)))
    rates = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        share = np.stack([n * good, n * (1 - good)])
        prior = share.sum(1) / n.sum()
        for j in range(v.shape[1]):
            for y in range(2):
                rates[j, y] = np.bincount(v[:, j], share[y], 4)[:3] + 0.5
        rates /= rates.sum(2, keepdims=True)
        log = np.log(np.clip(prior, 1e-6, None))[:, None] + sum(
            np.hstack([np.log(rates[j]), np.zeros((2, 1))])[:, v[:, j]] for j in range(v.shape[1])
        )
        good = 1 / (1 + np.exp(np.clip(log[1] - log[0], -35, 35)))
    return dict(zip(names, good.tolist(), strict=True)), rates


def train_scorer(rows: list[tuple[np.ndarray, float]], epochs: int = 4, rate: float = 0.2, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; the last weight is the bias."""
    w, g2 = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-2)
    for _ in range(epochs):
        for x, y in rows:
            at = np.append(x, 1 << BITS)
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(), -35, 35)))
            g = (p - y) / np.sqrt(len(at)) + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 8000) -> DataFrame:
    """id, votes, posterior, score, kept of every document."""
    spark = docs.sparkSession
    seen = stored(_described(docs, id_col, text_col), "weak-votes")
    counts = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = em(counts)
    sample = hash_sample(seen, "id", max_train).select("votes", "x").collect()
    rows = sorted({(bytes(r["x"]), posterior[r["votes"]]) for r in sample}, key=lambda r: (crc32(r[0]), r))
    w = train_scorer([(np.frombuffer(x, "<u2").astype(np.int64), y) for x, y in rows])
    sent = spark.sparkContext.broadcast((w.astype(np.float32), posterior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, post = sent.value
        for b in batches:
            s = np.array([weight[np.frombuffer(x.as_py(), "<u2")].sum(dtype=np.float64) + weight[-1] for x in b.column(2)])
            score = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            own = [post[v] for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= KEEP)],
                ["id", "votes", "posterior", "score", "kept"],
            )

    return seen.mapInArrow(run, "id bigint, votes string, posterior double, score double, kept boolean")


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its votes, posterior, score and verdict."""
    return weak_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
