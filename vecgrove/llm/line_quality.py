r"""Quality rules by line labelling with a linear-chain conditional random field.

Each line with a word is described by binned features (length, symbols, capitals, repeated words,
punctuation, repetition of an earlier line). A two-label CRF - content or boilerplate - with a weight
per feature and label and a weight per label pair is trained by stochastic gradient ascent on the
log-likelihood (forward-backward). Every document is then decoded whole (Viterbi), and the share of its
words in content lines decides.

Labels are given by document, so lines with known labels are made: lines of good documents stand for
content, lines of poor ones for boilerplate, and ``SPLICED`` of the training sequences get a seeded run of
lines of a document of the other label at their start, their end or within. So the chain learns to change
its label inside a document. Training documents are labelled ones outside the held-out fold (crc32 of the
id mod 4), at most ``max_train`` of them, picked by hash of the id, each with at most ``max_lines`` lines in
a row from a seeded place (documented bounds).

Words are ``[^\x20\x09-\x0D]+``. Base figures: word_chars (code points in words), n_symbols
(characters of ``[#*$%&|<>]``), n_dup_lines (lines split at \n that have a word and equal an earlier
line), n_repeat_words (words in 3-word windows found twice or more in the text, first included),
base_failed (fewer than 50 words, or more than half of them repeated).

Defined results: null or empty text has no words, all figures 0, base_failed true, content_share 0.
Without labelled documents the weights are 0 and ties go to content, so the base rules decide alone.
Repeated rows get the same result. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import batched, fold, hash_sample, table

MIN_WORDS, MAX_REPEAT, MIN_CONTENT = 50, 0.5, 0.5
#: Fold of the ids that training leaves out, share of training sequences with lines of another document, most lines of those.
HELD_OUT, SPLICED, RUN = 2, 0.5, 8
_SYMBOLS = b"#*$%&|<>"
_OTHER = bytes(set(range(256)) - set(_SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _LETTER = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])
_NOT_UPPER, _NOT_LETTER = (bytes(set(range(256)) - set(k)) for k in (_UPPER, _LETTER))
_STOPS = re.compile(rb"[.,;:?](?:\s|$)")
_BANG = re.compile(rb"!!|\?\?")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    v = len(seen)
    if v < 1 << 20:
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # three ids do not fit one long: number the pairs first
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        code = pair[:-1] * v + ids[2:]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= hit
    return int(inside.sum())


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


#: Features: how many bins each has.
_BINS = (4, 4, 4, 4, 4, 3, 2, 3)
_AT = np.concatenate(([0], np.cumsum(_BINS)[:-1])).tolist()
N_FEATURES = sum(_BINS)


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """Indices of the features that are on, one of each group."""
    n, size = len(words), max(1, len(line))
    letters = len(line.translate(None, _NOT_LETTER))
    bins = (
        _bin(n, 4, 12, 40),
        _bin(len(line.translate(None, _OTHER)) / n, 0.02, 0.1, 0.3),
        _bin(len(line.translate(None, _NOT_UPPER)) / max(1, letters), 0.15, 0.4, 0.7),
        _bin(len(set(words)) / n, 0.25, 0.5, 0.8) if n >= 8 else 3,
        _bin(len(_STOPS.findall(line)) / n, 0.02, 0.1, 0.5),
        _bin(len(_BANG.findall(line)) / n, 0.02, 0.3),
        int(repeated),
        _bin(letters / size, 0.4, 0.65),
    )
    return [a + b for a, b in zip(_AT, bins, strict=True)]


def describe(text: bytes | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features and words per line."""
    text = text or b""
    words = text.split()
    chars = len(text.translate(None, _CONTINUATION + _SPACE))
    symbols, dup, seen, rows, sizes = len(text.translate(None, _OTHER)), 0, set(), [], []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            dup += again
            seen.add(line)
            rows.append(line_features(line, own, again))
            sizes.append(len(own))
    base = (len(words), chars, symbols, dup, repeat_words(words))
    return base, np.array(rows, np.int64).reshape(-1, len(_BINS)), np.array(sizes, np.int64)


# -- the chain --------------------------------------------------------------------------------


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels (0 boilerplate, 1 content) for scores (n, 2); ties go to content."""
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    (s00, s01), (s10, s11) = step.tolist()
    rows = scores.tolist()
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from0, from1 = (0, a + s00), (0, a + s01)
        if b + s10 >= a + s00:
            from0 = (1, b + s10)
        if b + s11 >= a + s01:
            from1 = (1, b + s11)
        back.append((from0[0], from1[0]))
        a, b = from0[1] + x, from1[1] + y
    out = np.empty(n, np.int64)
    out[-1] = label = int(b >= a)
    for i in range(n - 2, -1, -1):
        label = back[i][label]
        out[i] = label
    return out


def _log_add(a: np.ndarray) -> np.ndarray:
    top = a.max(0)
    return top + np.log(np.exp(a - top).sum(0))


def gradient(scores: np.ndarray, step: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, by forward-backward: observed minus expected, per row and label, per label pair."""
    n = len(scores)
    fore, aft = np.empty((n, 2)), np.zeros((n, 2))
    fore[0] = scores[0]
    for i in range(1, n):
        fore[i] = scores[i] + _log_add(fore[i - 1][:, None] + step)
    for i in range(n - 2, -1, -1):
        aft[i] = _log_add((step + scores[i + 1] + aft[i + 1]).T)
    z = _log_add(fore[-1])
    own = -np.exp(fore + aft - z)
    own[np.arange(n), y] += 1
    pair = np.zeros((2, 2))
    for i in range(1, n):
        pair -= np.exp(fore[i - 1][:, None] + step + scores[i] + aft[i] - z)
        pair[y[i - 1], y[i]] += 1
    return own, pair


def spliced(samples: list[tuple[np.ndarray, int]], share: float = SPLICED, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences with a label per line, from (line features, label of the document)."""
    rng = np.random.default_rng(seed)
    by = {label: [x for x, y in samples if y == label] for label in (0, 1)}
    out = []
    for x, y in samples:
        others = by[1 - y]
        if rng.random() >= share or not others:
            out.append((x, np.full(len(x), y)))
            continue
        other = others[rng.integers(len(others))]
        n = int(rng.integers(1, min(len(other), RUN) + 1))
        start = int(rng.integers(len(other) - n + 1))
        at = (0, len(x), int(rng.integers(len(x) + 1)))[rng.integers(3)]
        out.append((np.concatenate((x[:at], other[start : start + n], x[at:])), np.repeat([y, 1 - y, y], [at, n, len(x) - at])))
    return out


def train_crf(samples: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features, 2) and pair weights (2, 2) from (line features, line labels)."""
    w, step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len({int(k) for _, y in samples for k in (y.min(), y.max())}) < 2:
        return w, step
    for epoch in range(epochs):
        r = rate / (1 + epoch)
        for x, y in samples:
            own, pair = gradient(w[x].sum(1), step, y)
            k = r / len(x)
            np.add.at(w, x.ravel(), np.repeat(k * own, x.shape[1], axis=0))
            step += k * pair
            w *= 1 - r * l2
    return w, step


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = 3000,
    max_lines: int = 400,
) -> tuple[np.ndarray, np.ndarray]:
    picked = (
        labels.select(labels[id_col].alias("id"), labels[label_col].alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL")
        .where(fold(F.col("id")) != HELD_OUT)
        .groupBy("id")
        .agg((F.min("label") > 0).cast("int").alias("label"))
    )
    picked = hash_sample(picked, "id", max_train)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")).join(F.broadcast(picked), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.select(["id", "label", "text"])
            rows = []
            for i, label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = describe(t.as_py())[1]
                start = crc32(b"%d" % i) % max(1, len(x) - max_lines + 1)
                if len(x):
                    rows.append((i, label, x[start : start + max_lines].astype(np.int8).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["id", "label", "x"])

    rows = batched(texts).mapInArrow(run, "id bigint, label int, x binary").distinct().collect()  # max_train rows at most, a few bytes a line
    rows.sort(key=lambda r: (crc32(b"%d" % r["id"]), r["id"], r["x"]))
    return train_crf(spliced([(np.frombuffer(r["x"], np.int8).astype(np.int64).reshape(-1, len(_BINS)), r["label"]) for r in rows]))


_SCHEMA = (
    "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, content_share double"
)


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of every document."""
    w, step = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, x, sizes = describe(t.as_py())
                label = viterbi(w[x].sum(1), step)
                share = float((sizes * label).sum() / sizes.sum()) if len(sizes) else 0.0
                failed = base[0] < MIN_WORDS or base[4] > MAX_REPEAT * base[0]
                rows.append((*base, failed, not failed and share >= MIN_CONTENT, len(sizes), share))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")]
            )

    return batched(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("binary").alias("text"))).mapInArrow(run, _SCHEMA)


def line_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(docs, fit(docs, labels, id_col, text_col), id_col, text_col)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base figures and verdict."""
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
