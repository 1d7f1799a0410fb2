from zlib import crc32

import numpy as np
import pytest

from vecgrove.llm.toxicity import Hasher, fit, score, toxicity, train_ftrl


def brute_ftrl(rows, size, alpha, beta, l1, l2, epochs):
    """Coordinate by coordinate, as published; the bias has no L1 and L2 terms."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if i == size:
            return -z[i] * alpha / (beta + n[i] ** 0.5)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            on = [*x, size]
            w = [weight(i) for i in on]
            g = 1 / (1 + np.exp(-sum(w))) - y
            for i, wi in zip(on, w, strict=True):
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - s * wi
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_learner_against_plain_form():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 64, 6)), int(rng.random() < 0.4)) for _ in range(120)]
    m = train_ftrl(rows, 6, alpha=0.5, beta=1.0, l1=0.4, l2=0.1, epochs=3)
    want = brute_ftrl(rows, 64, 0.5, 1.0, 0.4, 0.1, 3)
    assert m.dense() == pytest.approx(want[:64], abs=1e-5) and m.bias == pytest.approx(want[64])
    assert 0 < len(m.index) < 64


def test_features_are_words_pairs_and_skips():
    h = Hasher(22)
    assert len(h("a b c")) == 3 + 2 + 1
    assert set(h("A, b")) == set(h("a b")) and len(h("")) == 0 and len(h(None)) == 0
    assert set(h("a x b")) & set(h("a y b")) - set(h("a")) - set(h("b"))


def test_scores_equal_sum_of_weights(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = fit(docs, labels)
    h, w = Hasher(m.bits), m.dense()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in score(docs, m).collect():
        raw = m.bias + sum(float(w[i]) for i in set(h(text[r["id"]]).tolist()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = [r for r in toxicity(docs, labels).collect() if r["held_out"] and r["id"] in toxic]
    assert all(crc32(str(r["id"]).encode()) % 4 == 2 for r in out)
    hit = sum(r["predicted"] == toxic[r["id"]] == 1 for r in out)
    assert hit >= 0.8 * sum(toxic[r["id"]] for r in out) and hit >= 0.95 * sum(r["predicted"] for r in out)


def test_held_out_labels_are_not_learnt_from(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    from vecgrove.llm.common import fold

    other = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs, labels), fit(docs, other)
    assert a.bias == b.bias and a.index.tolist() == b.index.tolist()


def test_edges(spark, edge_docs, edge_rows, empty_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (12, 0), (None, 1), (99, 1), (13, None), (10, 0), (11, 0)], "doc_id bigint, toxic int")
    out = toxicity(edge_docs, labels).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in out)
    same = {(r["score"], r["predicted"]) for r in out if r["id"] == 4}
    assert len(same) == 1
    assert toxicity(empty_docs, labels).count() == 0
    none = toxicity(edge_docs, labels.limit(0)).collect()
    assert len(none) == len(edge_rows) and not any(r["predicted"] for r in none)


def test_training_is_bounded_in_bytes(spark):
    """Rows that do not fit are left out; the others are learnt from as ever."""
    rows = [(i, "bad word here" if i % 2 else "good word there", i % 2) for i in range(60)]
    big = " ".join(f"w{i}" for i in range(50_000))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, big) for i in range(4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000 + i, 1) for i in range(4)], "doc_id bigint, toxic int")
    only = fit(docs.where("doc_id < 1000"), labels)
    small = fit(docs, labels, max_bytes=100_000)
    assert (small.bias, small.index.tolist(), small.weight.tolist()) == (only.bias, only.index.tolist(), only.weight.tolist())
    assert fit(docs, labels).bias != only.bias
    assert fit(docs, labels, max_bytes=0).bias == fit(docs.limit(0), labels).bias


def test_choice_never_sees_the_held_out_fold(sf):
    from vecgrove.llm import toxicity_choice as choice

    rows = choice.load(sf)
    assert rows and {f for f, _, _ in rows} <= set(choice.FOLDS) and choice.HELD_OUT not in choice.FOLDS
    planted = [(f, np.array([1, 7] if y else [2, 7], np.int32), y) for f in choice.FOLDS for y in (0, 1) for _ in range(40)]
    f1, loss = choice.trial(planted, dict(alpha=1.0, l1=0.1, l2=0.5, epochs=2))
    assert f1 == 1 and loss < 0.2
