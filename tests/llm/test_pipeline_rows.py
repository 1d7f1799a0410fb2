"""Stages decide by row where ids are null or repeated."""

from collections import Counter

import corpus_pipeline as C


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_exact_stage(spark, sf):
    rows = [(None, "x"), (5, "X"), (None, "lone"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "C"), (None, "d"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = C.drop_copies(spark, docs, sf).collect()
    assert sorted((r["text"].lower(), r["doc_id"] or 0) for r in got) == [("a", 1), ("b", 2), ("c", 3), ("d", 0), ("lone", 0), ("x", 5)]


def test_toxicity_stage(spark, sf, monkeypatch):
    from vecgrove.llm import toxicity as T

    docs = spark.createDataFrame([(None, "bad"), (None, "fine"), (1, "bad"), (1, "good"), (None, None)], "doc_id bigint, text string")
    hashed = T.Hasher(22)
    at = [int(x) for x in set(hashed("bad").tolist()) - set(hashed("fine").tolist()) - set(hashed("good").tolist())]
    model = T.Model(22, -1.0, T.np.array(sorted(at), T.np.int32), T.np.full(len(at), 9.0, T.np.float32))
    monkeypatch.setattr(T, "fit", lambda *a: model)
    assert texts(C.drop_toxic(spark, docs, sf)) == Counter([(None, "fine"), (1, "good"), (None, None)])


def test_mix_stage(spark, sf):
    from vecgrove.llm.mixing import mix

    rows = [(None, f"{'w ' * (i % 7 + 1)}{i}", f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = sum(r["taken"] for r in mix(docs).collect())
    assert sum(len(r["text"].split()) for r in C.mix_sources(spark, docs, sf).collect()) == taken
