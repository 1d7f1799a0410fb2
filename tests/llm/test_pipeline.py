"""The pipeline's stages, each against the rule it stands for, and all together."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from brute import brute_similar

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix", "packing"]


def test_toxicity_stage(spark, sf, sf_docs):
    from vecgrove.llm.toxicity import toxicity

    gone = {r["id"] for r in toxicity(sf_docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["predicted"]}
    out = C.drop_toxic(spark, sf_docs, sf)
    assert out.columns == sf_docs.columns
    assert rows_of(out) == Counter({r: n for r, n in rows_of(sf_docs).items() if r[0] not in gone})


@pytest.mark.parametrize("which", ["sf_docs", "edge_docs"])
def test_exact_stage(spark, sf, request, which):
    docs = request.getfixturevalue(which)
    out = C.drop_copies(spark, docs, sf)
    assert out.columns == docs.columns
    best = {}
    for r in docs.collect():
        t = (r["text"] or "").translate(str.maketrans(UP, LOW))
        best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
    got = [((r["text"] or "").translate(str.maketrans(UP, LOW)), -1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect()]
    assert sorted(got) == sorted(best.items())


@pytest.mark.parametrize("which", ["sf_docs", "edge_docs"])
def test_near_stage(spark, sf, request, which):
    docs = C.stored(C.drop_copies(spark, request.getfixturevalue(which), sf), "test")
    out = C.drop_similar(spark, docs, sf)
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = defaultdict(list)
    for (i, _), lab in zip(rows, brute_similar([t for _, t in rows]), strict=True):
        groups[lab].append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("most", [0, 250_000])
def test_stages_drop_the_same_rows_by_bitmap(spark, sf, sf_docs, most, monkeypatch):
    """Many rows go through a bitmap and an exact join, few are sent; both leave the same documents."""
    from vecgrove.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    kept = C.stored(C.drop_copies(spark, sf_docs, sf), "test")
    best = {}
    for r in sf_docs.collect():
        t = r["text"].translate(str.maketrans(UP, LOW))
        best[t] = max(best.get(t, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    first = {}
    for (i, _), lab in zip(rows, brute_similar([t for _, t in rows]), strict=True):
        first[lab] = min(first.get(lab, i), i)
    assert sorted(r["doc_id"] for r in C.drop_similar(spark, kept, sf).collect()) == sorted(first.values())


def test_mix_stage(spark, sf, sf_docs):
    from vecgrove.llm.mixing import mix

    out = C.mix_sources(spark, sf_docs, sf)
    assert out.columns == sf_docs.columns
    copies = {r["id"]: r["copies"] for r in mix(sf_docs).collect()}
    assert rows_of(out) == Counter({r: copies[r[0]] for r in rows_of(sf_docs) if copies[r[0]]})


def test_whole(spark, sf):
    rows = C.run(spark, sf).collect()
    again = C.run(spark, sf).collect()
    assert rows and Counter(rows) == Counter(again)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_edges_and_empty(spark, sf, edge_docs, empty_docs):
    for docs in (edge_docs, empty_docs):
        at = docs
        for _, stage in C.STAGES[:-1]:
            at = C.stored(stage(spark, at, sf), "edge")
            assert at.columns == docs.columns
        assert C.STAGES[-1][1](spark, at, sf).count() >= at.count()
