import re
from collections import Counter

import numpy as np
import pytest
from brute import brute_components, brute_fp

from vecgrove.llm.simhash import components, fingerprint, link_runs, links, masks_for, near_duplicates, op9_simhash

def clustered(n, seed, near=0.6):
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 1 << 63, n // 10, dtype=np.uint64))
    while len(out) < n:
        x = out[rng.integers(len(out))] if rng.random() < near else rng.integers(0, 1 << 63, dtype=np.uint64)
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x = x ^ np.uint64(1 << int(b))
        out.append(x)
    return out


def test_fingerprint(sf_rows, edge_rows):
    for t in [t for _, t, _ in sf_rows] + [r[1] for r in edge_rows if len(r[1] or "") < 40_000]:
        assert fingerprint(t.encode() if t is not None else None) == brute_fp(t)


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4, 6])
def test_any_linked_pair_agrees_under_a_mask(max_bits):
    rng = np.random.default_rng(1)
    masks = masks_for(np.array(clustered(500, 2), np.uint64), max_bits, 10_000)
    for _ in range(3000):
        d = sum(1 << int(b) for b in rng.choice(64, max_bits, replace=False))
        assert any(d & m == 0 for m in masks)


def _union(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_long_runs_are_spanned():
    v = np.unique(np.array(clustered(1500, 3, near=0.97), np.uint64))
    zero = np.zeros(len(v), np.int64)
    a, b = link_runs(zero, zero, v, np.zeros(1, np.uint64), 4)
    got = _union(zip(a.tolist(), b.tolist(), strict=True))
    want = [v[i] for i in brute_components(v)]
    assert [got.get(int(x), int(x)) for x in v] == [int(x) for x in want]
    assert len(a) < len(v)


def test_links_and_components(spark):
    v = np.unique(np.array(clustered(4000, 4), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint")
    got = {r["node"]: r["label"] for r in components(links(df)).collect()}
    order = v[np.argsort(v.view(np.int64))]
    want = [int(order[i].view(np.int64)) for i in brute_components(order)]
    assert [got.get(int(x), int(x)) for x in order.view(np.int64)] == want


def test_hot_values_are_cut_into_blocks(spark, monkeypatch):
    import vecgrove.llm.simhash as m

    monkeypatch.setattr(m, "BLOCK", 100)
    v = np.unique(np.array(clustered(1500, 5, near=0.99), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint")
    got = {r["node"]: r["label"] for r in components(m.links(df)).collect()}
    order = v[np.argsort(v.view(np.int64))]
    want = [int(order[i].view(np.int64)) for i in brute_components(order)]
    assert [got.get(int(x), int(x)) for x in order.view(np.int64)] == want


@pytest.mark.parametrize(("block", "blocks", "rounds"), [(20, 1, 4), (50, 2, 1), (8, 1, 2)])
def test_hot_values_are_refined(spark, monkeypatch, block, blocks, rounds):
    import vecgrove.llm.simhash as m

    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(m, "REFINE", rounds)
    v = np.array(clustered(1200, 5, near=0.6), np.uint64)
    v[:900] &= np.uint64(0xFFFFFFF000000000)  # most rows agree in more than half of the bits
    v = np.unique(v)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint")
    masks = m.masks_for(v, 4, len(v))
    origins, n = list(range(len(masks))), len(masks)
    m.deal(df, masks, origins, 4)
    assert len(masks) == len(origins) > n and all(o < n for o in origins)
    got = {r["node"]: r["label"] for r in components(m.links(df)).collect()}
    order = v[np.argsort(v.view(np.int64))]
    want = [int(order[i].view(np.int64)) for i in brute_components(order)]
    assert [got.get(int(x), int(x)) for x in order.view(np.int64)] == want


@pytest.mark.parametrize("max_bits", [1, 4])
def test_linked_rows_agree_under_a_refined_mask(max_bits):
    from vecgrove.llm.simhash import refined

    rng = np.random.default_rng(3)
    for _ in range(200):
        mask = int(rng.integers(0, 1 << 63, dtype=np.uint64)) << 1
        x = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        free = [b for b in range(64) if not mask >> b & 1]
        y = x
        for b in rng.choice(free, max_bits, replace=False).tolist():
            y ^= 1 << b
        assert any(x & m == y & m for m in refined(mask, max_bits)) and all(m & mask == mask for m in refined(mask, max_bits))
    assert refined((1 << 64) - 1, 4) == []


def test_every_hot_value_is_found(spark, monkeypatch):
    """Also one far too rare for a sample; the counted blocks cover it."""
    import vecgrove.llm.simhash as m

    monkeypatch.setattr(m, "BLOCK", 5)
    rows = [(0, 7, i) for i in range(11)] + [(1, 7, i) for i in range(5)] + [(1, i, i) for i in range(5000)]
    hot = m.hot_values(spark.createDataFrame(rows, "slot int, key bigint, fp bigint")).collect()
    assert [tuple(r) for r in hot] == [(0, 7, 3), (1, 7, 2)]


def test_chain_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


def check(rows, out):
    fps = {}
    for r in out:
        fps.setdefault(r["id"], r["fp"])
    ids = [i for i, _, *_ in rows]
    prints = [brute_fp(t) for _, t, *_ in rows]
    label = brute_components(prints)
    smallest = {}
    for i, lab in zip(ids, label, strict=True):
        if i is not None:
            smallest[lab] = min(i, smallest.get(lab, i))
    want = Counter((i, smallest.get(lab)) for i, lab in zip(ids, label, strict=True))
    assert Counter((r["id"], r["component_id"]) for r in out) == want


def test_tables(sf_docs, sf_rows):
    check(sf_rows, near_duplicates(sf_docs).collect())


def test_edges(edge_docs, edge_rows, empty_docs):
    check(edge_rows, near_duplicates(edge_docs).collect())
    assert near_duplicates(empty_docs).count() == 0


def test_query_form(spark, sf):
    r = op9_simhash(spark, sf).first()
    assert re.fullmatch("[0-9a-f]{16}", r["fingerprint"])
