"""The pipeline's near copies against brute force over five-word shingles."""

import random
from collections import defaultdict

import corpus_pipeline as C
from brute import LOW, UP, WORD


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans(UP, LOW)))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(rows):
    """Of rows (id, text), lists linked by a Jaccard similarity of 0.8 or more."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        out[x].append(r)
    return list(out.values())


def check(rows, out):
    smallest = [min((i for i, _ in g if i is not None), default=None) for g in groups(rows)]
    assert sorted((r["doc_id"] for r in out), key=repr) == sorted(smallest, key=repr)


def test_planted(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows.append(base)
        for changed in (1, 2, 3, 4, 5, 8):
            w = list(base)
            for at in rng.sample(range(200), changed):
                w[at] = f"v{rng.randrange(3000)}"
            rows.append(w)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert len(groups(rows)) < 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(rows, dict(C.STAGES)["simhash_near_dedup"](spark, docs, "").collect())


def test_tables(spark, sf, sf_docs):
    docs = C.stored(C.drop_copies(spark, sf_docs, sf), "test")
    out = dict(C.STAGES)["simhash_near_dedup"](spark, docs, sf)
    assert out.columns == docs.columns
    check([(r["doc_id"], r["text"]) for r in docs.collect()], out.collect())


def test_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a + " end"), (None, b), (1, b + " end"), (1, "other"), (1, "other"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [(r["doc_id"], r["text"]) for r in dict(C.STAGES)["simhash_near_dedup"](spark, docs, "").collect()]
    assert len(out) == 4 and {(1, b + " end"), (1, "other"), (None, "lone")} < set(out) and {(None, a), (None, a + " end")} & set(out)


def test_bits_and_links_of_a_unit(monkeypatch):
    import numpy as np
    import vecgrove.llm.near_copies as N

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, 40)).astype(np.int32) for _ in range(30)]
    sets += [np.sort(rng.permutation(s)[: max(1, len(s) - 2)]) for s in sets[:20]]
    for most in (1 << 25, 0):
        monkeypatch.setattr(N, "_BYTES", most)
        bits = N.bit_rows(sets)
        for i in range(len(sets)):
            for j in range(i):
                assert int(np.bitwise_count(bits[i] & bits[j]).sum()) == len(set(sets[i].tolist()) & set(sets[j].tolist()))
        a, b = N.spanning(np.arange(100, 150), sets)
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if 5 * len(x & y) >= 4 * len(x | y):
                    old, new = label[i], label[j]
                    label = [new if k == old else k for k in label]
        want = {}
        for i, k in enumerate(label):
            want.setdefault(k, []).append(100 + i)
        got = {i: {i} for i in range(100, 150)}
        for x, y in zip(a, b, strict=True):
            whole = got[x] | got[y]
            for k in whole:
                got[k] = whole
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
        assert len(a) == 50 - len(want)


def test_common_keys_are_dealt_again(spark, monkeypatch):
    """Passages that most texts share, families of copies of copies: with groups of any size, the same documents stay."""
    import vecgrove.llm.near_copies as N

    monkeypatch.setattr(N, "GROUP", 4)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(120):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([15, 30, 60]))]
        rows.append(own + passage if k % 3 else own)
    for _ in range(4):  # chains: each a copy of the last with two words changed
        w = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            w = list(w)
            for at in rng.sample(range(120), 2):
                w[at] = f"v{rng.randrange(5000)}"
            rows.append(w)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(rows, dict(C.STAGES)["simhash_near_dedup"](spark, docs, "").collect())
