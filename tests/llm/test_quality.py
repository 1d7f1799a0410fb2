import itertools
import re
from collections import Counter

import numpy as np
import pytest

from vecgrove.llm import line_quality as L
from vecgrove.llm import weak_quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    dup, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_figures(spark, sf, sf_docs, sf_rows, edge_docs, edge_rows, empty_docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs, rows in ((sf_docs, sf_rows), (edge_docs, edge_rows)):
        got = Counter()
        for r in L.line_quality(docs, labels).collect():
            n, _, _, _, rep = base = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
            assert not (r["kept"] and r["base_failed"])
            got[(r["id"], *base)] += 1
        assert got == Counter((i, *brute_base(t)) for i, t, *_ in rows)
    assert L.line_quality(empty_docs, labels).count() == 0
    none = L.line_quality(edge_docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


def test_repeat_words_with_a_large_vocabulary(monkeypatch):
    words = [b"w%d" % (i % 700) for i in range(1000)] + [b"x%d" % i for i in range((1 << 20) + 5)]
    assert L.repeat_words(words) == 600


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_and_gradient_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 7))
    s, step = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

    def total(y):
        return sum(s[i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1))

    every = list(itertools.product((0, 1), repeat=n))
    assert tuple(L.viterbi(s, step).tolist()) == max(every, key=total)
    y = np.array(every[int(rng.integers(len(every)))])
    p = np.exp([total(k) for k in every])
    p /= p.sum()
    own, pair = np.zeros((n, 2)), np.zeros((2, 2))
    for k, q in [(tuple(y), 1.0), *zip(every, -p, strict=True)]:
        for i in range(n):
            own[i, k[i]] += q
        for i in range(n - 1):
            pair[k[i], k[i + 1]] += q
    a, b = L.gradient(s, step, y)
    assert a == pytest.approx(own, abs=1e-9) and b == pytest.approx(pair, abs=1e-9)


def test_ties_go_to_content():
    assert L.viterbi(np.zeros((4, 2)), np.zeros((2, 2))).tolist() == [1] * 4


def _agreement(spark, judged):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = judged.join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    clean, junk = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    return sum(r["kept"] for r in clean) / len(clean), sum(not r["kept"] for r in junk) / len(junk), clean


def test_line_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept, dropped, clean = _agreement(spark, L.line_quality(docs, labels))
    assert dropped >= 0.97
    assert all(r["kept"] for r in clean if not r["base_failed"]) or sum(not r["kept"] for r in clean if not r["base_failed"]) <= 0.01 * len(clean)


def test_lines_are_labelled_within_documents(spark):
    """Clean lines in junk and junk lines in clean documents get their own labels; checked on documents that training left out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    w, step = L.fit(docs, labels)
    assert (step[0, 0] + step[1, 1] > step[0, 1] + step[1, 0]) and abs(step).max() < 3
    held = docs.join(labels.groupBy("doc_id").agg({"quality": "min"}).toDF("doc_id", "good"), "doc_id").where(L.fold(L.F.col("doc_id")) == L.HELD_OUT).orderBy("doc_id").collect()
    described = [(L.describe(r["text"].encode()), int(r["good"] > 0)) for r in held]
    described = [(d, y) for d, y in described if len(d[1])]
    shares = [(float((d[2] * L.viterbi(w[d[1]].sum(1), step)).sum() / d[2].sum()), y) for d, y in described]
    assert sum((s >= 0.5) == y for s, y in shares) >= 0.995 * len(shares)
    assert sum(0 < s < 1 for s, _ in shares) >= 0.01 * len(shares)
    right = lines = 0
    for x, y in L.spliced([(d[1], y) for d, y in described], share=1.0, seed=77):
        right += int((L.viterbi(w[x].sum(1), step) == y).sum())
        lines += len(y)
    assert right >= 0.95 * lines
    prose = [
        "The old harbour town lies between two hills, and its market is held there every week.", "Ships from the north bring timber.",
        "Those from the south bring wine, oil and cloth, which merchants sell on the quay before noon.", "In winter the bay freezes over.",
        "Then the road along the coast is the only way in, and letters take nine days to reach the capital.",
    ]
    footer = ["HOME | LOGIN | CART | HELP | $$$ | ### | SHARE | SIGN UP | TERMS | &&& | PRINT", "CLICK!! $$$ ### HERE!! &&& NOW!!"]
    x = L.describe("\n".join(prose + footer).encode())[1]
    assert L.viterbi(w[x].sum(1), step).tolist() == [1] * 5 + [0] * 2


def test_long_documents_train_with_a_window(spark):
    text = "\n".join(f"Line {i} of a long document, with words of its own." for i in range(2000))
    docs = spark.createDataFrame([(i, text if i % 2 else "$$$ ### BUY NOW!! " * 30) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    w, step = L.fit(docs, labels, max_lines=10)
    out = {r["id"]: r["content_share"] for r in L.judge(docs, (w, step)).collect()}
    assert all(out[i] > 0.9 if i % 2 else out[i] < 0.1 for i in out)


def test_very_long_and_odd_texts(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = ["word " * 400_000, "x" * 2_000_000, "a\n" * 200_000, "\n" * 300_000, "\x85\u2028 \x1c", "é" * 100 + "\n" + "###"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in L.line_quality(docs, labels).collect()}
    assert got == {(i, *brute_base(t)) for i, t in rows}
    assert Q.weak_quality(docs).count() == len(rows)


def brute_votes(text):
    """The labellers by their definitions, word by word."""
    w = WORD.findall(text)
    n = len(w)
    if not n:
        return "-0000000"
    plain = re.compile(r"""[("']?(?:[A-Z]?(?:[a-z]|[^\x00-\x7f])+|[A-Z]|[0-9]+)(?:['-][A-Z]?(?:[a-z]|[^\x00-\x7f])+)*[.,;:?!)"']*""")

    def marks_once(x):  # runs of a mark count up to two
        return len(re.search(r"""[.,;:?!)"']*$""", re.sub(r"(.)\1{2,}", r"\1\1", x))[0]) <= 2

    step = 1 + n // 2000
    parts = [w[i * n // step : (i + 1) * n // step] for i in range(step)]
    variety = sum(len(set(p)) / len(p) for p in parts) / step
    pairs = sum(len(set(zip(p, p[1:], strict=False))) / max(1, len(p) - 1) for p in parts) / step
    share = sum(bool(plain.fullmatch(x)) and marks_once(x) for x in w) / n
    stops = sum(x[-1] in ".,;" for x in w) / n
    return "".join(
        (
            "+" if share >= 0.85 else "-" if share <= 0.6 else "0",
            "-" if sum(c in "#*$%&|<>" for c in text) / n >= 0.2 else "0",
            "-" if sum(a == b for a, b in zip(w, w[1:], strict=False)) / n >= 0.3 else "0",
            "?" if n < 40 else "+" if variety >= 0.4 else "-" if variety <= 0.2 else "0",
            "-" if sum(bool(re.match("[A-Z][A-Z]", x)) for x in w) / n >= 0.4 else "0",
            "-" if text.count("!!") / n >= 0.2 else "0",
            "+" if 0.03 <= stops <= 0.4 else "?" if n < 25 else "-" if stops < 0.01 else "0",
            "?" if n < 25 else "+" if pairs >= 0.75 else "-" if pairs <= 0.25 else "0",
        )
    )


def test_votes_by_definition(spark, sf_docs, sf_rows, edge_docs, edge_rows):
    for docs, rows in ((sf_docs, sf_rows), (edge_docs, edge_rows)):
        got = Counter((r["id"], r["votes"]) for r in Q.weak_quality(docs).collect())
        assert got == Counter((i, brute_votes(t or "")) for i, t, *_ in rows)


def test_scorer_against_plain_steps():
    """Features and the linear scorer, step by step in plain Python."""
    from zlib import crc32

    rng = np.random.default_rng(6)
    shapes = [[b"xx", b"Xx.", b"xx", b"##"][: int(rng.integers(1, 5))] * int(rng.integers(1, 9)) for _ in range(40)]
    xs = [Q.features(s) for s in shapes]
    one = set()
    s = shapes[0]
    for tag, keys in (("w", s), ("e", [k[-1:] for k in s]), ("p", [a + b" " + b for a, b in zip(s, s[1:], strict=False)])):
        for k, c in Counter(keys).items():
            share = c / len(s)
            if share >= 0.004:
                one.add(crc32(tag.encode() + k + b":%d" % (int(-np.log2(share)) if share < 1 else 0)) % 65536)
    one.add(crc32(b"n%d" % min(12, len(s).bit_length())) % 65536)
    assert sorted(one) == xs[0]
    ys = rng.random(40)
    w, g2 = {}, {}
    for _ in range(4):
        for x, y in zip(xs, ys, strict=True):
            at = [*x, 65536]
            p = 1 / (1 + np.exp(-sum(w.get(k, 0.0) for k in at)))
            for k in at:
                g = (p - y) / len(at) ** 0.5 + 1e-4 * w.get(k, 0.0)
                g2[k] = g2.get(k, 0.01) + g * g
                w[k] = w.get(k, 0.0) - 0.2 * g / g2[k] ** 0.5
    got = Q.train_scorer([(np.array(x), y) for x, y in zip(xs, ys, strict=True)])
    assert [got[k] for k in sorted(w)] == pytest.approx([w[k] for k in sorted(w)])
    assert np.count_nonzero(got) <= len(w)


def test_weak_labels_keep_clean_documents(spark):
    kept, dropped, _ = _agreement(spark, Q.weak_quality(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    assert kept >= 0.99 and dropped >= 0.98


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.9])
    patterns = Counter()
    for y in good:
        patterns["".join("+-"[int((rng.random() < a) != y)] if rng.random() < 0.8 else "0" for a in right)] += 1
    posterior, rates = Q.em(patterns)
    for j, a in enumerate(right):
        assert rates[j, 0, 0] / rates[j, 0, :2].sum() == pytest.approx(a, abs=0.03)
    assert posterior["+++++"] > 0.99 > 0.01 > posterior["-----"]
    assert Q.em({})[0] == {}


def test_weak_edges(edge_docs, edge_rows, empty_docs):
    out = Q.weak_quality(edge_docs).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["id"] == 4}) == 1
    assert Q.weak_quality(empty_docs).count() == 0


def test_long_words_count_whole():
    from vecgrove.llm.weak_quality import _squeeze

    known = {}
    assert _squeeze(b"x" * 64 + b"#x.", known) == b"xx#x." and not known
    assert _squeeze(b"xxxx.", known) == b"xx." and known
