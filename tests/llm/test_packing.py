import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import vecgrove.llm.packing as P
from vecgrove.llm.packing import CAPACITY, Ids, best_fit_decreasing, pack, padding


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = [
    "It's we'LL, THE end. Ärger ÉCOLE, naïve", "Å é H̱ KK  x y", "<|startoftext|> a <|ENDOFTEXT|> <|endoftext|>b", "a,b.c,. x.,y ,. . , a.. b,,",
    "12,345.67 3.14. v2, é. É, ß, Σας ΣΑΣ. İI ı", "日本語、テキスト。 가나다 क़̈́", "x" * 3000 + ", " + "É" * 100 + ".", "\x1c\x1d\x85 tab\tnew\nline\r\x0b\x0c", "|<| <|x|> ### $$$! don't. DON'T,", "",
]


def test_ids_equal_those_of_the_tokenizer(tokenizer, sf_rows, monkeypatch):
    rng = random.Random(3)
    alphabet = "aAbBzZéÉ̱́,.'’s<|>#1 9\n "
    texts = [t for _, t, _ in sf_rows] + ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(4000)]
    for limit in (1_500_000, 500):
        monkeypatch.setattr(P, "_CACHE_WORDS", limit)
        ids = Ids()
        for t in texts:
            want = tokenizer.encode(t, add_special_tokens=False).ids + [1]
            assert np.frombuffer(ids(t.encode()), "<u4").tolist() == want, t[:80]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400)
    seq, off = best_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):  # by scanning all open sequences
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            k = min(fits)
            room.remove(k)
            room.append(k - lengths[i])
        else:
            room.append(100 - lengths[i])
    assert len(room) == seq.max() + 1
    got = np.bincount(seq, lengths).astype(int)
    assert sorted(100 - got) == sorted(room)
    for s in range(seq.max() + 1):
        at = np.flatnonzero(seq == s)
        at = at[np.argsort(off[at])]
        assert off[at].tolist() == np.concatenate(([0], np.cumsum(lengths[at])[:-1])).tolist()


def test_padding():
    assert [padding(n) for n in (1, 2, 3, 1024, 1025, 2048)] == [0, 0, 2045, 0, 1023, 0]


def check(rows, out, tokenizer):
    docs = defaultdict(list)
    for i, t, *_ in rows:
        docs[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        seen[r["id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = {
        i: sorted(
            (s, len(x[s : s + CAPACITY]), crc32(np.array(x[s : s + CAPACITY], "<u4").tobytes()), len(x)) for x in xs for s in range(0, len(x), CAPACITY)
        )
        for i, xs in docs.items()
    }
    assert {i: sorted(v) for i, v in seen.items()} == want
    total = padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= CAPACITY
        total += at
        padded += padding(at)
    return total, padded


def test_tables(sf_docs, sf_rows, tokenizer):
    total, padded = check(sf_rows, pack(sf_docs).collect(), tokenizer)
    assert padded < 0.03 * total


def test_edges(edge_docs, edge_rows, empty_docs, tokenizer):
    check(edge_rows, pack(edge_docs).collect(), tokenizer)
    assert pack(empty_docs).count() == 0


def test_shards_and_ids(sf_docs, sf_rows, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 32)
    out = pack(sf_docs, with_ids=True).collect()
    check(sf_rows, out, tokenizer)
    assert all(len(r["ids"]) == r["length"] for r in out)
    again = pack(sf_docs.repartition(7)).collect()
    key = ("id", "start", "sequence_id", "offset")
    assert sorted(tuple(r[k] for k in key) for r in out) == sorted(tuple(r[k] for k in key) for r in again)


def test_long_words_one_a_letter_longer(tokenizer):
    for n in range(65, 95):
        w = "q" * n
        text = f"{w} {w}. {w}q {w}qq {w}q,"
        assert np.frombuffer(Ids()(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_long_words_with_and_without_stops(spark, tokenizer, monkeypatch):
    """Words over the length that is remembered, in both orders, through ``pack``."""
    texts = []
    for n in range(60, 111):
        w = "q" * n
        texts += [f"{w} {w}, {w}.", f"{w}. {w}, {w}", f"{w}q, {w}", f"{w}, {w}q {w}qq."]
    rows = list(enumerate(texts))
    check(rows, pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect(), tokenizer)
    monkeypatch.setattr(P, "_CACHE_WORDS", 3)
    ids = Ids()
    for t in texts:
        assert np.frombuffer(ids(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_repeated_rows_are_dealt_over_shards(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 32)
    rows = [(None, "the same text")] * 900 + [(i, f"text {i}") for i in range(300)]
    out = pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    check(rows, out, tokenizer)
    sizes = defaultdict(int)
    for r in out:
        sizes[r["sequence_id"] >> 32] += 1
    assert max(sizes.values()) <= 4 * 32 and len(sizes) > 20
