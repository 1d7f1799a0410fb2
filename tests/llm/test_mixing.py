import random
import re
from collections import Counter, defaultdict

import pytest

from brute import cheapest_flow, targets
from vecgrove.llm.mixing import mix, mixed_documents, route, with_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert targets([10, 1000], [1, 1]) == pytest.approx([30, 980])
    assert targets([10, 20, 3000], [1, 2, 3]) == pytest.approx([30, 60, 2940])
    assert targets([0, 0], [1, 2]) == [0, 0]
    assert targets([], []) == []


def test_route_prefers_unused_text():
    # the shared pattern goes to the source that would have to repeat otherwise
    given = route({"a": 100, "b": 100, "ab": 100}, {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}, {"a": 200, "b": 100})
    assert given == {"a": 100, "b": 100, "ab": 100}
    given = route({"a": 10}, {"a": ["a"]}, {"a": 25})
    assert given == {"a": 25}
    assert route({"a": 10}, {"a": ["a"]}, {"a": 50}) == {"a": 30}


def check(rows, out):
    assert len(out) == len(rows)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by, largest = Counter(), Counter()
    for i, _, s in rows:
        by[s] += size[i]
        largest[s] = max(largest[s], size[i])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets([by[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))]), strict=True))
    taken, source = defaultdict(int), {i: s for i, _, s in rows}
    for r in out:
        s = source[r["id"]]
        assert r["size"] == size[r["id"]] and r["source_size"] == by[s] and r["target"] == pytest.approx(goal[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1


def test_tables_and_reruns(sf_docs, sf_rows):
    out = mix(sf_docs).collect()
    check(sf_rows, out)
    again = mix(sf_docs.repartition(5)).collect()
    assert sorted((r["id"], r["taken"]) for r in out) == sorted((r["id"], r["taken"]) for r in again)


def test_edges(edge_docs, edge_rows):
    check([(i, t, s) for i, t, _, s, _ in edge_rows], mix(edge_docs).collect())


def test_empty(empty_docs):
    assert mix(empty_docs).count() == 0


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(40)], "doc_id bigint, text string, source array<string>")
    out = mix(df).collect()
    assert len(out) == 40 and all(r["taken"] <= 30 for r in out)
    assert abs(sum(r["taken"] for r in out) - 400) <= 20


def test_targets_of_a_table(spark):
    rng = random.Random(4)
    for n, top in ((0, 1), (1, 5), (7, 1), (40, 10**9), (60, 3)):
        sizes = {f"s{i:03d}": rng.randrange(top) ** rng.choice([1, 2]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(3)
        got = {r["source"]: r["target"] for r in with_targets(df, (1, 2, 3), 3).collect()}
        want = dict(zip(sorted(sizes), targets([sizes[k] for k in sorted(sizes)], [(1, 2, 3)[i % 3] for i in range(n)]), strict=True))
        assert got == pytest.approx(want)


def test_route_is_the_cheapest_flow():
    rng = random.Random(9)
    for _ in range(150):
        sources = [f"s{i}" for i in range(rng.randrange(1, 6))]
        members = {f"p{i}": sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1))) for i in range(rng.randrange(1, 9))}
        sizes = {p: rng.randrange(0, 30) for p in members}
        quotas = {s: rng.randrange(0, 90) for s in sources}
        given = route(sizes, members, quotas)
        assert all(0 <= given[p] <= 3 * sizes[p] for p in sizes)
        cost = sum(c * min(max(given[p] - c * sizes[p], 0), sizes[p]) for p in sizes for c in range(3))
        assert (sum(given.values()), cost) == cheapest_flow(sizes, members, quotas)


def test_many_sources(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 20_000}") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(rows, mix(docs).collect())


def test_lists_of_sources(spark):
    """Empty and null lists are the null source; odd characters in names keep sets apart."""
    lists = [[], None, [None], ["a", "b"], ["a\x01b"], ["0a"], ["a", None], ["b", "a", "a"], ["1:a"]]
    rows = [(i, "w " * 20, lists[i % len(lists)]) for i in range(270)]
    out = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")).collect()
    assert len(out) == 270 and all(0 <= r["taken"] <= 60 for r in out)
    keys = {tuple(sorted({"1" if x is None else "0" + x for x in (v or [None])})) for v in lists}
    assert {tuple(r["sources"]) for r in out} == keys
    assert abs(sum(r["taken"] for r in out) - 5400) <= 20 * 9


def overlapping(spark):
    rng = random.Random(2)
    names = "abcdef"
    rows = [(i, "w " * rng.randrange(1, 12), sorted(rng.sample(names, rng.choice([1, 1, 2, 3])))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")


@pytest.mark.parametrize("bound", [20_000, 3, 0])
def test_overlapping_sources_fill_their_quotas(spark, bound):
    rows, docs = overlapping(spark)
    out = mix(docs, max_patterns=bound).collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    patterns = len({tuple(r["sources"]) for r in out})
    slack = 12 * patterns
    if bound > 100:  # all in the network: the quotas' sum is routed; repeats only where the cheapest flow has them
        sizes, members = Counter(), {}
        for r in out:
            sizes["".join(r["sources"])] += r["size"]
            members["".join(r["sources"])] = r["sources"]
        listed = Counter()
        for p, m in members.items():
            for s in m:
                listed[s] += sizes[p]
        goal = targets([listed[s] for s in sorted(listed)], [(1, 2, 3)[i % 3] for i in range(len(listed))])
        quotas = {s: round(g * total / sum(listed.values())) for s, g in zip(sorted(listed), goal, strict=True)}
        flow, cost = cheapest_flow(sizes, members, quotas)
        assert abs(sum(r["taken"] for r in out) - flow) <= slack
        assert abs(sum(max(r["taken"] - r["size"], 0) for r in out) - cost) <= slack * 3
    else:
        assert sum(r["taken"] for r in out) <= total + slack


def test_documents_of_the_mix(spark, edge_docs, sf_docs):
    for docs in (edge_docs, sf_docs, overlapping(spark)[1]):
        want = Counter()
        for r in mix(docs).collect():
            want[r["id"]] += r["copies"]
        out = mixed_documents(docs)
        assert out.columns == docs.columns
        assert Counter(r["doc_id"] for r in out.collect()) == +want
