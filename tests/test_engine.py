"""Operators against brute force and against each other."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vecgrove.operators import assign as A
from vecgrove.operators import knn as N
from vecgrove.operators import topk as T
from vecgrove.operators.tree import build_tree, cluster_paths, descend, descend_joins, sample_leaders
from vecgrove.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows or name in ("no_hub_points", "hubness_study")
    if name not in registry.ORACLE_SQL:
        return
    want = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)

    def norm(x):
        return round(x, 9) if isinstance(x, float) else x

    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in rows) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_members_of_a_large_cluster_in_one_row(spark, tmp_path):
    """More than 4096 points in a cluster, beside small ones; ids not in the order of their text."""
    far = "array(float((id % 23) / 25), float((id % 7) / 9), float((id % 3) / 4))"
    rows = spark.range(10500).selectExpr("id AS vec_id", f"if(id < 9000, array(float(0.5), float(0.5), float(0)), {far}) AS embedding", "int(id % 10) AS label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in registry.QUERIES["cluster_members_sorted"](spark, str(tmp_path)).select("cluster_id", "ids").collect()}
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(registry.ORACLE_SQL["cluster_members_sorted"]).select("cluster_id, ids").fetchall()
    assert max(ids.count(",") for _, ids in want) > 2 * 4096 and len(want) > 1
    assert got == set(want)


def test_scores_are_rounded_as_sql_does(spark):
    """Scores halfway between two texts, which go to the even digit, and random ones."""
    from vecgrove.functions.vectors import score_text, selection_score

    pairs = [(63, 64), (61, 64), (59, 64), (23091, 34368), (0, 5), (7, 7), (1, 10**12), (753087, 1_000_000), (999_999, 1_000_000)]
    pairs += [(x, 1 << 17) for x in range((1 << 17) - 5000, 1 << 17)]
    pairs += [(int(d * s), int(d)) for d, s in zip(*np.random.default_rng(5).random((2, 5000)) * [[90000], [1]] + [[1], [0]], strict=True)]
    rows = spark.createDataFrame(pairs, "best bigint, dist bigint")
    got = rows.select("best", "dist", score_text(selection_score(F.col("dist"), F.col("best"))).alias("text")).collect()
    wrong = [(r, f"{0.5 - r.best / (2 * r.dist):.6f}") for r in got if r.text != f"{0.5 - r.best / (2 * r.dist):.6f}"]
    assert not wrong
    leaders = spark.createDataFrame([(0, [7, 3, 2, 1]), (1, [8, 0, 0, 0])], "leader_id bigint, vec array<int>")
    point = spark.createDataFrame([(1, [0, 0, 0, 0])], "id bigint, vec array<int>")
    assert cluster_paths(point, build_tree(leaders, 1), 2).first()["path"] == "|0:0.000000,1:0.007812"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "exact_knn" in entry.queries()


def random_vectors(spark, n, d, seed, low=-5, high=5):
    x = np.random.default_rng(seed).integers(low, high, (n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<int>")


def brute_knn(x, q, k):
    d = ((q[:, None, :] - x[None]) ** 2).sum(2)
    return {(j, r + 1, int(i), int(d[j, i])) for j in range(len(q)) for r, i in enumerate(np.lexsort((np.arange(len(x)), d[j]))[:k])}


@pytest.mark.parametrize("k", [1, 7, 500])
def test_exact_knn_with_many_ties(spark, k):
    x, db = random_vectors(spark, 300, 3, 1)
    q, qs = random_vectors(spark, 20, 3, 2)
    got = {tuple(r) for r in N.exact_knn(db.repartition(5), qs.withColumnRenamed("id", "qid"), k).collect()}
    assert got == brute_knn(x, q, k)


def test_queries_in_several_parts(spark, monkeypatch):
    x, db = random_vectors(spark, 200, 4, 3)
    q, qs = random_vectors(spark, 30, 4, 4)
    monkeypatch.setattr(N, "MAX_QUERY_BYTES", 700)
    assert {tuple(r) for r in N.exact_knn(db, qs.withColumnRenamed("id", "qid"), 4).collect()} == brute_knn(x, q, 4)
    assert {tuple(r) for r in N.exact_knn_columns(db, qs.withColumnRenamed("id", "qid"), 4).collect()} == brute_knn(x, q, 4)


def test_knn_by_columns_ranks_few_pairs(spark, monkeypatch):
    """Of all pairs only those within a bound are ranked, and no neighbour is lost."""
    x, db = random_vectors(spark, 3000, 8, 21, -100, 100)
    q, qs = random_vectors(spark, 60, 8, 22, -100, 100)
    ranked = []
    monkeypatch.setattr(N, "top_k", lambda df, k, f=N.top_k: ranked.append(df.count()) or f(df, k))
    got = {tuple(r) for r in N.exact_knn_columns(db, qs.withColumnRenamed("id", "qid"), 4).collect()}
    assert got == brute_knn(x, q, 4)
    assert len(got) <= sum(ranked) < 3000 * 60 / 20


@pytest.mark.parametrize(("low", "high", "d"), [(-128, 128, 5), (-2, 2, 4), (-30000, 30000, 3), (-(10**9), 10**9, 2), (0, 1, 3), (5, 6, 1)])
def test_knn_by_columns_of_any_values(spark, low, high, d):
    """Small values in columns, odd lengths, large ones as arrays; many ties, more neighbours asked than there are."""
    x, db = random_vectors(spark, 700, d, 23, low, high)
    q, qs = random_vectors(spark, 9, d, 24, low, high)
    for k in (1, 6, 900):
        assert {tuple(r) for r in N.exact_knn_columns(db, qs.withColumnRenamed("id", "qid"), k).collect()} == brute_knn(x, q, k)


def test_knn_by_columns_of_odd_rows(spark):
    """Vectors of another length, without values or null match nothing; empty tables."""
    x, db = random_vectors(spark, 50, 3, 25)
    q, qs = random_vectors(spark, 5, 3, 26)
    qs = qs.withColumnRenamed("id", "qid")
    odd = spark.sql("SELECT id, vec FROM VALUES (900L, array(1, 2)), (901L, null), (902L, array(1, null, 2)), (903L, array()) AS t(id, vec)")
    more = qs.unionByName(odd.withColumnRenamed("id", "qid").where("qid <> 900 AND qid <> 903"))
    assert {tuple(r) for r in N.exact_knn_columns(db.unionByName(odd), more, 4).collect()} == brute_knn(x, q, 4)
    assert N.exact_knn_columns(db.limit(0), qs, 3).count() == N.exact_knn_columns(db, qs.limit(0), 3).count() == 0


@pytest.mark.parametrize(("points", "visits", "kept"), [(1 << 16, 1 << 13, 2_000_000), (20, 7, 2_000_000), (20, 7, 15)])
def test_strategies_agree(spark, monkeypatch, points, visits, kept):
    """Both sides dealt in pieces of any size, lists handed on early: the same rows as with the queries sent."""
    x, db = random_vectors(spark, 400, 3, 8)
    q, qs = random_vectors(spark, 50, 3, 9)
    qs = qs.withColumnRenamed("id", "qid")
    index = build_tree(sample_leaders(db, 12), 1)
    clustered = A.database(db, index)
    want = {tuple(r) for r in N.approx_knn(clustered, qs, index, 4, 6, strategy="broadcast").collect()}
    wide = {tuple(r) for r in N.approx_knn(clustered, qs, index, 4, 6, limit=20, strategy="broadcast").collect()}
    monkeypatch.setattr(N, "POINTS", points)
    monkeypatch.setattr(N, "VISITS", visits)
    monkeypatch.setattr(N, "MAX_KEPT", kept)
    for way in ("broadcast", "shuffle"):
        assert {tuple(r) for r in N.approx_knn(clustered, qs, index, 4, 6, strategy=way).collect()} == want
        assert {tuple(r) for r in N.approx_knn(clustered, qs, index, 4, 6, limit=20, strategy=way).collect()} == wide
        assert {tuple(r) for r in N.exact_knn(db, qs, 9, strategy=way).collect()} == brute_knn(x, q, 9)
        twice = db.unionByName(db).unionByName(db.where("id < 30"))
        assert {tuple(r) for r in N.exact_knn(twice, qs, 9, dedup=True, strategy=way).collect()} == brute_knn(x, q, 9)
    assert N.exact_knn(db.limit(0), qs, 3, strategy="shuffle").count() == N.exact_knn(db, qs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        N.exact_knn(db, qs, 3, strategy="no")


def test_batches_are_a_column(spark):
    _, db = random_vectors(spark, 200, 3, 8)
    q = db.limit(40).withColumnRenamed("id", "qid")
    index = build_tree(sample_leaders(db, 12), 1)
    clustered = A.database(db, index)
    out = N.batched_knn(clustered, q, index, 3, 4, 10)
    assert sorted(map(tuple, out.drop("batch").collect())) == sorted(map(tuple, N.approx_knn(clustered, q, index, 3, 4).collect()))
    assert {r["batch"] for r in out.collect()} == {0, 1, 2, 3}
    assert out.select("qid", "batch").distinct().count() == q.select("qid").distinct().count()


def test_one_id_of_many_copies(spark):
    """An id with far more copies than k still counts once, and others get their places."""
    db = spark.createDataFrame([(7, [0, 0])] * 3000 + [(i, [i, 0]) for i in range(20, 30)], "id bigint, vec array<int>")
    q = spark.createDataFrame([(1, [0, 0])], "qid bigint, vec array<int>")
    assert [r["id"] for r in N.exact_knn(db, q, 4, dedup=True).orderBy("rank").collect()] == [7, 20, 21, 22]


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_sample_of_leaders(spark, monkeypatch, few):
    import hashlib

    import vecgrove.operators.tree as tree

    monkeypatch.setattr(tree, "FEW", few)
    v = spark.range(3000).selectExpr("id", "array(int(id)) AS vec")
    for n in (1, 40, 900, 2999, 5000):
        got = [(r["leader_id"], r["id"]) for r in sample_leaders(v, n).orderBy("leader_id").collect()]
        want = sorted(range(3000), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:n]
        assert got == list(enumerate(want))


def test_index_of_wide_values_and_bytes_agree(spark):
    """Vectors of signed bytes are kept as bytes; larger values as they are."""
    x, db = random_vectors(spark, 300, 4, 3, -128, 128)
    big = db.selectExpr("id", "transform(vec, v -> v * 1000) AS vec")
    a, b = build_tree(sample_leaders(db, 20), 2), build_tree(sample_leaders(big, 20), 2)
    assert a.edges.exceptAll(b.edges).count() == 0
    one = descend(db, a.leaders, a.edges, 2, 2).selectExpr("id", "rank", "cluster_id", "cluster_dist * 1000000 AS d")
    assert sorted(one.collect()) == sorted(descend(big, b.leaders, b.edges, 2, 2).selectExpr("id", "rank", "cluster_id", "cluster_dist").collect())


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_descent_equals_joins(spark, levels):
    _, v = random_vectors(spark, 150, 3, 5)  # small range: many equal distances
    index = build_tree(sample_leaders(v, 40), levels, 2)
    a = descend(v, index.leaders, index.edges, levels, 3).select("id", "rank", "cluster_id", "cluster_dist")
    b = descend_joins(v, index.leaders, index.edges, levels, 3).select("id", "rank", "cluster_id", "cluster_dist")
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_children_compared_some_at_a_time(spark, levels):
    import vecgrove.operators.tree as tree

    x, v = random_vectors(spark, 300, 2, 12, -3, 3)  # many ties
    index = build_tree(sample_leaders(v, 60), levels, 2)
    held = tree.packed(index.leaders, index.edges, levels)
    want = [c.tolist() for c in held.search(x.astype(float), 5, levels)]
    for some in (1, 7, 59):
        tree._KIDS, before = some, tree._KIDS
        try:
            assert sorted(zip(*held.search(x.astype(float), 5, levels), strict=True)) == sorted(zip(*want, strict=True))
        finally:
            tree._KIDS = before


def test_index_too_large_to_send(spark, monkeypatch):
    import vecgrove.operators.tree as tree

    _, v = random_vectors(spark, 80, 3, 6)
    index = build_tree(sample_leaders(v, 20), 2, 3)
    a = sorted(descend(v, index.leaders, index.edges, 2, 2).select("id", "rank", "cluster_id").collect())
    monkeypatch.setattr(tree, "MAX_INDEX_BYTES", 0)
    assert a == sorted(tree.descend(v, index.leaders, index.edges, 2, 2).select("id", "rank", "cluster_id").collect())


def test_beam_over_all_nodes_is_the_flat_search(spark):
    _, v = random_vectors(spark, 300, 3, 6)
    index = build_tree(sample_leaders(v, 30), 3, 2)
    flat = build_tree(sample_leaders(v, 30), 1)
    want = sorted(descend(v, flat.leaders, flat.edges, 1, 7).select("id", "rank", "cluster_id", "cluster_dist").collect())
    assert sorted(descend(v, index.leaders, index.edges, 3, 7, beam=30).select("id", "rank", "cluster_id", "cluster_dist").collect()) == want


def test_deep_tree_finds_nine_in_ten(spark, sf):
    got = {r["beam"]: r["recall"] for r in registry.QUERIES["deep_recall"](spark, sf).collect()}
    assert got[1] < got[3] < got[7] and got[7] >= 0.9


@pytest.mark.parametrize("beam", [1, 3])
@pytest.mark.parametrize("levels", [1, 2, 3])
def test_index_dealt_in_parts(spark, monkeypatch, levels, beam):
    """With all levels, the upper ones or none sent, repeated rows and pieces of any size: the same rows; queries too."""
    import vecgrove.operators.tree as tree

    _, v = random_vectors(spark, 200, 3, 6)
    index = build_tree(sample_leaders(v, 30), levels, 3)
    v = v.unionByName(v.limit(20)).withColumn("extra", F.lit("x"))
    q = v.limit(25).withColumnRenamed("id", "qid")
    want = sorted(map(str, descend(v, index.leaders, index.edges, levels, 3, beam).collect()))
    asked = sorted(map(str, N.visits(q, index, 2, beam).collect()))
    monkeypatch.setattr(N, "POINTS", 7)
    monkeypatch.setattr(N, "VISITS", 9)
    for most in (600, 0):
        monkeypatch.setattr(tree, "MAX_INDEX_BYTES", most)
        assert sorted(map(str, tree.descend(v, index.leaders, index.edges, levels, 3, beam).collect())) == want
        assert sorted(map(str, N.visits(q, index, 2, beam).collect())) == asked


def test_flat_index_with_all_clusters_is_exact_and_recall_grows(spark, sf):
    from vecgrove.plans.queries import _setup

    v, q, index, db = _setup(spark, sf)
    exact = N.exact_knn(v, q, 5).cache()
    assert sorted(N.approx_knn(db, q, index, 60, 5).collect()) == sorted(exact.collect())
    seen = [N.recall(N.approx_knn(db, q, index, b, 5), exact).first()[0] for b in (1, 5, 20, 48)]
    assert seen == sorted(seen) and seen[-1] >= 0.9


def test_small_indexes(spark):
    _, v = random_vectors(spark, 10, 2, 7)
    for n, levels in ((1, 1), (1, 3), (3, 2)):
        index = build_tree(sample_leaders(v, n), levels)
        assert A.database(v, index).count() == 10
    with pytest.raises(ValueError):
        build_tree(sample_leaders(v, 3), 0)
    assert descend(v.limit(0), index.leaders, index.edges, 2, 2).count() == 0


def test_vectors_of_other_length_match_nothing(spark):
    db = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 2, 1])], "id bigint, vec array<int>")
    q = spark.createDataFrame([(9, [1, 2])], "qid bigint, vec array<int>")
    assert N.exact_knn(db, q, 3).count() == 0 and N.exact_knn_columns(db, q, 3).count() == 0


def test_vote_pruning_and_shortlist(spark):
    rows = [("a", i) for i in range(50)] + [("a", i) for i in range(35)] + [("b", 1), ("b", 2)]
    df = spark.createDataFrame(rows, "query_image string, image_id int")
    assert T.vote(df).count() == 52
    assert T.vote(df, prune_over=40).count() == 37
    got = T.shortlist(T.vote(df), 2).orderBy("query_image", "rank").collect()
    assert [(r["query_image"], r["image_id"], r["votes"]) for r in got] == [("a", 0, 2), ("a", 1, 2), ("b", 1, 1), ("b", 2, 1)]


def test_lookup_pieces(spark):
    seen = spark.createDataFrame([(i % 2, i) for i in range(100)], "cluster_id bigint, qid bigint")
    pieces = N.lookup(seen, piece=10).collect()
    assert len(pieces) > 4 and sorted(q for r in pieces for q in r["qids"]) == list(range(100))
    assert all(q % 2 == r["cluster_id"] for r in pieces for q in r["qids"]) and len(N.lookup(seen).collect()) == 2


def test_grouped_pieces(spark):
    db = spark.createDataFrame([(i % 2, i, [i]) for i in range(100)], "cluster_id bigint, id bigint, vec array<int>")
    pieces = A.grouped(db, piece=10)
    assert pieces.count() > 2
    assert sorted(map(str, A.ungrouped(pieces).collect())) == sorted(map(str, db.collect()))
