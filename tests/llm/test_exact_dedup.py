import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from vecgrove.llm.exact_dedup import exact_dedup

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, best=max):
    norm = [(i, (t or "").translate(str.maketrans(UP, LOW))) for i, t, *_ in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in df.collect()), key=repr)


def test_edges(edge_docs, edge_rows):
    assert got(exact_dedup(edge_docs)) == brute(edge_rows)
    assert got(exact_dedup(edge_docs, keep="min")) == brute(edge_rows, min)


def test_tables(sf_docs, sf_rows):
    assert got(exact_dedup(sf_docs)) == brute(sf_rows)


def test_byte_verification_separates_clashing_digests(edge_docs, edge_rows):
    weak = exact_dedup(edge_docs, digest=lambda t: F.unhex(F.lit("00")))
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in weak.collect() if r["id"] is not None) == sorted(
        x[:4] for x in brute(edge_rows) if x[0] is not None
    )


def test_empty(empty_docs):
    assert exact_dedup(empty_docs).count() == 0


def test_many_small_memtables(sf_docs, sf_rows, edge_docs, edge_rows):
    """Several flushes a partition and several levels of compaction."""
    assert got(exact_dedup(sf_docs.repartition(7), memtable_rows=2)) == brute(sf_rows)
    assert got(exact_dedup(edge_docs, memtable_rows=1)) == brute(edge_rows)


def test_memtables_hold_their_bound_and_levels_merge(spark):
    from vecgrove.llm import exact_dedup as E

    log = E.stored(spark.range(1000).select("id", F.col("id").alias("ord"), F.sha2((F.col("id") % 300).cast("string"), 256).cast("binary").alias("digest")).repartition(3), "log")
    level = E._flush(log, 10)
    sizes = [r["rows"] for r in level.groupBy("run").agg(F.sum("n").alias("rows")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 10 and len(sizes) >= 100
    merged = E._compact(level, 4)
    assert merged.count() == 300 and merged.agg(F.sum("n")).first()[0] == 1000
    assert {r["ord"] for r in merged.collect()} == set(range(300))


def test_hot_digests_are_joined_in_place(sf_docs, sf_rows, monkeypatch):
    from vecgrove.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert got(exact_dedup(sf_docs)) == brute(sf_rows)
