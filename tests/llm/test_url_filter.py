from collections import Counter

import duckdb
import pytest

from vecgrove.llm.url_filter import LISTED_HOSTS, OP6_SQL, build_cascade, filter_urls, op6_url_filter, universe_of, url_parts, with_membership


@pytest.mark.parametrize(("n", "shard_keys"), [(0, 100_000), (1, 100_000), (50, 100_000), (2000, 100_000), (2000, 300), (3, 50)])
def test_cascade_is_exact_over_the_universe(spark, n, shard_keys):
    keys = [f"host{i}.example" for i in range(4000)]
    universe = spark.createDataFrame([(k,) for k in [*keys, None, keys[0]]], "key string")
    listed = spark.createDataFrame([(k,) for k in [*keys[:n], "nowhere.example", None]], "key string")
    cascade = build_cascade(universe_of(listed, universe), shard_keys=shard_keys)
    assert cascade.shards == -(-4000 // shard_keys)
    out = with_membership(universe.where("key IS NOT NULL"), cascade, "key", "inside").collect()
    assert len(out) == 4001
    assert {r["key"] for r in out if r["inside"]} == set(keys[:n])
    assert n == 0 or cascade.levels > 0


def test_a_cascade_too_large_gives_way_to_a_join(spark, sf, monkeypatch):
    import vecgrove.llm.common as common

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    assert build_cascade(universe_of(listed, pages.select(url_parts(pages["url"])[0])), max_bytes=0) is None
    want = Counter(map(tuple, filter_urls(pages, listed).collect()))
    assert Counter(map(tuple, filter_urls(pages, listed, max_bytes=0).collect())) == want
    monkeypatch.setattr(common, "HOT_ROWS", 1)  # hosts of more pages are joined in place
    assert Counter(map(tuple, filter_urls(pages, listed, max_bytes=0).collect())) == want


def test_filters_are_one_broadcast_and_the_keys_are_not_joined(spark, sf):
    plan = op6_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_rules(spark):
    urls = [
        None, "", "nothing", "http://A.Example.org/es/1", "http://example.org/en/1234", "http://example.org/en/2", "http://x.org", "http://x.org/", "http://com/fr/a",
        "http://a.com/de/b", "http://a.com/de", "http://xcom/de/", "http://free.com:80/fr/", "a://b://c/d", "http://bad.net?x=/fr/", "http://bad.net#/a", "http://bad.net/p?q#r", "http://bad.net/p?q#r",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, id string")
    listed = spark.createDataFrame([("bad.net",)], "key string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, listed).collect()}
    for i in range(3):
        assert got[i] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/1234", "example.org/en/1", "block")
    assert got[5] == ("example.org", "/en/2", "org/", "allow")
    assert got[6] == ("x.org", "", None, "allow")
    assert got[7] == ("x.org", "/", "org/", "allow")
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block") and got[10][2] is None and got[11][2] is None
    assert got[12] == ("free.com:80", "/fr/", None, "allow")
    assert got[13] == ("b:", "//c/d", None, "allow")
    assert [got[i][3] for i in (14, 15, 16, 17)] == ["block"] * 4 and got[14][1] == "" and got[16][1] == "/p"


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(tuple, op6_url_filter(spark, sf).collect())) == sorted(con.sql(OP6_SQL).fetchall())


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert filter_urls(pages, spark.createDataFrame([("a",)], "key string")).count() == 0
