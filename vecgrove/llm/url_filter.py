"""URL filtering by rules and a Bloom filter cascade.

The first level encodes the listed keys; the second the keys of the corpus that the first wrongly
accepts; the third the listed keys that the second wrongly accepts, and so on until a level makes no
mistake over the corpus's complete key universe. The number of levels that accept a key in a row then
tells its membership exactly, without a join with the keys.

Keys are dealt by hash into shards of about ``SHARD_KEYS``, each with a cascade of its own. Levels are
built by aggregates over the distinct keys and never leave the executors but as one broadcast table with
a row per shard: its filters as arrays of words. That table's size is counted; beyond
``max_bytes`` the keys are joined instead, hosts of many pages in place.

Only DataFrame functions run: no Python on the executors.

Defined results: a url without ``://`` (or null) has empty host and path and, matching no rule, gets
the method's verdict for the empty host. Keys that occur in no page are outside the universe and
never asked. Repeated rows get the same verdict. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import UPPER, join_counted, stored, table

#: What all levels together may take, as they are sent to all executors.
MAX_FILTER_BYTES = 64 << 20
#: False positive rate aimed at: first level, later levels.
RATES = (0.01, 0.25)
#: Keys per shard.
SHARD_KEYS = 1 << 17

# The rules of the query, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The listed hosts are these names under these prefixes and suffixes.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_PREFIXES = ("", "www.", "m.", "blog.")
LISTED_SUFFIXES = (".example.com", ".example.net", ".example.org")
LISTED_HOSTS = tuple(p + n + s for n in LISTED_NAMES for p in LISTED_PREFIXES for s in LISTED_SUFFIXES)


@dataclass(frozen=True)
class Cascade:
    """``filters`` has a row per shard: shard, and per level the struct l<i> of bits and words, or null."""

    filters: DataFrame
    levels: int
    shards: int
    hashes: tuple[int, ...]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def _positions(key: Column, bits: Column, hashes: int, level: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(2 * level)), bits)
    step = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), bits)
    return [(first + F.lit(i) * step) % bits for i in range(hashes)]


def _accepts(key: Column, held: Column, hashes: int, level: int) -> Column:
    """``held`` is the level's struct for the key's shard; a shard without keys at that level accepts none."""
    words = held["words"]
    tests = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(key, held["bits"], hashes, level)]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _build(keys: DataFrame, rate: float, level: int) -> tuple[DataFrame, int]:
    """shard, l<level> of ``keys(key, shard)``, and the number of hashes."""
    hashes = max(1, round(-math.log2(rate)))
    words = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * (-math.log2(rate) / math.log(2) / 64)))
    sizes = stored(keys.groupBy("shard").agg((64 * words).cast("bigint").alias("bits")), "cascade-sizes")
    at = F.explode(F.array_distinct(F.array(*_positions(F.col("key"), F.col("bits"), hashes, level))))
    placed = keys.join(F.broadcast(sizes), "shard").select("shard", at.alias("p"))
    ones = placed.select("shard", F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, int(p % 64))").alias("value"))
    none = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("bits div 64 - 1"))).alias("word"), F.lit(0).cast("bigint").alias("value"))
    filled = ones.unionByName(none).groupBy("shard", "word").agg(F.bit_or("value").alias("value"))
    held = filled.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("word", "value"))).alias("at"))
    held = held.select("shard", F.transform("at", lambda x: x["value"]).alias("words")).join(F.broadcast(sizes), "shard")
    return stored(held.select("shard", F.struct("bits", "words").alias(f"l{level}")), "cascade-level"), hashes


def universe_of(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """key, n (its rows in ``universe``), listed: every key of the one column of ``universe``."""
    counted = universe.toDF("key").where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    named = listed.toDF("key").where("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    return stored(counted.join(named, "key", "left").select("key", "n", F.coalesce("listed", F.lit(False)).alias("listed")), "cascade-keys")


def build_cascade(keys: DataFrame, rates: tuple[float, float] = RATES, max_bytes: int = MAX_FILTER_BYTES, shard_keys: int = SHARD_KEYS) -> Cascade | None:
    """The filters for ``keys(key, listed)``, exact over all of them; None where they would be larger than ``max_bytes``."""
    spark = keys.sparkSession
    shards = max(1, -(-keys.count() // shard_keys))
    dealt = keys.select("key", "listed", _shard(F.col("key"), shards).alias("shard"))
    inside, outside = dealt.where("listed").select("key", "shard"), dealt.where("NOT listed").select("key", "shard")
    filters, hashes, size = spark.range(shards).select(F.col("id").alias("shard")), [], 0
    while inside.limit(1).count():
        level = len(hashes)
        held, k = _build(inside, rates[min(level, 1)], level)
        size += held.agg(F.sum(F.size(f"l{level}.words"))).first()[0] * 8
        if size > max_bytes:
            return None
        filters = filters.join(F.broadcast(held), "shard", "left")
        hashes.append(k)
        # those of the other side that this level wrongly accepts go into the next
        wrong = outside.join(F.broadcast(held), "shard").where(_accepts(F.col("key"), F.col(f"l{level}"), k, level)).select("key", "shard")
        inside, outside = stored(wrong, "cascade-wrong"), inside
    return Cascade(stored(filters, "cascade"), len(hashes), shards, tuple(hashes))


def with_membership(df: DataFrame, cascade: Cascade, key: str, name: str) -> DataFrame:
    """``df`` with a boolean column: true if an odd number of levels accept the key, of the universe, in a row."""
    out = F.lit(cascade.levels % 2 == 1)
    for i in reversed(range(cascade.levels)):
        out = F.when(_accepts(F.col(key), F.col(f"l{i}"), cascade.hashes[i], i), out).otherwise(F.lit(i % 2 == 1))
    joined = df.withColumn("_vg_shard", _shard(F.col(key), cascade.shards)).join(F.broadcast(cascade.filters.withColumnRenamed("shard", "_vg_shard")), "_vg_shard")
    return joined.withColumn(name, out if cascade.levels else F.lit(False)).select(*df.columns, name)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and where ``://`` is missing."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def _rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        name = F.when(fits, F.lit(at + start)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    max_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """id, host, path, rule, listed, verdict of each page. ``listed`` has one column of hosts."""
    host, path = url_parts(pages[url_col])
    parts = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    keys = universe_of(listed, parts.select("host"))
    cascade = build_cascade(keys, max_bytes=max_bytes)
    if cascade is None:
        asked = join_counted(parts, keys.withColumnRenamed("key", "host"), "host", "n").select(*parts.columns, "listed")
    else:
        asked = with_membership(parts, cascade, "host", "listed")
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    return (
        asked.withColumn("rule", name)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))))
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its verdict."""
    listed = spark.range(1).select(F.explode(F.split(F.lit(" ".join(LISTED_HOSTS)), " ")).alias("key"))
    return filter_urls(table(spark, sf_dir, "pages"), listed).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


_LISTED_SQL = ", ".join(f"'{h}'" for h in LISTED_HOSTS)
OP6_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IN ('com/fr/', 'org/') THEN 'allow'
  WHEN host IN ({_LISTED_SQL}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
