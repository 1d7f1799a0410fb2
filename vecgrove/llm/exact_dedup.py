"""Exact deduplication by a log-structured merge index of text digests.

Every row and whole text is read. ``exact_dedup`` follows the life of such an index:

* write-ahead log: ``(id, digest)`` of each row, written once to the shared folder;
* memtables: each takes at most ``memtable_rows`` rows of the log, in the log's order, and keeps, for a
  digest, the smallest order key and a count (a hot digest is one row per memtable);
* flush: each memtable becomes a run of level 0, sorted by digest;
* compaction: ``FANOUT`` runs at a time are merged into one of the next level, smallest order key and
  summed count per digest, until one run is left;
* filter: digests of two or more rows go into a bitmap of bounded size (128 MB at most), broadcast, that
  the second scan of the texts probes, so that it sends on only rows that may be hits;
* byte verification: hits are aggregated by digest *and* whole text. A digest with two texts is a
  collision; its rows are regrouped by their text.

Not kept of such an index: a filter for each run. All digests are looked up at once, so a look-up in the
runs is their merge, and only the last run's repeated digests have a filter.

Only DataFrame functions run: no Python on the executors.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z.
Of equal texts the row with the largest id stays (``keep="min"``: the smallest). Repeated rows are
members like any other, and all rows that carry the kept id are marked kept. A null id never
outranks another. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import ascii_lower, bitmap_of, join_counted, marked_by, stored, table

#: Rows of the log per memtable, and runs merged into one.
MEMTABLE_ROWS, FANOUT = 1 << 18, 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _flush(log: DataFrame, memtable_rows: int) -> DataFrame:
    """Level 0: run, digest, ord, n. The log is a written table, so its rows have fixed places in its splits."""
    place = F.monotonically_increasing_id()
    placed = log.withColumn("part", F.shiftright(place, 33)).withColumn("turn", F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}L) div {memtable_rows}"))
    level = placed.groupBy("part", "turn", "digest").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    level = stored(level.sortWithinPartitions("part", "turn", "digest"), "lsm-level0")
    turns = (level.agg(F.max("turn")).first()[0] or 0) + 1
    return level.select((F.col("part") * turns + F.col("turn")).alias("run"), "digest", "ord", "n")


def _compact(level: DataFrame, fanout: int) -> DataFrame:
    """digest, ord, n of the one run that is left."""
    last, depth = level.agg(F.max("run")).first()[0] or 0, 0
    while True:
        last, depth = last // fanout, depth + 1
        merged = level.withColumn("run", F.expr(f"run div {fanout}")).groupBy("run", "digest").agg(F.min("ord").alias("ord"), F.sum("n").alias("n"))
        level = stored(merged.sortWithinPartitions("run", "digest"), f"lsm-level{depth}")
        if not last:
            return level.drop("run")


def _hits(texts: DataFrame, level: DataFrame) -> DataFrame:
    """Rows of ``texts(id, ord, text, digest)`` that the filter lets through."""
    multi = level.where("n > 1")
    bitmap, bits = bitmap_of(multi.select(F.xxhash64("digest")), multi.count())
    return marked_by(texts, F.xxhash64("digest"), bitmap, bits).where("_vg_maybe").select("id", "ord", "text", "digest")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    memtable_rows: int = MEMTABLE_ROWS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (binary). See the module's text."""
    order = F.bitwise_not(F.col("id")) if keep == "max" else F.col("id")
    texts = (
        docs.select(docs[id_col].cast("bigint").alias("id"), ascii_lower(docs[text_col]).alias("text"))
        .withColumn("ord", order)
        .withColumn("digest", digest(F.col("text")))
    )
    log = stored(texts.select("id", "ord", "digest"), "lsm-log")
    level = _compact(_flush(log, memtable_rows), FANOUT)
    verified = stored(
        _hits(texts, level).groupBy("digest", "text").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n")).drop("text"),
        "lsm-verified",
    )
    clashing = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    rows = join_counted(log, level.withColumnRenamed("ord", "first"), "digest", "n").select("id", "first", "n", "digest")
    if clashing.limit(1).count():
        clashing = stored(clashing, "lsm-clashing")
        doubtful = texts.join(clashing, "digest", "left_semi")
        exact = doubtful.groupBy("digest", "text").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(clashing, "digest", "left_anti").unionByName(
            doubtful.join(exact, ["digest", "text"]).select("id", "first", "n", "digest")
        )
    keep_id = F.bitwise_not(F.col("first")) if keep == "max" else F.col("first")
    return rows.select(
        "id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "digest"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP4_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
