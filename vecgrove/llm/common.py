"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.sources.shared import forget, stored

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What this worker keeps between tasks of one operator.
_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any] = lambda: None) -> Any:
    """Made once per worker. Workers are reused by other operators, whose first task drops it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


_LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


#: Rows of an Arrow batch of texts; Spark's own 10,000 can be hundreds of megabytes of them.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batched(texts: DataFrame) -> DataFrame:
    """``texts``, which Python is about to read: the session's batches get small unless it set a size itself."""
    conf = texts.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def lower_bytes(text: bytes) -> bytes:
    return text.translate(_LOWER_BYTES)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


#: Tables of at most this many short rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_IDS = 250_000


def sendable(small: DataFrame) -> DataFrame:
    """A table of short rows, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


#: A key with more rows than this is hot: its rows are joined where they are instead of being gathered.
HOT_ROWS = 1 << 17


def join_counted(big: DataFrame, small: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join on ``key``, unique in ``small``, whose column ``n`` counts the key's rows in ``big``.

    Hot keys, one in ``HOT_ROWS`` rows of ``big`` at most, are sent to all executors.
    """
    hot = F.col(n) > HOT_ROWS
    few = small.where(hot)
    if not few.limit(1).count():
        return big.join(small, key)
    few = sendable(few)
    rest = big.join(few.select(key), key, "left_anti").join(small.where(~hot), key)
    return big.join(few, key).unionByName(rest)


def row_hash(text: Column) -> Column:
    """With the id, tells rows apart: ids may be null or repeated."""
    return F.xxhash64(text)


#: Bits of one row of a bitmap, as bitmap_construct_agg makes them.
BITMAP = 32768
#: A bitmap never has more bits than this (128 MB); beyond, it only lets more rows through.
MAX_BITS = 1 << 30


def bitmap_of(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bitmap over the one column of ``hashes``, n of them, in rows (block, bitmap), and its size in bits."""
    bits = BITMAP
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    slots = hashes.toDF("h").select(F.pmod("h", F.lit(bits)).alias("slot"))
    made = slots.groupBy(F.floor(F.col("slot") / BITMAP).cast("int").alias("_vg_block")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("_vg_bitmap"))
    return made, bits


def marked_by(df: DataFrame, h: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """``df`` with a column _vg_maybe: the hash is in the bitmap, or shares its bit with one that is."""
    slot = F.pmod(h, F.lit(bits))
    at = slot % BITMAP
    byte = F.conv(F.hex(F.substring("_vg_bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(bitmap), F.floor(slot / BITMAP).cast("int") == F.col("_vg_block"), "left")
    return joined.withColumn("_vg_maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_vg_block", "_vg_bitmap")


def without_rows(docs: DataFrame, rows: DataFrame, mark: Column, key: str = "doc_id") -> DataFrame:
    """``docs`` without ``rows(id, mark)``; ``mark`` is the second column's value of a row of ``docs``.

    Few rows are sent to all executors. Of many, a bitmap of bounded size is: what it does not let through
    stays where it is, and only the rest, hardly more than what goes, is shuffled for an exact anti join.
    """
    rows = rows.distinct().toDF("_vg_key", "_vg_mark")
    gone = docs[key].eqNullSafe(F.col("_vg_key")) & (mark == F.col("_vg_mark"))
    n = rows.count()
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(rows), gone, "left_anti")
    bitmap, bits = bitmap_of(rows.select(F.xxhash64("_vg_key", "_vg_mark")), n)
    split = marked_by(docs, F.xxhash64(docs[key].cast("bigint"), mark), stored(bitmap, "rows-bitmap"), bits)
    sure = split.where("NOT _vg_maybe").drop("_vg_maybe")
    return sure.unionByName(split.where("_vg_maybe").drop("_vg_maybe").join(rows, gone, "left_anti"))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of ``df`` with the smallest hash of ``key``; all of them where there are no more.

    A cut on the hash leaves little over n rows before they are ordered, so that no task sends n rows.
    """
    total = df.count()
    h = F.xxhash64(key)
    if total > 4 * n:
        share = 1.25 * n / total + 100 / total
        df = df.where(h < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return df.orderBy(h, key).limit(n)
