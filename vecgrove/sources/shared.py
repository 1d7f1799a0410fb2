"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecgrove.sources import files

#: Tables of at most this many short rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_ROWS = 250_000


def base_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a single-JVM session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vecgrove-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Folders of applications that are removed when their driver ends.
_LEAVING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among the shared ones; it goes when the driver's JVM ends."""
    path = f"{base_dir(spark)}/vecgrove-{spark.sparkContext.applicationId}"
    if path not in _LEAVING:
        _LEAVING.add(path)
        files.delete_at_end(spark, path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    files.delete(df.sparkSession, df._stored_at, recursive=True)


def sendable(small: DataFrame) -> DataFrame:
    """A table of short rows, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with a column of numbers from 0 in a total order: by ranges, then within each, so that no task holds all rows."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    first, rows = 0, []
    for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # as many as partitions
        rows.append((r["_part"], first))
        first += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "_part int, _first bigint")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_no", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_no") + F.col("_first")).drop("_part", "_first", "_no")
