"""Assigning points to clusters, and the clustered database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.operators.tree import Index, descend


def assign(points: DataFrame, index: Index, n: int = 1) -> DataFrame:
    """Columns of ``points(id, vec, ...)`` and rank, cluster_id, cluster_dist of its n nearest clusters."""
    return descend(points, index.leaders, index.edges, index.levels, n)


def database(points: DataFrame, index: Index) -> DataFrame:
    """Each point with the cluster it belongs to."""
    return assign(points, index, 1).drop("rank", "cluster_dist")


def cluster_sizes(db: DataFrame) -> DataFrame:
    return db.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def save_database(db: DataFrame, path: str, mode: str = "sorted") -> None:
    """``sorted``: by range of cluster, files sorted. ``grouped``: one row per cluster and piece of 4096 points. ``both``."""
    if mode not in ("sorted", "grouped", "both"):
        raise ValueError(f"unknown mode {mode}")
    if mode in ("sorted", "both"):
        # the id splits clusters of many points over tasks
        db.repartitionByRange("cluster_id", "id").sortWithinPartitions("cluster_id", "id").write.parquet(f"{path}/sorted")
    if mode in ("grouped", "both"):
        grouped(db).write.parquet(f"{path}/grouped")


def grouped(db: DataFrame, piece: int = 4096) -> DataFrame:
    """Points of a cluster as arrays; large clusters come in several pieces of about ``piece`` points."""
    sizes = cluster_sizes(db).select("cluster_id", F.ceil(F.col("n") / piece).alias("pieces"))
    dealt = db.join(sizes, "cluster_id").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    return dealt.groupBy("cluster_id", "piece").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("points"))


def members(db: DataFrame) -> DataFrame:
    """cluster_id, ids: all ids of a cluster in order, comma-joined, in one row.

    Ranges of clusters and ids are joined to texts first, so that of a large cluster only these meet in one task.
    """
    ranged = db.select("cluster_id", "id").repartitionByRange("cluster_id", "id").withColumn("_part", F.spark_partition_id())
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    pieces = ranged.groupBy("cluster_id", "_part").agg(F.struct(F.min("id").alias("first"), texts.alias("ids")).alias("piece"))
    return pieces.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"]), ",").alias("ids"))


def ungrouped(db: DataFrame) -> DataFrame:
    return db.select("cluster_id", F.inline("points"))
