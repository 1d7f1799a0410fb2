"""Hubness: how often a point occurs among the neighbours of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hubness(knn: DataFrame) -> DataFrame:
    """id, hubness, max_dist of every point that is some query's neighbour."""
    return knn.groupBy("id").agg(F.count(F.lit(1)).alias("hubness"), F.max("dist").alias("max_dist"))


def merge_hubness(parts: DataFrame) -> DataFrame:
    """Hubness tables of several batches, as one."""
    return parts.groupBy("id").agg(F.sum("hubness").alias("hubness"), F.max("max_dist").alias("max_dist"))


def inverted(knn: DataFrame) -> DataFrame:
    return knn.select(F.col("id").alias("nn_id"), "qid", "dist")


def with_hubness(knn: DataFrame, hubs: DataFrame) -> DataFrame:
    """Neighbours with their own hubness; 0 where they have none."""
    return (
        inverted(knn)
        .join(hubs.withColumnRenamed("id", "nn_id"), "nn_id", "left")
        .select("qid", "nn_id", "dist", F.coalesce("hubness", F.lit(0)).alias("hubness"), F.coalesce("max_dist", F.lit(0)).alias("max_dist"))
    )


def top_hubs(hubs: DataFrame, x: int) -> DataFrame:
    return hubs.orderBy(F.desc("hubness"), "id").limit(x)


def never_neighbours(points: DataFrame, hubs: DataFrame) -> DataFrame:
    """Points that are no query's neighbour."""
    return points.select("id").join(hubs.select("id"), "id", "left_anti")


def only(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among the ids."""
    wanted = ids.toDF("_wanted")
    return table.join(wanted, table[key] == wanted["_wanted"], "left_semi")


def hub_stats(hubs: DataFrame, equal_to: int = 1) -> DataFrame:
    """One row: largest, smallest and total hubness, points, the id with the smallest, points with hubness ``equal_to``; 0 if empty."""
    zero = F.lit(0).cast("bigint")
    return hubs.agg(
        F.coalesce(F.max("hubness"), zero).alias("max_hubness"),
        F.coalesce(F.min("hubness"), zero).alias("min_hubness"),
        F.coalesce(F.sum("hubness"), zero).alias("total"),
        F.count(F.lit(1)).alias("points"),
        F.min(F.struct("hubness", "id"))["id"].alias("min_id"),
        F.count_if(F.col("hubness") == equal_to).alias("n_equal"),
    )
