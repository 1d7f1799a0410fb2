"""Image search by votes of descriptors, and by bags of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.operators.assign import database
from vecgrove.operators.knn import scan, visits
from vecgrove.operators.merge import merge_databases
from vecgrove.operators.topk import shortlist, top, vote
from vecgrove.operators.tree import Index


def image_votes(db: DataFrame, queries: DataFrame, index: Index, b: int, k: int, prune_over: int | None = None) -> DataFrame:
    """query_image, image_id, votes.

    ``db(cluster_id, id, image_id, vec)``, ``queries(qid, query_image, vec)``. The order of steps matters:
    k nearest per query point and cluster, images counted as often as they come; then each image once per
    query point at its smallest distance; then the k nearest of those; then a vote for each.
    """
    near = scan(db, visits(queries, index, b), k, per_cluster=True, tie="image_id").withColumnRenamed("tie", "image_id")
    best = near.groupBy("qid", "image_id").agg(F.min("dist").alias("dist"))
    kept = top(best, ("qid",), ("dist", "image_id"), k)
    return vote(kept.join(queries.select("qid", "query_image"), "qid"), prune_over=prune_over)


def search_images(db: DataFrame, queries: DataFrame, index: Index, b: int, k: int, m: int) -> DataFrame:
    """The m images with the most votes, with the query points that the image has."""
    points = queries.groupBy("query_image").agg(F.count(F.lit(1)).alias("n_points"))
    return shortlist(image_votes(db, queries, index, b, k), m).join(points, "query_image")


def extend_database(db: DataFrame, points: DataFrame, index: Index, mode: str = "full") -> DataFrame:
    """``db(cluster_id, id, image_id, vec)`` with the points of new images, ``points(id, image_id, vec)``, each in its cluster."""
    return merge_databases(db, database(points, index).select(db.columns), mode)


def bag_of_features(db: DataFrame) -> DataFrame:
    """cluster_id, image_id, once each; vectors are not read."""
    return db.select("cluster_id", "image_id").distinct()


def bag_votes(bags: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """Each image present in the cluster of a query point gets one vote."""
    asked = visits(queries, index, 1).select("cluster_id", "qid").join(queries.select("qid", "query_image"), "qid")
    # points of one image in one cluster vote alike: count them before the join
    asked = asked.groupBy("cluster_id", "query_image").agg(F.count(F.lit(1)).alias("points"))
    return bags.join(asked, "cluster_id").groupBy("query_image", "image_id").agg(F.sum("points").alias("votes"))
