"""Top-k lists in long form: one row per (query, neighbour), totally ordered by distance and id.

Ranking is ``row_number() <= k`` over a window, which Spark runs as a partial top-k before the shuffle
and a final one after it, so a query's rows never gather in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each group, with their ``rank`` from 1."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int, by: Sequence[str] = ("qid",), dedup: bool = False) -> DataFrame:
    """k nearest of each query; with ``dedup`` an id counts once, at its smallest distance."""
    if dedup:
        df = df.groupBy(*by, "id").agg(F.min("dist").alias("dist"))
    return top(df, by, ("dist", "id"), k)


def merge(a: DataFrame, b: DataFrame, size: int, dedup: bool, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Best ``size`` of two lists."""
    columns = [*by, "id", "dist"]
    return top_k(a.select(columns).unionByName(b.select(columns)), size, by, dedup)


def merge_to_1000(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(a, b, 1000, dedup=False)


def merge_to_both(a: DataFrame, b: DataFrame, size_a: int, size_b: int) -> DataFrame:
    return merge(a, b, size_a + size_b, dedup=True)


def merge_to_larger(a: DataFrame, b: DataFrame, size_a: int, size_b: int) -> DataFrame:
    return merge(a, b, max(size_a, size_b), dedup=True)


def as_text(df: DataFrame, by: str = "qid") -> DataFrame:
    """A text block per query: its id, an empty line, then ``rank id dist`` lines, rank from 0."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))),
        lambda s: F.concat_ws(" ", (s["rank"] - 1).cast("string"), s["id"].cast("string"), s["dist"].cast("string")),
    )
    return df.groupBy(by).agg(F.concat(F.col(by).cast("string"), F.lit("\n\n"), F.array_join(lines, "\n")).alias("body"))


def nested(df: DataFrame, by: str = "qid") -> DataFrame:
    """Neighbours of a query as one array of (dist, id), nearest first."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dist", "id"))).alias("neighbours"))


def contains(neighbours: Column, wanted: Column) -> Column:
    return F.exists(neighbours, lambda s: s["id"] == wanted)


def vote(df: DataFrame, query: str = "query_image", image: str = "image_id", prune_over: int | None = None) -> DataFrame:
    """One vote per row. ``prune_over``: of more candidates than this, those with one vote go if over 30 have more."""
    votes = df.groupBy(query, image).agg(F.count(F.lit(1)).alias("votes"))
    if prune_over is None:
        return votes
    w = W.partitionBy(query)
    kept = votes.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("strong", F.count_if(F.col("votes") > 1).over(w))
    return kept.where(~((F.col("n") > prune_over) & (F.col("strong") > 30)) | (F.col("votes") > 1)).select(query, image, "votes")


def shortlist(votes: DataFrame, m: int, query: str = "query_image", image: str = "image_id") -> DataFrame:
    """The m images with the most votes, in descending order."""
    return top(votes, (query,), (F.desc("votes"), F.col(image)), m)
