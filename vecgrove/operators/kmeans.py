"""Ground-truth vectors and their k-means clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.operators.tree import matrix, sample_leaders


def ground_truth_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """desc_id, query_id, vec for ``pairs(query_id, desc_id)``."""
    return pairs.join(vectors.select(F.col("id").alias("desc_id"), "vec"), "desc_id").select("desc_id", "query_id", "vec")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that each row is nearest to; of equal ones the first."""
    out = np.empty(len(x), np.int64)
    step = max(1, 4_000_000 // centres.size)
    for at in range(0, len(x), step):
        out[at : at + step] = ((x[at : at + step, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    return out


def kmeans(vectors: DataFrame, k: int = 200, iterations: int = 4) -> np.ndarray:
    """Centres (k, d) by Lloyd's iterations from the first k of ``vectors(id, vec)`` in the order of md5(id).

    k centres travel to the executors, and sums per task and centre back; a centre without points stays.
    """
    spark = vectors.sparkSession
    start = sample_leaders(vectors, k).orderBy("leader_id").toArrow()
    centres = matrix(start.column("vec")) if start.num_rows else np.zeros((0, 1))
    for _ in range(iterations if len(centres) else 0):
        sent = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value  # noqa: B023 - run within this round
            total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for b in batches:
                x = matrix(b.column(0))
                own = _nearest(x, c)
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=len(c))
            on, at = (i.ravel() for i in np.indices(c.shape))
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(at), pa.array(total.ravel()), pa.array(n[on])], ["cluster", "at", "total", "n"])

        parts = vectors.select("vec").mapInArrow(sums, "cluster bigint, at bigint, total double, n bigint")
        rows = parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect()  # k x d
        centres = centres.copy()
        for r in rows:
            centres[r["cluster"], r["at"]] = r["total"] / r["n"]
    return centres


def kmeans_labels(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster of each point."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_nearest(matrix(b.column(1)), sent.value))], ["id", "cluster"])

    return vectors.select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(run, "id bigint, cluster bigint")


def kmeans_histogram(vectors: DataFrame, k: int = 200, iterations: int = 4) -> DataFrame:
    """Points per k-means cluster: cluster, n."""
    return kmeans_labels(vectors, kmeans(vectors, k, iterations)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
