"""A deep hierarchical index over cluster leaders, as a relation.

    leaders (leader_id, vec)           C rows, dense ids from 0
    edges   (level, parent, child)     level 1 has the parent -1; a node is (level, leader)

Level i holds the leaders below min(bucket^i, C), bucket = ceil(C^(1/L)); every node hangs under its
``tree_a`` nearest nodes of the level above, found by descending the tree built so far. A search goes to
the nearest child level by level and takes the n nearest in one bottom bucket.

``descend`` runs on the executors with the index broadcast, after a check that it fits
``MAX_INDEX_BYTES``: no shuffle, and a cluster that attracts a third of all rows costs nothing extra.
Beyond that bound ``descend_dealt`` sends the upper levels only, as many as fit, and deals points and
children of the last one by node, in pieces where a node has many. ``descend_joins`` gives the same rows by
expressions alone, with a join and a top-n window per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecgrove.functions.vectors import l2_squared, score_text, selection_score
from vecgrove.operators.topk import top
from vecgrove.sources.shared import numbered, stored

MAX_INDEX_BYTES = 512 << 20
#: Leaders that one task may number.
FEW = 1 << 14
#: Children of a node that are compared at once.
_KIDS = 1 << 15


@dataclass
class Index:
    leaders: DataFrame
    edges: DataFrame
    n_leaders: int
    levels: int
    tree_a: int


def sample_leaders(vectors: DataFrame, n: int) -> DataFrame:
    """n rows of ``vectors(id, vec)`` in the order of md5(id), numbered from 0; without replacement.

    Up to ``FEW`` come by a top-n and are numbered in one task. Of more, a cut on the hash leaves little
    over n rows before they are ordered, and they are numbered by ranges.
    """
    rows = vectors.select("id", "vec").withColumn("_md5", F.md5(F.col("id").cast("string")))
    if n <= FEW:
        number = F.row_number().over(W.orderBy("_md5", "id")) - 1
        return rows.orderBy("_md5", "id").limit(n).select(number.cast("bigint").alias("leader_id"), "id", "vec")
    total = vectors.count()
    if total > 4 * n:
        share = 1.25 * n / total + 100 / total
        few = rows.where(F.col("_md5") < f"{int(min(share, 1) * 0xFFFFFFFF):08x}")
        rows = few if few.count() >= n else rows
    return numbered(rows, "leader_id", "_md5", "id").where(F.col("leader_id") < n).select(F.col("leader_id").cast("bigint"), "id", "vec")


class Packed:
    """The index as arrays, for a worker."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, children: list[dict[int, np.ndarray]]):
        order = np.argsort(ids)
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors, dtype=np.float64)
        self.children = children

    def distances(self, x: np.ndarray, leaders: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, leaders)
        return (x * x).sum(1)[:, None] + self.norms[at][None, :] - 2 * x @ self.vectors[at].astype(np.float64).T

    def nearest(self, x: np.ndarray, kids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest of ``kids``, which ascend, and their distances; some kids at a time, ties go to the smallest."""
        found, dist = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))
        for at in range(0, len(kids), _KIDS):
            some = kids[at : at + _KIDS]
            d = np.concatenate((dist, self.distances(x, some)), axis=1)
            k = np.concatenate((found, np.broadcast_to(some, (len(x), len(some)))), axis=1)
            pick = d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
            found, dist = np.take_along_axis(k, pick, 1), np.take_along_axis(d, pick, 1)
        return found, dist

    def search(self, x: np.ndarray, n: int, levels: int, beam: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, rank, leader and distance of the n nearest in the buckets that each row of x reaches, ``beam`` nodes a level."""
        row, node = np.arange(len(x)), np.full(len(x), -1, np.int64)
        for level in range(levels):
            most = n if level == levels - 1 else beam
            out = [(row[:0], node[:0], np.zeros(0))]
            for parent in np.unique(node):
                rows = row[node == parent]
                kids = self.children[level].get(int(parent), np.zeros(0, np.int64))
                if not len(kids):
                    continue
                for part in np.array_split(rows, len(rows) * min(len(kids), _KIDS) // 4_000_000 + 1):
                    found, dist = self.nearest(x[part], kids, most)
                    out.append((np.repeat(part, found.shape[1]), found.ravel(), dist.ravel()))
            row, node, dist = (np.concatenate(c) for c in zip(*out, strict=True))
            if beam > 1:  # a leader may hang under several of the nodes
                order = np.lexsort((node, row))
                once = order[np.append(True, (np.diff(row[order]) != 0) | (np.diff(node[order]) != 0))[: len(order)]]
                row, node, dist = row[once], node[once], dist[once]
            order = np.lexsort((node, dist, row))
            row, node, dist = row[order], node[order], dist[order]
            first = np.searchsorted(row, row)
            rank = np.arange(len(row)) - first
            row, node, dist, rank = (c[rank < most] for c in (row, node, dist, rank))
        return row, rank + 1, node, dist.astype(np.int64)


def packed(leaders: DataFrame, edges: DataFrame, levels: int) -> Packed | None:
    """None if the index is larger than MAX_INDEX_BYTES. Vectors of signed bytes, as quantising makes them, take a byte a value."""
    n, d, most, least = leaders.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.array_max("vec")), F.min(F.array_min("vec"))).first()
    kind = np.int8 if n and d and -128 <= least and most <= 127 else np.float64
    if n * (d or 0) * np.dtype(kind).itemsize + n * 24 + edges.count() * 16 > MAX_INDEX_BYTES:
        return None
    rows = leaders.select("leader_id", "vec").toArrow()
    vectors = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1))
    links = edges.select("level", "parent", "child").toArrow()
    level, parent, child = (links.column(c).to_numpy() for c in ("level", "parent", "child"))
    children: list[dict[int, np.ndarray]] = []
    for lv in range(1, levels + 1):
        on = level == lv
        order = np.lexsort((child[on], parent[on]))
        p, c = parent[on][order], child[on][order]
        cuts = np.flatnonzero(np.diff(p)) + 1
        children.append({int(k[0]): v for k, v in zip(np.split(p, cuts), np.split(c, cuts), strict=True) if len(k)})
    return Packed(rows.column("leader_id").to_numpy(), vectors, children)


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's arrays of equal length as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def descend(points: DataFrame, leaders: DataFrame, edges: DataFrame, levels: int, n: int, beam: int = 1) -> DataFrame:
    """Columns of ``points`` (with ``vec``) and rank, cluster_id, cluster_dist: the n nearest leaders of the bucket reached.

    With a ``beam`` so many nodes are followed on each level, and the n nearest come from all their buckets.
    """
    index = packed(leaders, edges, levels)
    if index is None:
        return descend_dealt(points, leaders, edges, levels, n, beam)
    sent = points.sparkSession.sparkContext.broadcast(index)
    names = points.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", rank int, cluster_id bigint, cluster_dist bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, rank, cluster, dist = sent.value.search(matrix(b.column(names.index("vec"))), n, levels, beam)
            kept = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(rank.astype(np.int32)), pa.array(cluster.astype(np.int64)), pa.array(dist)], [*names, "rank", "cluster_id", "cluster_dist"]
            )

    return points.mapInArrow(run, schema)


def descend_dealt(points: DataFrame, leaders: DataFrame, edges: DataFrame, levels: int, n: int, beam: int = 1) -> DataFrame:
    """The rows of ``descend``; the last level's nodes meet their points in tasks, where the index is too large to be sent."""
    from vecgrove.operators.knn import scan  # a search in the bottom buckets

    row = f"_row{levels}"  # the levels above number their rows too
    rows = stored(points.withColumn(row, F.monotonically_increasing_id()), "points")
    at = rows.select(row, "vec")
    if levels == 1:
        asked = at.withColumn("cluster_id", F.lit(-1).cast("bigint"))
    else:
        upper = edges.where(F.col("level") < levels)
        nodes = stored(leaders.join(upper.select(F.col("child").alias("leader_id")).distinct(), "leader_id", "left_semi"), "upper-leaders")
        asked = descend(at, nodes, upper, levels - 1, beam, beam).select(row, "vec", "cluster_id")
    children = edges.where(F.col("level") == levels).select(F.col("parent").alias("cluster_id"), F.col("child").alias("id"))
    children = children.join(leaders.select(F.col("leader_id").alias("id"), "vec"), "id")
    found = scan(children, asked.withColumnRenamed(row, "qid"), n, dedup=beam > 1, strategy="shuffle")
    found = found.select(F.col("qid").alias(row), "rank", F.col("id").alias("cluster_id"), F.col("dist").alias("cluster_dist"))
    return rows.join(found, row).select(*points.columns, "rank", "cluster_id", "cluster_dist")


def descend_joins(points: DataFrame, leaders: DataFrame, edges: DataFrame, levels: int, n: int, key: str = "id") -> DataFrame:
    """The rows of ``descend`` by a join and a top-n window per level; ``key`` is unique in points."""
    at = points.withColumn("_node", F.lit(-1).cast("bigint"))
    target = leaders.select(F.col("leader_id").alias("_child"), F.col("vec").alias("_leader"))
    for level in range(1, levels + 1):
        step = edges.where(F.col("level") == level).select(F.col("parent").alias("_node"), F.col("child").alias("_child")).join(target, "_child")
        near = at.join(step, "_node").withColumn("cluster_dist", l2_squared(F.col("vec"), F.col("_leader")))
        at = top(near, (key,), ("cluster_dist", "_child"), n if level == levels else 1)
        if level < levels:
            at = at.select(*points.columns, F.col("_child").alias("_node"))
    return at.select(*points.columns, "rank", F.col("_child").alias("cluster_id"), "cluster_dist")


def build_tree(leaders: DataFrame, levels: int, tree_a: int = 3) -> Index:
    """The index over ``leaders(leader_id, vec)``. Depth 1 is a flat list of all leaders."""
    if not 1 <= levels <= 10:
        raise ValueError("depth must be 1 to 10")
    leaders = stored(leaders.select("leader_id", "vec"), "leaders")
    n = leaders.count()
    bucket = math.ceil(n ** (1 / levels)) if n else 0
    points = leaders.withColumnRenamed("leader_id", "id")
    first = n if levels == 1 else bucket
    spark = leaders.sparkSession
    edges = stored(spark.range(first).select(F.lit(1).alias("level"), F.lit(-1).cast("bigint").alias("parent"), F.col("id").alias("child")), "edges")
    for level in range(2, levels + 1):
        new = points.where(F.col("id") < min(bucket**level, n))
        found = descend(new, leaders, edges, level - 1, tree_a)
        added = found.select(F.lit(level).alias("level"), F.col("cluster_id").alias("parent"), F.col("id").alias("child"))
        edges = stored(edges.unionByName(added), "edges")
    return Index(leaders, edges, n, levels, tree_a)


def cluster_paths(points: DataFrame, index: Index, b: int) -> DataFrame:
    """id, path: the three nearest nodes per level (second and third in parentheses), then b leaves with their scores.

    A score is 0.5 - best / (2 dist) with six digits; ``nan`` at distance 0.
    """
    at = points.select("id", "vec").withColumn("_node", F.lit(-1).cast("bigint"))
    target = index.leaders.select(F.col("leader_id").alias("_child"), F.col("vec").alias("_leader"))
    parts = None
    for level in range(1, index.levels + 1):
        last = level == index.levels
        step = index.edges.where(F.col("level") == level).select(F.col("parent").alias("_node"), F.col("child").alias("_child")).join(target, "_child")
        near = at.join(step, "_node").withColumn("dist", l2_squared(F.col("vec"), F.col("_leader")))
        near = top(near, ("id",), ("dist", "_child"), b if last else 3)
        best = F.first("dist").over(W.partitionBy("id").orderBy("rank"))
        value = selection_score(F.col("dist"), best)
        score = F.when(value.isNull(), F.lit("nan")).otherwise(score_text(value))
        item = F.concat(F.col("_child").cast("string"), F.lit(":"), score) if last else F.col("_child").cast("string")
        lists = (
            near.withColumn("item", item)
            .groupBy("id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("items"))
        )
        if last:
            text = F.concat(F.lit("|"), F.array_join("items", ","))
        else:
            rest = F.array_join(F.slice("items", 2, 2), ",")
            text = F.concat(F.get("items", F.lit(0)), F.when(F.size("items") > 1, F.concat(F.lit("("), rest, F.lit(")"))).otherwise(""))
        lists = lists.select("id", text.alias(f"p{level}"))
        parts = lists if parts is None else parts.join(lists, "id")
        at = near.where("rank = 1").select("id", "vec", F.col("_child").alias("_node"))
    return parts.select("id", F.concat_ws("->", *[f"p{i}" for i in range(1, index.levels + 1)]).alias("path"))
