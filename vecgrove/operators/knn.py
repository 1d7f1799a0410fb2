"""Exact and approximate nearest neighbours for whole batches of queries.

A search is a join of points and visits (query and cluster) by cluster, with a top-k per query. Visits are
written once and their size is counted. Up to ``MAX_QUERY_BYTES`` they travel to the database, which is
scanned in place; beyond, both sides are dealt by cluster, clusters of many points or visits in pieces.
Either way a task keeps a running top-k per query (and cluster) in arrays, and hands on what it has when
that exceeds ``MAX_KEPT`` rows, so its memory is bounded and what is shuffled at the end is at most k rows
per query and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vecgrove.functions.vectors import l2_guarded
from vecgrove.operators.topk import top, top_k
from vecgrove.operators.tree import Index, descend, matrix
from vecgrove.sources.shared import sendable, stored

#: Queries of at most this size are sent to all executors.
MAX_QUERY_BYTES = 128 << 20
#: Rows of running top-k lists that a task holds.
MAX_KEPT = 2_000_000
#: Points, and visits, of a cluster that one task compares.
POINTS, VISITS = 1 << 16, 1 << 13
#: By columns: pairs that one task compares, points at least by which distances are bounded, and the longest vectors.
PAIRS, BOUND_BY, MAX_COLUMNS = 20_000_000, 256, 1024
#: Distances that are computed at once.
_CHUNK = 2_000_000
_PART = "qid bigint, cluster_id bigint, id bigint, tie bigint, dist bigint"


class Lists:
    """Running top-k by (dist, tie, id) per (query, cluster), as one set of columns."""

    def __init__(self, k: int, dedup: bool = False):
        self.k, self.dedup = k, dedup
        self.columns, self.new, self.pending = [np.zeros(0, np.int64)] * 5, [], 0

    def add(self, dist: np.ndarray, qids: np.ndarray, cluster: int, ties: np.ndarray, ids: np.ndarray) -> None:
        """``dist`` has a row per query and a column per point."""
        k = self.k * int(np.unique(ids, return_counts=True)[1].max()) if self.dedup else self.k  # so many hold k ids
        if dist.shape[1] > k:
            rows, at = np.nonzero(dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k])
        else:
            rows, at = (x.ravel() for x in np.indices(dist.shape))
        self.new.append((qids[rows], np.full(len(rows), cluster, np.int64), dist[rows, at], ties[at], ids[at]))
        self.pending += len(rows)
        if self.pending > max(100_000, len(self.columns[0])):
            self.cut()

    def cut(self) -> None:
        """Keep the first k of each list; with ``dedup`` an id counts once, at its smallest distance."""
        qid, cluster, dist, tie, ids = (np.concatenate(c) for c in zip(self.columns, *self.new, strict=True))
        if self.dedup:
            order = np.lexsort((tie, dist, ids, cluster, qid))
            qid, cluster, dist, tie, ids = (c[order] for c in (qid, cluster, dist, tie, ids))
            once = _starts(qid, cluster, ids)
            qid, cluster, dist, tie, ids = (c[once] for c in (qid, cluster, dist, tie, ids))
        order = np.lexsort((ids, tie, dist, cluster, qid))
        qid, cluster, dist, tie, ids = (c[order] for c in (qid, cluster, dist, tie, ids))
        first = np.flatnonzero(_starts(qid, cluster))
        rank = np.arange(len(qid)) - np.repeat(first, np.diff(np.append(first, len(qid))))
        self.columns = [c[rank < self.k] for c in (qid, cluster, dist, tie, ids)]
        self.new, self.pending = [], 0

    def full(self) -> bool:
        return len(self.columns[0]) + self.pending > MAX_KEPT

    def take(self) -> pa.RecordBatch:
        self.cut()
        qid, cluster, dist, tie, ids = self.columns
        self.columns = [c[:0] for c in self.columns]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (qid, cluster, ids, tie, dist)], ["qid", "cluster_id", "id", "tie", "dist"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _compare(found: Lists, x: np.ndarray, ids: np.ndarray, ties: np.ndarray, q: np.ndarray, qids: np.ndarray, cluster: int) -> Iterator[pa.RecordBatch]:
    """All distances of points and queries of one cluster, some at a time; lists are handed on where they grow too long."""
    if q.shape[1] != x.shape[1]:
        return  # vectors of another length match nothing
    norms = (x * x).sum(1)
    step = max(1, _CHUNK // max(1, len(x)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        found.add(np.rint(norms[None, :] + (part * part).sum(1)[:, None] - 2 * part @ x.T).astype(np.int64), qids[at : at + step], cluster, ties, ids)
        if found.full():
            yield found.take()


def _by_cluster(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """cluster: (query ids, vectors) of visits."""
    if not rows.num_rows:
        return {}
    cluster, qid = (rows.column(c).to_numpy() for c in ("cluster_id", "qid"))
    vectors = matrix(rows.column("vec"))
    order = np.argsort(cluster, kind="stable")
    cuts = np.flatnonzero(np.diff(cluster[order])) + 1
    return {int(cluster[g[0]]): (qid[g], vectors[g]) for g in np.split(order, cuts)}


def _scan_in_place(db: DataFrame, visits: DataFrame, k: int, per_cluster: bool, dedup: bool) -> DataFrame:
    """The database where it lies; all visits go to every executor."""
    sent = db.sparkSession.sparkContext.broadcast(_by_cluster(visits.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, asked = Lists(k, dedup), np.fromiter(sent.value, np.int64, len(sent.value))
        for b in batches:
            clusters, ids, ties = (b.column(i).to_numpy() for i in (0, 1, 2))
            visited = np.isin(clusters, asked)
            if not visited.any():
                continue
            x = matrix(b.column(3))
            for c in np.unique(clusters[visited]).tolist():
                at = np.flatnonzero(clusters == c)
                qids, q = sent.value[c]
                yield from _compare(found, x[at], ids[at], ties[at], q, qids, c if per_cluster else 0)
        yield found.take()

    return db.mapInArrow(run, _PART)


def _scan_dealt(db: DataFrame, visits: DataFrame, k: int, per_cluster: bool, dedup: bool) -> DataFrame:
    """Points and visits dealt by cluster; a large cluster's points and visits in pieces, each pair of which meets once."""
    pieces = [F.ceil(F.count(F.lit(1)) / n).cast("int").alias(c) for n, c in ((POINTS, "ps"), (VISITS, "vs"))]
    units = db.groupBy("cluster_id").agg(pieces[0]).join(visits.groupBy("cluster_id").agg(pieces[1]), "cluster_id")
    units = sendable(stored(units, "units"))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    points = db.join(units, "cluster_id").withColumn("p", F.pmod(F.xxhash64("id"), F.col("ps")).cast("int")).withColumn("v", each("vs"))
    points = points.select("cluster_id", "p", "v", "id", "tie", "vec")
    asked = visits.join(units, "cluster_id").withColumn("v", F.pmod(F.xxhash64("qid"), F.col("vs")).cast("int")).withColumn("p", each("ps"))
    asked = asked.select("cluster_id", "p", "v", "qid", "vec")

    def run(own: pa.Table, queries: pa.Table) -> pa.Table:
        out, found = [], Lists(k, dedup)
        if own.num_rows and queries.num_rows:
            cluster = own.column("cluster_id")[0].as_py() if per_cluster else 0
            ids, ties, qids = own.column("id").to_numpy(), own.column("tie").to_numpy(), queries.column("qid").to_numpy()
            out = list(_compare(found, matrix(own.column("vec")), ids, ties, matrix(queries.column("vec")), qids, cluster))
        return pa.Table.from_batches([*out, found.take()])

    keys = ("cluster_id", "p", "v")
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, _PART)


def scan(db: DataFrame, visits: DataFrame, k: int, per_cluster: bool = False, tie: str = "id", dedup: bool = False, strategy: str = "auto") -> DataFrame:
    """Top k by (dist, tie) per query, or per query and cluster, of the points in the clusters visited.

    ``db(cluster_id, id, vec, ...)``, ``visits(cluster_id, qid, vec)``; result qid, cluster_id, id, tie,
    dist, rank. With ``dedup`` an id that occurs more than once counts once. ``strategy``: ``broadcast`` the
    visits, ``shuffle`` both sides, or by their size.
    """
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy}")
    seen = stored(visits.select(F.col("cluster_id").cast("bigint"), F.col("qid").cast("bigint"), "vec"), "visits")
    n, d = seen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    points = db.select(F.col("cluster_id").cast("bigint"), F.col("id").cast("bigint"), F.col(tie).cast("bigint").alias("tie"), "vec")
    small = n * (8 * d + 64) <= MAX_QUERY_BYTES
    way = _scan_in_place if strategy == "broadcast" or (strategy == "auto" and small) else _scan_dealt
    part = way(points, seen, k, per_cluster, dedup)
    by = ("qid", "cluster_id") if per_cluster else ("qid",)
    if dedup:
        part = part.groupBy("qid", "cluster_id", "id").agg(F.min(F.struct("dist", "tie")).alias("m")).select("qid", "cluster_id", "id", "m.tie", "m.dist")
    return top(part, by, ("dist", "tie", "id"), k)


def exact_knn(db: DataFrame, queries: DataFrame, k: int, dedup: bool = False, strategy: str = "auto") -> DataFrame:
    """qid, rank, id, dist of the k nearest of ``db(id, vec)`` to each of ``queries(qid, vec)``.

    With ``dedup`` an id that occurs more than once counts once.
    """
    one = F.lit(0).cast("bigint").alias("cluster_id")
    found = scan(db.select(one, "id", "vec"), queries.select(one, "qid", "vec"), k, dedup=dedup, strategy=strategy)
    return found.select("qid", "rank", "id", "dist")


def exact_knn_columns(db: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The rows of ``exact_knn`` by expressions only: all points against blocks of the queries, each sent to all executors.

    Values become columns, two in one (``_Columns``), so that generated code computes a distance. The distance of a query's
    k-th neighbour among some of the points bounds that among all: of all pairs only those within it are ranked.
    """
    asked = stored(queries.select("qid", F.col("vec").alias("q")), "queries")
    points = db.select("id", F.col("vec").alias("v"))
    n, d, *of_queries = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0)), *_shape("q")).first()
    total, *of_points = points.agg(F.count(F.lit(1)), *_shape("v")).first()
    whole = all(isinstance(rows.schema[c].dataType.elementType, IntegralType) for rows, c in ((asked, "q"), (points, "v")))
    form = (_Columns.of(of_queries, of_points) if whole else None) or _Arrays()
    some = max(BOUND_BY, int(8 * (k * total) ** 0.5), 8 * k)  # balances pairs compared twice with pairs ranked
    share = max(1, total // some)
    # by id, as parts of a file may be few; and codes of packing and of comparing are generated apart
    dealt = form.points(points).repartition(min(4096, 1 + n * total // PAIRS), "id")
    few = form.points(points.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0)).repartition(min(4096, 1 + n * total // share // PAIRS), "id")
    blocks, out = max(1, -(-n * (8 * d + 64) // MAX_QUERY_BYTES)), None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        first = few.join(F.broadcast(form.queries(block)), F.lit(True)).select("qid", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4 * k)).alias("part"), form.dist().alias("dist"))
        least = first.where("dist IS NOT NULL").groupBy("qid", "part").agg(F.min("dist").alias("dist"))
        bound = least.groupBy("qid").agg(F.get(F.array_sort(F.collect_list("dist")), F.lit(k - 1)).alias("bound"))  # null: fewer than k parts
        within = stored(block.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(2**63 - 1))), "bounds")
        near = dealt.join(F.broadcast(form.queries(within, "bound")), form.dist() <= F.col("bound"))
        part = top_k(near.select("qid", "id", form.dist().cast("bigint").alias("dist")), k).select("qid", "rank", "id", "dist")
        out = part if out is None else out.unionByName(part)
    return out


def _shape(vec: str) -> list[Column]:
    """Least and largest length, largest squared norm and number of vectors that lack a value."""
    lacking = F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull())
    return [F.min(F.size(vec)), F.max(F.size(vec)), F.max(_norm(vec)), F.count_if(lacking)]


def _norm(vec: str) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


class _Arrays:
    """Points and queries as arrays, for vectors that ``_Columns`` does not hold."""

    def points(self, points: DataFrame) -> DataFrame:
        return points

    def queries(self, queries: DataFrame, *more: str) -> DataFrame:
        return queries.select("qid", "q", *more)

    def dist(self) -> Column:
        return l2_guarded(F.col("v"), F.col("q"))


class _Columns:
    """Vectors of one length as columns of doubles, each of two values.

    With a = a0 + a1 w of the point and b = b1 + b0 w of the query, a b = a0 b1 + (a0 b0 + a1 b1) w + a1 b0 w^2. Summed
    over the columns each of the three parts is at most the product of the norms, as is the scalar product in the
    middle; w is over twice that, and while the whole stays below 2^53 all of it is exact.
    """

    def __init__(self, dims: int, width: int):
        self.n, self.width, self.w = -(-dims // 2), width, float(1 << width)

    @staticmethod
    def of(a: list, b: list) -> _Columns | None:
        """For two ``_shape``s; None where lengths differ, values lack or are too large."""
        if None in (*a, *b) or a[3] or b[3] or len({*a[:2], *b[:2]}) != 1 or not 0 < a[0] <= MAX_COLUMNS:
            return None
        if max(a[2], b[2]) >= 1 << 50:
            return None
        width = (math.isqrt(int(a[2]) * int(b[2])) + 1).bit_length() + 1
        return _Columns(a[0], width) if 3 * width <= 52 else None

    def _packed(self, rows: DataFrame, vec: str, name: str, swap: bool, *keep: str) -> DataFrame:
        def value(i: int) -> Column:
            return F.coalesce(F.get(vec, F.lit(i)).cast("double"), F.lit(0.0))  # none lacks but the last of an odd number

        pairs = [(value(2 * i + swap), value(2 * i + 1 - swap)) for i in range(self.n)]
        norm = F.coalesce(_norm(vec), F.lit(0.0)).alias(f"{name}_norm")
        return rows.select(*keep, norm, *[(one + two * self.w).alias(f"{name}{i}") for i, (one, two) in enumerate(pairs)])

    def points(self, points: DataFrame) -> DataFrame:
        return self._packed(points, "v", "v", False, "id")

    def queries(self, queries: DataFrame, *more: str) -> DataFrame:
        return self._packed(queries, "q", "q", True, "qid", *more)

    def dist(self) -> Column:
        total = reduce(add, [F.col(f"v{i}") * F.col(f"q{i}") for i in range(self.n)])
        upper = F.shiftright((total + self.w / 2).cast("bigint"), self.width)  # each used once, as code repeats what is used twice
        product = F.shiftright(F.shiftleft(upper, 64 - self.width), 64 - self.width)  # its low bits, with their sign
        return F.col("v_norm") + F.col("q_norm") - product.cast("double") * 2.0


def visits(queries: DataFrame, index: Index, b: int, beam: int = 1) -> DataFrame:
    """cluster_id, qid, vec, rank: the clusters that each query visits, b at most, from ``beam`` buckets."""
    return descend(queries.select("qid", "vec"), index.leaders, index.edges, index.levels, b, beam).select("cluster_id", "qid", "vec", "rank")


def lookup(assigned: DataFrame, piece: int = 4096) -> DataFrame:
    """The queries of each cluster, as an array; those of a cluster that many visit come in several pieces of about ``piece``."""
    sizes = assigned.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces"))
    dealt = assigned.join(sendable(sizes), "cluster_id").withColumn("piece", F.pmod(F.xxhash64("qid"), F.col("pieces")).cast("int"))
    return dealt.groupBy("cluster_id", "piece").agg(F.array_sort(F.collect_list("qid")).alias("qids"))


def approx_knn(db: DataFrame, queries: DataFrame, index: Index, b: int, k: int, limit: int | None = None, strategy: str = "auto", beam: int = 1) -> DataFrame:
    """k nearest among the points of the b clusters nearest to each query, of those in ``beam`` buckets of the tree.

    ``limit``: k nearest of each cluster first, then the ``limit`` nearest of those.
    """
    seen = visits(queries, index, b, beam)
    if limit is None:
        return scan(db, seen, k, strategy=strategy).select("qid", "rank", "id", "dist")
    return top_k(scan(db, seen, k, per_cluster=True, strategy=strategy), limit).select("qid", "rank", "id", "dist")


def batch_of(qid: str, n: int) -> Column:
    """The batch, of n, that a query belongs to."""
    return F.pmod(F.xxhash64(qid), F.lit(n)).cast("int")


def batched_knn(db: DataFrame, queries: DataFrame, index: Index, b: int, k: int, batch: int) -> DataFrame:
    """``approx_knn`` with the batch, of about ``batch`` queries, of each row.

    All batches are searched in one pass over the database, as a task's memory does not grow with the
    queries; the batch is a column by which results are saved and reloaded.
    """
    n = max(1, queries.count() // batch)
    return approx_knn(db, queries, index, b, k).withColumn("batch", batch_of("qid", n))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours found: recall, over all queries."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
