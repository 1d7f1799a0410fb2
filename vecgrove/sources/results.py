"""Result files. What a search returns is bounded by its queries and k or m, so the driver writes these."""

from __future__ import annotations

import time
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.operators.topk import as_text
from vecgrove.sources import files


def write_knn_files(knn: DataFrame, folder: str, suffix: str = ".knn") -> int:
    """One file ``<qid><suffix>`` per query, with its text block; ids have three digits at least."""
    files.make_folder(knn.sparkSession, folder)
    n = 0
    for n, r in enumerate(as_text(knn).toLocalIterator(), 1):
        files.write_text(knn.sparkSession, f"{folder}/{r['qid']:03d}{suffix}", r["body"] + "\n")
    return n


def write_knn_text(knn: DataFrame, path: str) -> None:
    as_text(knn).select("body").write.text(path, lineSep="\n")


def write_hubness_csv(hubs: DataFrame, path: str) -> None:
    hubs.select("id", "hubness", "max_dist").write.csv(path)


def write_inverted_csv(rows: DataFrame, path: str) -> None:
    rows.select("qid", "nn_id", "dist", "hubness", "max_dist").write.csv(path)


def save_batches(table: DataFrame, path: str) -> None:
    """A table with a ``batch`` column, one folder per batch."""
    table.write.partitionBy("batch").parquet(path)


def load_batches(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All batches of a table as one, or those from ``first`` up to, but without, ``last``; others are not read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("batch") >= first)
    if last is not None:
        df = df.where(F.col("batch") < last)
    return df


def image_folder(spark: SparkSession, folder: str) -> str:
    """The folder, or one with the time added where it exists."""
    out = f"{folder}_{int(time.time() * 1000)}" if files.exists(spark, folder) else folder
    files.make_folder(spark, out)
    return out


def write_image_results(found: DataFrame, folder: str, b: int, k: int, m: int, seconds: float, db_folder: str = "") -> Path:
    """``batch.res`` (header b:k:m:queries:seconds:, then the result files) and a ``.res`` file per query image.

    A result file is named by the image's path with ``#`` for ``/``: header path:points:, then
    ``<db_folder><id>.jpg:<votes>:`` by descending votes.
    """
    spark = found.sparkSession
    out = image_folder(spark, folder)
    rows = (
        found.groupBy("query_image")
        .agg(F.max("n_points").alias("n_points"), F.array_sort(F.collect_list(F.struct("rank", "image_id", "votes"))).alias("images"))
        .orderBy("query_image")
    )
    paths = []
    for r in rows.toLocalIterator():
        path = f"{out}/{str(r['query_image']).replace('/', '#')}.res"
        lines = [f"{r['query_image']}:{r['n_points']}:"] + [f"{db_folder}{i['image_id']}.jpg:{i['votes']}:" for i in r["images"]]
        files.write_text(spark, path, "\n".join(lines) + "\n")
        paths.append(path)
    files.write_text(spark, f"{out}/batch.res", "\n".join([f"{b}:{k}:{m}:{len(paths)}:{seconds:.3f}:", *paths]) + "\n")
    return Path(out)


def read_batch_header(line: str) -> dict[str, float]:
    """Of five fields, or the older four without the number of queries."""
    part = [p for p in line.strip().split(":") if p]
    names = ("b", "k", "m", "queries", "seconds") if len(part) == 5 else ("b", "k", "m", "seconds")
    return dict(zip(names, map(float, part), strict=True))


def result_page(query: str, images: list[tuple[str, int]]) -> str:
    """An HTML page of a query image and what was found."""
    cells = "".join(f'<figure><img src="{escape(p)}"><figcaption>{v}</figcaption></figure>' for p, v in images)
    return f'<!DOCTYPE html><html><body><img src="{escape(query)}"><hr>{cells}</body></html>'


def move_into_database(path: str, number: int, folder: str, spark: SparkSession | None = None) -> str:
    """Where an image lies as part of the database; given a session it is moved there, and a failure is printed."""
    target = f"{folder}/{number}.jpg"
    if spark is not None and not files.move(spark, path, target):
        print(f"cannot move {path} to {target}")
    return target
