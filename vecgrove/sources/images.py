"""Images and their descriptors. The detector is a function that the caller gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.functions.parsing import image_id

Detector = Callable[[bytes], "np.ndarray | list[list[float]]"]


def image_files(spark: SparkSession, folder: str, suffix: str = "jpg") -> DataFrame:
    """path, content of image files in all folders below, whatever the case of the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.endswith(F.lower("path"), F.lit("." + suffix.lower()))).select("path", "content")


def listed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content of the files of a list that the driver holds."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def decoded_images(spark: SparkSession, folder: str, edge: int = 756) -> DataFrame:
    """path, height, width, pixels (grey, a byte each, by rows) with the larger edge at most ``edge``.

    Files are decoded by the JVM's image readers; those that fail drop out. Pixels of a
    smaller image are averages over the area that each stands for.
    """
    files = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    flat = files.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, h, w, channels, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grey = grey_of(np.frombuffer(data, np.uint8).reshape(h, w, channels))
                small = resized_to(grey, edge)
                rows.append((path, *small.shape, small.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "height", "width", "pixels"])

    return flat.mapInArrow(run, "path string, height int, width int, pixels binary")


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red (and opacity) values."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resized_to(grey: np.ndarray, edge: int) -> np.ndarray:
    """Scaled down, by averages over areas, so that the larger edge is at most ``edge``; sizes truncate."""
    h, w = grey.shape
    by = min(1.0, edge / max(h, w))
    if by == 1.0:
        return grey
    out = grey.astype(np.float64)
    for axis, (n, m) in enumerate(((h, max(1, int(h * by))), (w, max(1, int(w * by))))):
        sums = np.concatenate((np.zeros_like(out.take([0], axis)), out.cumsum(axis)), axis)
        cuts = np.linspace(0, n, m + 1)
        whole = np.minimum(cuts.astype(int), n - 1)
        part = np.expand_dims(cuts - whole, 1 - axis)
        upto = sums.take(whole, axis) + part * out.take(whole, axis)
        out = np.diff(upto, axis=axis) / (n / m)
    return np.rint(out).astype(np.uint8)


def dense_descriptors(grey: np.ndarray, step: int = 8, cell: int = 4) -> np.ndarray:
    """128 values per grid point: histograms of 8 gradient directions over 4 x 4 cells around it, of length 1, clipped at 0.2.

    A detector that needs no library; any function from an image to descriptors can take its place.
    """
    g = grey.astype(np.float64)
    dy, dx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g),) * 2
    strength, turn = np.hypot(dx, dy), np.floor((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    planes = np.stack([np.where(turn == k, strength, 0.0) for k in range(8)])
    sums = np.pad(planes.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    side = 4 * cell
    ys, xs = np.arange(0, g.shape[0] - side + 1, step), np.arange(0, g.shape[1] - side + 1, step)
    if not len(ys) or not len(xs):
        return np.zeros((0, 128))
    parts = []
    for i in range(4):
        for j in range(4):
            y, x = ys[:, None] + i * cell, xs[None, :] + j * cell
            parts.append(sums[:, y + cell, x + cell] - sums[:, y, x + cell] - sums[:, y + cell, x] + sums[:, y, x])
    out = np.maximum(np.stack(parts).reshape(128, -1).T, 0.0)
    for _ in range(2):  # normalise, clip, normalise
        out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        out = np.minimum(out, 0.2)
    return out[out.any(1)]


def descriptors(images: DataFrame, detect: Detector, scale: str = "sift") -> DataFrame:
    """query_image (path), image_id, qp_no, vec, seconds of every descriptor; files that fail give none.

    Values are quantised as 512 * x - 128 into signed bytes (``sift``) or floored at 127 * x (``unit``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, int, list[int], float]] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                began = time.time()
                try:
                    found = np.asarray(detect(content.as_py()), np.float64)
                except Exception as e:  # a broken image is no reason to stop a search
                    print(f"{path}: {e}")
                    continue
                if found.size == 0:
                    continue
                if scale == "sift":
                    whole = (np.trunc(512 * found - 128).astype(np.int64) + 128) % 256 - 128
                else:
                    whole = np.floor(found * 127).astype(np.int64)
                took = time.time() - began
                rows += [(path, i, v.tolist(), took) for i, v in enumerate(whole)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_image", "qp_no", "vec", "seconds"])

    made = images.mapInArrow(run, "query_image string, qp_no int, vec array<int>, seconds double")
    return made.withColumn("image_id", image_id(F.col("query_image")))


def image_points(found: DataFrame) -> DataFrame:
    """id (of the descriptor), image_id, vec: what a database is made of."""
    return found.select(F.xxhash64("query_image", "qp_no").alias("id"), "image_id", "vec")


def extraction_stats(found: DataFrame) -> DataFrame:
    """One row: images, descriptors, descriptors per image, seconds per image."""
    per = found.groupBy("query_image").agg(F.count(F.lit(1)).alias("n"), F.max("seconds").alias("s"))
    return per.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("descriptors"), F.avg("n").alias("per_image"), F.avg("s").alias("seconds"))
