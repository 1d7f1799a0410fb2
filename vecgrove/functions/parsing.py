"""Names, keys and headers of the file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of a batch header b:k:m.
DEFAULT_B, DEFAULT_K, DEFAULT_M = 1, 20, 100


def batch_header(line: Column) -> tuple[Column, Column, Column]:
    """b, k, m of a header line: b outside 1..10 is 1, k below 5 is 20, m outside 10..1000 is 100; so are fields that are no number."""
    part = F.split(line, ":")
    b, k, m = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    return (
        F.when(b.between(1, 10), b).otherwise(DEFAULT_B),
        F.when(k >= 5, k).otherwise(DEFAULT_K),
        F.when(m.between(10, 1000), m).otherwise(DEFAULT_M),
    )


def image_id(path: Column) -> Column:
    """The number that the file is named by; else a hash of the path."""
    number = F.regexp_extract(path, r"([^/]*)\.[^./]{3}$", 1).try_cast("bigint")
    return F.coalesce(number, F.xxhash64(path))


def query_image(key: Column) -> Column:
    """The path in a key <path>_<number>."""
    return F.regexp_replace(key, "_[^_]*$", "")


def file_name(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("#"))


def resized(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Width and height scaled down so that the larger edge is at most ``edge``; sizes truncate."""
    by = F.when((width >= height) & (width > edge), F.lit(float(edge)) / width).when((height > width) & (height > edge), F.lit(float(edge)) / height).otherwise(1.0)
    return (width * by).cast("int"), (height * by).cast("int")
