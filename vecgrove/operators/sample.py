"""Samples that come out the same in every run, by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number from 0 to below 1, by md5 of the key and the seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(1 << 52)


def sample_upto(df: DataFrame, most: int, key: str = "id", seed: int = 0) -> DataFrame:
    """Each row with the probability that gives ``most`` rows on average; all of a table that has no more."""
    n = df.count()
    return df if n <= most else df.where(hash_share(F.col(key), seed) < most / n)


def random_ids(spark: SparkSession, n: int, upper: int, seed: int = 0) -> DataFrame:
    """id: n draws from 0 to below ``upper``; a number drawn twice comes once."""
    drawn = spark.range(n).select(F.floor(hash_share(F.col("id"), seed) * upper).cast("bigint").alias("id"))
    return drawn.distinct()


def absent_ids(spark: SparkSession, n: int, upper: int, table: DataFrame, seed: int = 0) -> DataFrame:
    """Those of ``random_ids`` that ``table(id, ...)`` does not have."""
    return random_ids(spark, n, upper, seed).join(table.select("id"), "id", "left_anti")


def first_queries(queries: DataFrame, n: int = 10, key: str = "qid") -> DataFrame:
    return queries.orderBy(key).limit(n)
