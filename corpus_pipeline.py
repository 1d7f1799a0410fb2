"""The corpus pipeline: toxicity, exact and near deduplication, mixing, packing.

Each stage is a function (spark, docs, sf_dir) that returns a DataFrame. ``run`` writes what a stage
returns as Parquet into the shared folder and reads it again as the next stage's documents. All but the
last return the columns of documents. Rows are rejected by id and text, as ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import ascii_lower, row_hash, sendable, stored, table, without_rows
from vecgrove.llm.exact_dedup import exact_dedup, sha256
from vecgrove.llm.mixing import mixed_documents
from vecgrove.llm.near_copies import near_copies
from vecgrove.llm.packing import pack
from vecgrove.llm.toxicity import without_toxic

#: Stages draw on training, hashing and tokenising; SQL can express none but exact deduplication.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of the documents at hand."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the largest id."""
    found = stored(exact_dedup(docs), "stage-copies")
    single = without_rows(docs, found.where("NOT kept").select("id", "digest"), _text_digest(docs))
    twice = found.where("kept").groupBy("id", "digest").count().where("count > 1").select("id", "digest")
    return _one_row_each(single, stored(twice, "stage-copies-twice"), _text_digest)


def _text_digest(docs: DataFrame) -> Column:
    """As in ``exact_dedup``."""
    return sha256(ascii_lower(docs["text"]))


def _text_row(docs: DataFrame) -> Column:
    return row_hash(docs["text"])


def _one_row_each(docs: DataFrame, twice: DataFrame, mark: Callable[[DataFrame], Column]) -> DataFrame:
    """Of rows with the same id and mark, those in ``twice``, one stays."""
    if not twice.limit(1).count():
        return docs
    other = sendable(twice.toDF("_vg_key", "_vg_mark"))
    same = docs["doc_id"].eqNullSafe(F.col("_vg_key")) & (mark(docs) == F.col("_vg_mark"))
    again = docs.join(other, same, "left_semi").withColumn("_vg_mark", mark(docs)).dropDuplicates(["doc_id", "_vg_mark"]).drop("_vg_mark")
    return without_rows(docs, twice, mark(docs)).unionByName(again)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a five-word similarity of 0.8 or more stays, that of the smallest id, null last."""
    found = stored(near_copies(docs), "stage-similar")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    groups = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("kept")).where("n > 1")
    groups = stored(groups.select("component", F.col("kept.id").alias("kept_id"), F.col("kept.row").alias("kept_row")), "stage-similar-groups")
    members = found.join(sendable(groups), "component")
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))
    gone = stored(members.where(~same).select("id", "row"), "stage-similar-gone")
    single = without_rows(docs, gone, _text_row(docs))
    twice = stored(members.where(same).groupBy("id", "row").count().where("count > 1").select("id", "row"), "stage-similar-twice")
    return _one_row_each(single, twice, _text_row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_similar),
    ("mix", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
