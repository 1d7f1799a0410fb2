"""The search service: batch files in a folder, answered one by one.

A batch file ``*.batch`` has a header ``b:k:m`` and then a line per query image. ``halt.batch`` stops the
service; ``save.batch`` (``parquet`` and a path on two lines) writes the database. A batch whose last
image's name starts with 999 is searched by bags of features. Batches are read by Structured Streaming,
one file per trigger. The stream's checkpoint lies in the shared folder under a name that the folder of
batches and that of results give, so a service started again goes on where the last one ended and answers
no batch twice; a batch's name is therefore used once. A batch file is removed, on whatever file system it
lies, once its results are written. The database is kept on the executors' disks and its bags in memory
from the first batch on, until ``close``.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.functions.parsing import batch_header
from vecgrove.operators.images import bag_of_features, bag_votes, extend_database, image_votes
from vecgrove.operators.topk import shortlist
from vecgrove.operators.tree import Index
from vecgrove.sources import files
from vecgrove.sources.results import write_image_results
from vecgrove.sources.shared import base_dir

#: Names of batches that go to the bag of features start so.
BAG_PREFIX = "999"


@dataclass
class Service:
    """``points_of(images)`` turns a DataFrame of paths (query_image) into (qid, query_image, vec); unknown files drop out."""

    spark: SparkSession
    db: DataFrame
    index: Index
    points_of: Callable[[DataFrame], DataFrame]
    result_folder: str
    db_folder: str = ""
    remove: bool = True
    halted: bool = field(default=False, init=False)
    bags: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self._keep(self.db)

    def _keep(self, db: DataFrame) -> None:
        self.db = db.persist(StorageLevel.DISK_ONLY)
        self.bags = bag_of_features(self.db).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.bags.unpersist()
        self.db.unpersist()

    def extend(self, points: DataFrame, mode: str = "full") -> None:
        """Take the points of new images, (id, image_id, vec), into the database and keep the result."""
        old, bags = self.db, self.bags
        self._keep(extend_database(old, points, self.index, mode))
        self.db.count()
        bags.unpersist()
        old.unpersist()

    def search(self, images: DataFrame, b: int, k: int, m: int, by_bags: bool) -> DataFrame:
        points = self.points_of(images)
        votes = bag_votes(self.bags, points, self.index) if by_bags else image_votes(self.db, points, self.index, b, k)
        seen = points.groupBy("query_image").agg(F.count(F.lit(1)).alias("n_points"))
        return shortlist(votes, m).join(seen, "query_image")

    def answer(self, name: str, text: str) -> Path | None:
        """Handle one batch file's content."""
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        if name == "halt.batch":
            self.halted = True
            return None
        if name == "save.batch":
            if len(lines) < 2 or lines[0] not in ("parquet", "objectFile"):
                print(f"{name}: unknown format")
                return None
            self.db.write.mode("errorifexists").parquet(lines[1])
            return None
        if len(lines) < 2:
            return None  # an empty batch has an empty result
        head = self.spark.range(1).select(*(c.alias(n) for n, c in zip("bkm", batch_header(F.lit(lines[0])), strict=True))).first()
        images = self.spark.createDataFrame([(x,) for x in lines[1:]], "query_image string")
        by_bags = lines[-1].rsplit("/", 1)[-1].startswith(BAG_PREFIX)
        began = time.time()
        found = self.search(images, head["b"], head["k"], head["m"], by_bags)
        folder = f"{self.result_folder}/{name.removesuffix('.batch')}"
        return write_image_results(found, folder, head["b"], head["k"], head["m"], time.time() - began, self.db_folder)

    def _each(self, batch: DataFrame, _: int) -> None:
        for r in batch.collect():  # one file
            path = unquote(r["file"])
            self.answer(path.rsplit("/", 1)[-1], r["value"])
            if self.remove:
                files.delete(self.spark, path)

    def _halt(self, folder: str) -> None:
        """A halt file is empty as a rule, and an empty file makes no row of the stream: look for it."""
        path = f"{folder}/halt.batch"
        if files.exists(self.spark, path):
            self.halted = True
            if self.remove:
                files.delete(self.spark, path)

    def run(self, folder: str, once: bool = False, every: str = "1 second") -> None:
        """Answer what the folder has and, unless ``once``, what comes, until told to halt."""
        stream = (
            self.spark.readStream.format("text")
            .option("wholetext", "true")
            .option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "*.batch")
            .load(folder)
            .select("value", F.col("_metadata.file_path").alias("file"))
        )
        name = hashlib.sha256(f"{folder}\n{self.result_folder}".encode()).hexdigest()[:20]
        mark = f"{base_dir(self.spark)}/service-{name}"
        writer = stream.writeStream.foreachBatch(self._each).option("checkpointLocation", mark)
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
        try:
            while query.isActive and not self.halted:
                query.awaitTermination(1)
                self._halt(folder)
            if query.exception():
                raise query.exception()
        finally:
            query.stop()
