"""Small files on any file system that Spark can reach, through Hadoop's interface."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202 - objects of the JVM
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.setWriteChecksum(False)
    return store, p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    store, p = _at(spark, path)
    store.mkdirs(p)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    write_pieces(spark, path, [content])


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """Pieces one after the other, written beside their place and moved there, so that nobody reads half a file."""
    store, p = _at(spark, path)
    part = p.suffix(".part")
    out = store.create(part, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
    finally:
        out.close()
    if store.exists(p):
        store.delete(p, False)
    if not store.rename(part, p):
        raise OSError(f"cannot write {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def delete(spark: SparkSession, path: str, recursive: bool = False) -> None:
    store, p = _at(spark, path)
    store.delete(p, recursive)


def move(spark: SparkSession, path: str, target: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p) and store.rename(p, _at(spark, target)[1])


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder, made now, when the driver's JVM ends."""
    store, p = _at(spark, path)
    store.mkdirs(p)
    store.deleteOnExit(p)
