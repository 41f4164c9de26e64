"""Bytes of files in any store that Spark reaches, through Hadoop's file systems."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes."""
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def content(spark: SparkSession, path: str, most: int) -> bytes:
    """All bytes of a file of at most ``most``."""
    fs, p = _open(spark, path)
    if (size := fs.getFileStatus(p).getLen()) > most:
        raise ValueError(f"{path} has {size} bytes; at most {most} are read at once")
    return head(spark, path, size)


def put(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> str:
    fs, p = _open(spark, path)
    out = fs.create(p, True)
    try:
        for c in chunks:
            out.write(bytearray(c))
    finally:
        out.close()
    return path


def listing(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _open(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p))
