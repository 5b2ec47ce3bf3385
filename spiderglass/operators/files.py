"""Folders and small files on whatever file system the session's paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str, start: str = "") -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    system, p = _at(spark, folder)
    return sorted(n for s in system.listStatus(p) if (n := s.getPath().getName()).startswith(start)) if system.exists(p) else []


def whole(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end."""
    system, p = _at(spark, f"{folder}/_SUCCESS")
    return system.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = _at(spark, path)
    system.delete(p, True)


def create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file; one that is there already is an error."""
    system, p = _at(spark, path)
    out = system.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read(spark: SparkSession, path: str) -> str:
    system, p = _at(spark, path)
    stream = system.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
