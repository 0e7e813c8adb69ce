"""Small files and folders of a shared path, through the file system that Spark uses for it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it is missing."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there whole or not at all; an older one is replaced."""
    fs, place = _at(spark, path)
    _, draft = _at(spark, path.rsplit("/", 1)[0] + "/_draft-" + path.rsplit("/", 1)[1])
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(draft, place):
        raise OSError(f"cannot write {path}")
