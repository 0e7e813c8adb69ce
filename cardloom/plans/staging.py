"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cardloom.plans import folders

SHREDDING = "spark.sql.variant.writeShredding.enabled"

_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside once the block ends; read what rests on them before."""
    staged: list[str] = []
    _scopes.append(staged)
    try:
        yield
    finally:
        _scopes.remove(staged)
        for path in staged:
            folders.delete(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves only if driver and executors are one process;
    on a cluster it would be another folder on every machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            named = tempfile.mkdtemp(prefix="cardloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _whole_variants(spark: SparkSession) -> Iterator[None]:
    """Write VARIANT values as they are: one cut into typed columns is put together again at every read."""
    held = spark.conf.get(SHREDDING, None)
    spark.conf.set(SHREDDING, "false")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(SHREDDING)
        else:
            spark.conf.set(SHREDDING, held)


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table that several jobs read, and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and no recomputation,
    and readers of one partition value touch only its files.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    with _whole_variants(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
