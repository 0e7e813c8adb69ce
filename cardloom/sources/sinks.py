"""Sinks: processed tables, catalogue, mapping, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cardloom.operators.catalogue import require_rows
from cardloom.operators.report import export_rows

IDENTITY = ("data_type", "set_code", "limited_type")


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


def write_processed(
    df: DataFrame, path: str, refresh: bool = False, by: Sequence[str] = IDENTITY
) -> bool:
    """Write a table partitioned by its identity; without ``refresh`` an existing identity
    stays as it is. Only the partitions of ``df`` are replaced. Returns whether it wrote."""
    if not refresh and _exists(df, path):
        spark = df.sparkSession
        held = spark.read.parquet(path).select(*by).distinct()
        df = df.join(held, list(by), "left_anti")
        if df.isEmpty():
            return False
    (
        df.write.partitionBy(*by)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    return True


def write_catalogue_tables(
    cards: DataFrame, sets: DataFrame, faces: DataFrame, path: str
) -> None:
    """``cards``, ``sets`` and, when there are any, ``card_faces`` as parquet."""
    base = path.rstrip("/")
    cards.write.mode("overwrite").parquet(f"{base}/cards")
    sets.write.mode("overwrite").parquet(f"{base}/sets")
    if not faces.isEmpty():
        faces.write.mode("overwrite").parquet(f"{base}/card_faces")


def write_app_catalogue(df: DataFrame, path: str) -> None:
    """Application catalogue as JSON lines, null fields kept."""
    require_rows(df, "cards").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_mapping(df: DataFrame, path: str) -> None:
    """Id mapping as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_matches_csv(matches: DataFrame, path: str) -> None:
    """Seven columns, every cell quoted, quotes doubled; empty input is an error."""
    rows = export_rows(require_rows(matches, "matches"))
    rows.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def export_matches_json(matches: DataFrame, path: str) -> None:
    """All fields of the matches as JSON lines; empty input is an error."""
    require_rows(matches, "matches").write.mode("overwrite").option(
        "ignoreNullFields", False
    ).json(path)
