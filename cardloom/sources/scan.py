"""Scans: wide CSV logs, bulk card JSON, printings, card tables, client logs."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.exprs import col
from cardloom.operators.ordered import HOT_ROWS
from cardloom.operators.wide import schema_for_header
from cardloom.sources.json_elements import json_elements

# Kinds of wide logs and the pattern of their file names.
DATA_TYPES = ("draft", "game", "replay")
WIDE_FILE = "{data_type}_data_public.{set_code}.{limited_type}.csv.gz"

# Name pattern of a client log and its time format.
LOG_NAME = r"UTC_Log - (\d{2}-\d{2}-\d{4} \d{2}\.\d{2}\.\d{2})\.log"
LOG_TIME = "MM-dd-yyyy HH.mm.ss"
LOG_GLOB = "UTC_Log*.log"

_URIS = "struct<normal:string,large:string,png:string>"
CARD_SCHEMA = f"""
id string, name string, lang string, digital boolean, `set` string, set_name string,
released_at string, collector_number string, rarity string, type_line string,
mana_cost string, cmc double, colors array<string>, color_identity array<string>,
oracle_text string, power string, toughness string, loyalty string, keywords array<string>,
layout string, arena_id bigint,
prices struct<usd:string,usd_foil:string,usd_etched:string>,
image_uris {_URIS},
card_faces array<struct<name:string,mana_cost:string,type_line:string,oracle_text:string,
power:string,toughness:string,loyalty:string,colors:array<string>,image_uris:{_URIS}>>
"""

SET_SCHEMA = """
cards array<struct<name:string,manaCost:string,type:string,
rarity:string,text:string,colors:array<string>,colorIdentity:array<string>,
identifiers:struct<mtgArenaId:string>>>
"""


def file_position(block_start: Column | None = None) -> Column:
    """Order of a row inside its file, growing but not gap-free.

    A file is read in blocks; a block that is followed by another one is a partition of its
    own, so the row number in the partition is below twice the block length, and
    ``2 * block start + row number`` grows through the whole file. No shuffle, no
    whole-file rows, and a retried task gives the same numbers.
    """
    start = F.col("_metadata.file_block_start") if block_start is None else block_start
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return start * 2 + in_partition


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, duplicates included (reads its first line only)."""
    first = spark.read.text(path).head()
    if first is None:
        raise ValueError(f"empty file: {path}")
    return next(csv.reader([first[0]]))


def read_wide_logs(
    spark: SparkSession,
    path: str,
    set_code: str,
    limited_type: str,
    data_type: str,
    partitions: int | None = None,
    typed: bool = False,
) -> DataFrame:
    """One wide CSV log with its identity columns and a row key.

    Everything is text but ``won``; ``typed`` applies the column rules instead. A gzip file
    is one split, so give ``partitions`` to spread it right after the scan.
    Added columns: ``data_type``, ``set_code``, ``limited_type``, ``source_file``, ``game_id``
    (order inside the file).
    """
    name = WIDE_FILE.format(data_type=data_type, set_code=set_code, limited_type=limited_type)
    file = f"{path.rstrip('/')}/{name}"
    header = read_header(spark, file)
    if len(set(header)) != len(header):
        raise ValueError("duplicated columns in the header")
    schema, _ = schema_for_header(header)
    if not typed:
        schema = T.StructType(
            [
                T.StructField(n, T.BooleanType() if n == "won" else T.StringType())
                for n in header
            ]
        )
    rows = spark.read.schema(schema).csv(file, header=True)
    keyed = rows.select(
        F.lit(data_type).alias("data_type"),
        F.lit(set_code).alias("set_code"),
        F.lit(limited_type).alias("limited_type"),
        F.col("_metadata.file_name").alias("source_file"),
        file_position().alias("game_id"),
        *[col(c) for c in header],
    )
    return keyed if partitions is None else keyed.repartition(partitions, "game_id")


def read_cards_bulk(spark: SparkSession, path: str, lines: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bulk card objects in input order (``input_pos``).

    The objects of a JSON array are found by all tasks together (``json_elements``); ``lines=True``
    reads JSON lines.
    """
    if lines:
        return spark.read.schema(CARD_SCHEMA).json(path).select(file_position().alias("input_pos"), "*")
    found = json_elements(spark, path, 1, hot_rows)
    return found.select("input_pos", F.from_json("text", CARD_SCHEMA).alias("card")).select("input_pos", "card.*")


def read_printings(spark: SparkSession, path: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Printings document -> one row per card: ``set_code``, ``set_pos``, ``card_pos``, ``card``.

    Sets are the objects two levels below the document, each read by one task. ``set_pos`` grows
    through the document.
    """
    found = json_elements(spark, path, 3, hot_rows).filter(F.col("key").isNotNull())
    sets = found.select(F.col("input_pos").alias("set_pos"), F.col("key").alias("set_code"), F.from_json("text", SET_SCHEMA).alias("info"))
    return sets.select(
        "set_pos", "set_code", F.posexplode("info.cards").alias("card_pos", "card")
    )


def read_card_tables(spark: SparkSession, source: str | dict) -> tuple[DataFrame, DataFrame]:
    """Tables ``Cards`` and ``Localizations_enUS``: a folder of parquet tables, or the
    options of a JDBC source (needs a driver on the class path)."""
    tables = ("Cards", "Localizations_enUS")
    if isinstance(source, dict):
        cards, loc = (
            spark.read.format("jdbc").options(**source).option("dbtable", t).load()
            for t in tables
        )
    else:
        cards, loc = (spark.read.parquet(f"{source.rstrip('/')}/{t}") for t in tables)
    return cards, loc


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; a missing path is an error."""
    return spark.read.parquet(path)


def _raw_lines(rows: DataFrame, per_player: bool = False) -> DataFrame:
    owner = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).alias("player_id")
    return rows.select(
        *([owner] if per_player else []),
        F.url_decode(F.col("_metadata.file_name")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").alias("line"),
    )


def number_lines(raw: DataFrame) -> DataFrame:
    """Raw lines as scanned -> (``player_id``,) ``source_file``, ``line_no``, ``line`` without blank lines.

    The position is taken straight above the scan, before the blank lines go.
    """
    owner = [c for c in raw.columns if c == "player_id"]
    numbered = raw.select(
        *owner, "source_file", file_position(F.col("block_start")).alias("line_no"), "line"
    )
    return numbered.filter(F.col("line").rlike(r"\S"))


def read_client_logs(spark: SparkSession, path: str, per_player: bool = False) -> DataFrame:
    """Non-blank lines of the logs of a folder: ``source_file``, ``line_no``, ``line``.

    With ``per_player`` the folder holds a folder per player, whose name is ``player_id``.
    """
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", LOG_GLOB)
    return number_lines(_raw_lines(rows.text(f"{path.rstrip('/')}/*" if per_player else path), per_player))


def stream_client_logs(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, per_player: bool = False
) -> DataFrame:
    """Raw lines of the logs of a folder as a stream (``number_lines`` runs per batch).

    Files are taken whole once they appear, so the input contract is finished (rolled)
    logs; the checkpoint keeps what was read. Growing logs: ``sources.growing``.
    """
    reader = (
        spark.readStream.schema("value string")
        .option("lineSep", "\n")
        .option("pathGlobFilter", LOG_GLOB)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _raw_lines(reader.text(f"{path.rstrip('/')}/*" if per_player else path), per_player)


def log_time(source_file: Column | str) -> Column:
    """Time in the name of a client log, null for other names."""
    c = F.col(source_file) if isinstance(source_file, str) else source_file
    stamp = F.nullif(F.regexp_extract(c, LOG_NAME, 1), F.lit(""))
    return F.try_to_timestamp(stamp, F.lit(LOG_TIME))


def log_files(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct log files with the time of their name; other names are left out."""
    files = lines.select(*by, "source_file").distinct()
    return files.select("*", log_time("source_file").alias("log_time")).filter(
        F.col("log_time").isNotNull()
    )


def latest_log(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the newest log (per ``by``), by the time in the file name."""
    newest = F.max_by("source_file", F.struct("log_time", "source_file")).alias("source_file")
    newest_files = log_files(lines, by).groupBy(*by).agg(newest)
    return lines.join(newest_files, [*by, "source_file"], "left_semi")


def latest_snapshot(df: DataFrame, ts_col: str = "ingest_ts") -> DataFrame:
    """Rows of the newest snapshot; on a partition column only its files are read."""
    newest = df.agg(F.max(ts_col)).scalar()
    return df.filter(F.col(ts_col) == newest)
