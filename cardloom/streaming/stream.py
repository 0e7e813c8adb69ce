"""The log flow on Structured Streaming.

Two stages, both idempotent under replays:

* lines -> messages: each micro-batch runs the batch operator and writes its own
  ``batch_id=N`` folder, so a repeated batch replaces itself. A log file is taken whole; a block
  that goes on in the next file needs ``streaming.blocks``, which keeps it open between batches.
* events -> state: the folds are plain aggregates, so Spark keeps their state per key
  (RocksDB); each batch writes the keys it changed, and the newest version of a key counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.operators.messages import extract_messages
from cardloom.operators.ordered import HOT_ROWS
from cardloom.plans.log_flow import LogTables, parser_lines, tables_of_messages
from cardloom.plans.staging import temporary
from cardloom.sources.scan import number_lines


def _batch_folder(folder: str, batch_id: int) -> str:
    return f"{folder.rstrip('/')}/batch_id={batch_id}"


def write_messages(
    lines: DataFrame,
    folder: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "10 seconds",
    hot_rows: int = HOT_ROWS,
    player: str | None = None,
) -> StreamingQuery:
    """Line stream -> message table under ``folder``, by player and place among the player's files.

    ``player`` names the owner of lines that carry no ``player_id``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with temporary(batch.sparkSession):
            messages = extract_messages(parser_lines(number_lines(batch), player), hot_rows)
            messages.write.mode("overwrite").parquet(_batch_folder(folder, batch_id))

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    timing = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**timing).start()


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch_id")


def tables_of_stream(spark: SparkSession, folder: str, **options) -> LogTables:
    """Current-state tables of everything streamed so far."""
    return tables_of_messages(read_messages(spark, folder), **options)


def fold_stream(
    events: DataFrame,
    fold: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Event stream -> folded state under ``folder`` (``fold`` is any aggregate fold)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(folder, batch_id))

    writer = (
        fold(events)
        .writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
    )
    timing = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**timing).start()


def read_state(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key of a folded state."""
    rows = spark.read.parquet(folder)
    facts = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*facts), "batch_id").alias("__s")
    return rows.groupBy(*keys).agg(newest).select(*keys, "__s.*")
