"""Folds on a stream that rewrite only the keys a batch touches.

A fold needs few of a key's events: the first, the last, the last that carries a name. The state
table holds just these (``Fold.digest``), so folding them again together with new events gives what
folding all events would give, in whatever order the batches come.

Keys are dealt to buckets by hash. A batch reads the buckets of its keys, digests their rows with its
own, and writes these buckets anew under its number; a small log file per batch tells the number
under which each bucket was written last. So a bucket is always one version, reading a batch's buckets
costs the same after any number of batches, and versions that the last ``KEPT`` logs do not name are
deleted. A repeated batch starts from the log before it and writes the same again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.functions.exprs import col, first_text
from cardloom.operators import fold as folds
from cardloom.plans import folders

BUCKETS = 64
KEPT = 3
_BUCKET = "bucket"


@dataclass(frozen=True)
class Fold:
    """``by``: key columns; ``digest``: the events that the result rests on; ``result``: the table."""

    by: tuple[str, ...]
    digest: Callable[[DataFrame], DataFrame]
    result: Callable[[DataFrame], DataFrame]


def keep_events(events: DataFrame, by: Sequence[str], *picks: Column) -> DataFrame:
    """The events that the aggregates ``picks`` (each a row per key) choose, once each."""
    chosen = F.array_distinct(F.array_compact(F.array(*picks)))
    rows = events.groupBy(*[col(b) for b in by]).agg(chosen.alias("__rows"))
    return rows.select(F.explode("__rows").alias("__row")).select("__row.*")


def last_event(events: DataFrame, told: Column | None = None, seq: str = "seq") -> Column:
    """The last event, or the last for which ``told`` is not null."""
    row = F.struct(*[col(c) for c in events.columns])
    return F.max_by(row, col(seq) if told is None else F.when(told.isNotNull(), col(seq)))


def first_event(events: DataFrame, seq: str = "seq") -> Column:
    return F.min_by(F.struct(*[col(c) for c in events.columns]), col(seq))


def collection_fold(by: Sequence[str] = ("player_id",)) -> Fold:
    """Events of ``fold_collection``."""
    keys = (*by, "grp_id")
    return Fold(keys, lambda e: keep_events(e, keys, last_event(e)), lambda e: folds.fold_collection(e, by))


def deck_fold(by: Sequence[str] = ("id",)) -> Fold:
    """Events of ``fold_decks``."""
    keys = tuple(by)
    return Fold(keys, lambda e: keep_events(e, keys, first_event(e), last_event(e)), lambda e: folds.fold_decks(e, keys))


def match_fold(by: Sequence[str] = ("match_id",)) -> Fold:
    """Starts, ends and deck names of matches, told apart by ``kind`` (``start``, ``end``, ``name``).

    Of the names all known ones stay, as a later start decides which of them counts.
    """
    keys = tuple(by)

    def digest(e: DataFrame) -> DataFrame:
        start, end = e.filter("kind = 'start'"), e.filter("kind = 'end'")
        name, platform = F.col("deck_name"), first_text(F.col("opponent_platform"))
        kept = keep_events(
            start, keys, first_event(start), last_event(start), last_event(start, F.col("deck_id")), last_event(start, name), last_event(start, platform)
        )
        known = e.filter("kind = 'name'").filter(~F.coalesce(name, F.lit("")).isin("", folds.UNKNOWN_DECK)).distinct()
        return kept.unionByName(keep_events(end, keys, last_event(end))).unionByName(known)

    def result(e: DataFrame) -> DataFrame:
        matches = folds.fold_matches(e.filter("kind = 'start'"), keys)
        ended = folds.apply_match_end(matches, e.filter("kind = 'end'"), keys)
        return folds.fill_deck_name(ended, e.filter("kind = 'name'"), keys)

    return Fold(keys, digest, result)


def _log_of(spark: SparkSession, folder: str, before: int | None = None) -> dict[str, int]:
    """Version of every bucket after the newest batch (before a given one)."""
    batches = [int(n.removesuffix(".json")) for n in folders.names(spark, f"{folder}/log") if n.endswith(".json") and not n.startswith("_")]
    older = [b for b in batches if before is None or b < before]
    return json.loads(folders.read_text(spark, f"{folder}/log/{max(older)}.json")) if older else {}


def _paths(folder: str, log: dict[str, int]) -> list[str]:
    return [f"{folder}/data/version={v}/{_BUCKET}={b}" for b, v in sorted(log.items())]


def _expire(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Delete old logs, and the buckets that no log names any more."""
    batches = sorted(int(n.removesuffix(".json")) for n in folders.names(spark, f"{folder}/log") if n.endswith(".json") and not n.startswith("_"))
    for b in batches[:-KEPT]:
        folders.delete(spark, f"{folder}/log/{b}.json")
    named = {(b, v) for n in batches[-KEPT:] for b, v in json.loads(folders.read_text(spark, f"{folder}/log/{n}.json")).items()}
    for version in folders.names(spark, f"{folder}/data"):
        number = int(version.split("=")[1])
        held = [n for n in folders.names(spark, f"{folder}/data/{version}") if n.startswith(f"{_BUCKET}=")]
        old = [n for n in held if (n.split("=")[1], number) not in named]
        if number <= batch_id and len(old) == len(held):
            folders.delete(spark, f"{folder}/data/{version}")
        else:
            for n in old:
                folders.delete(spark, f"{folder}/data/{version}/{n}")


def refold_batch(batch: DataFrame, batch_id: int, fold: Fold, folder: str, buckets: int = BUCKETS) -> int:
    """Fold a batch into the state table; returns the number of buckets read."""
    spark = batch.sparkSession
    folder = folder.rstrip("/")
    number = F.pmod(F.xxhash64(*[col(b) for b in fold.by]), F.lit(buckets)).cast("int")
    new = fold.digest(batch).persist()  # pre-aggregated: few rows per key
    try:
        touched = [str(r[0]) for r in new.select(number.alias(_BUCKET)).distinct().collect()]  # at most ``buckets``
        if not touched:
            return 0
        log = _log_of(spark, folder, batch_id)
        read = {b: log[b] for b in touched if b in log}
        rows = new
        if read:
            held = spark.read.schema(new.schema).parquet(*_paths(folder, read))
            rows = fold.digest(new.unionByName(held))
        placed = rows.withColumn(_BUCKET, number).repartition(len(touched), _BUCKET)
        placed.write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{folder}/data/version={batch_id}")
        folders.write_text(spark, f"{folder}/log/{batch_id}.json", json.dumps({**log, **dict.fromkeys(touched, batch_id)}))
        _expire(spark, folder, batch_id)
        return len(read)
    finally:
        new.unpersist()


def refold_stream(
    events: DataFrame,
    fold: Fold,
    folder: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Event stream -> state table under ``folder``. ``buckets`` must stay the same."""

    def run(batch: DataFrame, batch_id: int) -> None:
        refold_batch(batch, batch_id, fold, folder, buckets)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    timing = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**timing).start()


def read_folded(spark: SparkSession, fold: Fold, folder: str, schema) -> DataFrame:
    """The folded table; ``schema``: that of the events."""
    paths = _paths(folder.rstrip("/"), _log_of(spark, folder.rstrip("/")))
    events = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return fold.result(events)
