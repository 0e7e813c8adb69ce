"""Filters and display rows over the match table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.exprs import contains_ci, first_text
from cardloom.functions.formats import format_name_short, platform_class


def filter_matches(
    matches: DataFrame,
    format: str | None = None,
    result: str | None = None,
    deck: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Matches that pass every given filter; both dates are inclusive.

    Equality and range tests stay plain comparisons, so they reach the file scan.
    """
    out = matches
    kind = matches.schema["started_at"].dataType.simpleString()
    if result:
        out = out.filter(F.col("result") == result)
    if date_from:
        out = out.filter(F.col("started_at") >= F.lit(date_from.isoformat()).cast(kind))
    if date_to:
        after = date_to + timedelta(days=1)
        out = out.filter(F.col("started_at") < F.lit(after.isoformat()).cast(kind))
    if format:
        out = out.filter(
            contains_ci(F.col("format"), format) | contains_ci(F.col("event_id"), format)
        )
    if deck:
        out = out.filter(contains_ci(F.coalesce("deck_name", F.lit("")), deck))
    return out


def match_report(matches: DataFrame) -> DataFrame:
    """One display row per match with the defaults filled in."""
    condition = F.nullif(first_text(F.col("win_condition")), F.lit("Unknown"))
    turn = F.col("final_turn")
    return matches.select(
        "id",
        "result",
        F.coalesce(condition, F.lit("")).alias("win_condition"),
        F.coalesce(first_text(F.col("deck_name")), F.lit("Unknown Deck")).alias("deck"),
        F.coalesce(first_text(F.col("opponent_name")), F.lit("Unknown")).alias("opponent"),
        platform_class("opponent_platform").alias("platform"),
        format_name_short(first_text(F.col("format"), F.col("event_id"))).alias("format"),
        F.when(F.coalesce(turn, F.lit(0)) != 0, F.concat(F.lit("T"), turn.cast("string")))
        .otherwise("")
        .alias("turn"),
        "started_at",
        (F.length(F.trim(F.coalesce("notes", F.lit("")))) > 0).alias("has_notes"),
    )


def export_rows(matches: DataFrame) -> DataFrame:
    """The seven columns of the match export."""
    return matches.select(
        F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.coalesce(first_text(F.col("deck_name")), F.lit("Unknown")).alias("Deck"),
        F.col("opponent_name").alias("Opponent"),
        format_name_short(first_text(F.col("format"), F.col("event_id"))).alias("Format"),
        F.upper("result").alias("Result"),
        F.col("game_count").cast("string").alias("Games"),
        F.when(F.col("on_play"), "Yes").otherwise("No").alias("On Play"),
    )
