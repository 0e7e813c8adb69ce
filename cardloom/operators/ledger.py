"""Count ledger: set / add / subtract / clear operations folded into current counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.exprs import parse_int


def fold_counts(ops: DataFrame) -> DataFrame:
    """Ordered operations ``(set_code, card_id, op, value, seq)`` -> count per card.

    A clear drops everything of its set before it; a set replaces the count; add and
    subtract start from 0 and may go negative. Values that are no whole number are
    ignored. Only aggregates and joins against per-set / per-card tables are used, so a
    card with a third of all operations is summed on the map side.
    """
    value = F.col("value")
    if isinstance(ops.schema["value"].dataType, T.StringType):
        value = parse_int(value)
    rows = ops.select("set_code", "card_id", "op", value.cast("bigint").alias("v"), "seq")
    clears = (
        rows.filter(F.col("op") == "clear")
        .groupBy("set_code")
        .agg(F.max("seq").alias("__clear"))
    )
    live = (
        rows.filter(F.col("op").isin("set", "add", "subtract") & F.col("v").isNotNull())
        .join(clears, "set_code", "left")
        .filter(F.col("__clear").isNull() | (F.col("seq") > F.col("__clear")))
        .drop("__clear")
    )
    last_set = (
        live.filter(F.col("op") == "set")
        .groupBy("set_code", "card_id")
        .agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("__set"))
    )
    signed = F.when(F.col("op") == "add", F.col("v")).otherwise(-F.col("v"))
    deltas = (
        live.filter(F.col("op") != "set")
        .select("set_code", "card_id", "seq", signed.alias("v"))
        .join(
            last_set.select("set_code", "card_id", "__set"), ["set_code", "card_id"], "left"
        )
        .filter(F.col("__set").isNull() | (F.col("seq") > F.col("__set")))
        .select("set_code", "card_id", "v")
    )
    return (
        last_set.select("set_code", "card_id", "v")
        .unionByName(deltas)
        .groupBy("set_code", "card_id")
        .agg(F.sum("v").alias("count"))
    )


def clear_set(counts: DataFrame, set_code: str) -> DataFrame:
    """Current counts without those of one set."""
    return counts.filter(~F.col("set_code").eqNullSafe(F.lit(set_code)))
