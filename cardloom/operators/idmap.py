"""Card-id mapping: three sources resolved into one table keyed by ``grp_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.cards import decode_colours, decode_rarity, normalise_mana
from cardloom.functions.exprs import col

# Columns of the mapping, in output order.
MAPPING_COLUMNS = (
    "grp_id", "name", "manaCost", "type", "rarity", "colors", "colorIdentity", "text", "setCode",
)


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def primary_cards(cards: DataFrame) -> DataFrame:
    """Primary printings that are no tokens (plain tests, pushed into the scan)."""
    return cards.filter((F.col("IsToken") == 0) & (F.col("IsPrimaryCard") == 1))


def localise(cards: DataFrame, loc: DataFrame) -> DataFrame:
    """Add ``name`` and ``type`` by text id, with their defaults.

    No hint: the localisation table is broadcast when its size permits and shuffled
    otherwise, and AQE splits a text id that many cards share.
    """
    titles = loc.select(F.col("LocId").alias("TitleId"), F.col("Loc").alias("__title"))
    types = loc.select(F.col("LocId").alias("TypeTextId"), F.col("Loc").alias("__type"))
    joined = cards.join(titles, "TitleId", "left").join(types, "TypeTextId", "left")
    unknown = F.concat(F.lit("Unknown ("), F.col("TitleId").cast("string"), F.lit(")"))
    return joined.select(
        *[col(c) for c in cards.columns],
        F.coalesce("__title", unknown).alias("name"),
        F.coalesce("__type", F.lit("")).alias("type"),
    )


def card_table_mapping(cards: DataFrame, loc: DataFrame) -> DataFrame:
    """Mapping from the card tables."""
    named = localise(primary_cards(cards), loc)
    return named.select(
        F.col("GrpId").cast("bigint").alias("grp_id"),
        "name",
        normalise_mana("OldSchoolManaText").alias("manaCost"),
        "type",
        decode_rarity("Rarity").alias("rarity"),
        decode_colours("Colors").alias("colors"),
        decode_colours("ColorIdentity").alias("colorIdentity"),
        F.lit("").alias("text"),
        F.upper(F.coalesce("ExpansionCode", F.lit(""))).alias("setCode"),
    )


def first_per_id(rows: DataFrame, order: Sequence[str], key: str = "grp_id") -> DataFrame:
    """First row per id in input order, as one partial + final aggregate."""
    facts = [c for c in rows.columns if c != key and c not in order]
    first = rows.groupBy(key).agg(
        F.min_by(F.struct(*facts), F.struct(*order)).alias("__f")
    )
    return first.select(key, "__f.*")


def printings_mapping(printings: DataFrame) -> DataFrame:
    """Mapping from exploded printings (columns of ``read_printings``)."""
    c = F.col("card")
    grp_id = F.trim(c["identifiers"]["mtgArenaId"]).try_cast("bigint")
    rows = printings.select(
        grp_id.alias("grp_id"),
        F.coalesce(c["name"], F.lit("Unknown")).alias("name"),
        F.coalesce(c["manaCost"], F.lit("")).alias("manaCost"),
        F.coalesce(c["type"], F.lit("")).alias("type"),
        F.coalesce(c["rarity"], F.lit("common")).alias("rarity"),
        F.coalesce(c["colors"], _no_texts()).alias("colors"),
        F.coalesce(c["colorIdentity"], _no_texts()).alias("colorIdentity"),
        F.coalesce(c["text"], F.lit("")).alias("text"),
        F.col("set_code").alias("setCode"),
        "set_pos",
        "card_pos",
    ).filter(F.col("grp_id") > 0)
    return first_per_id(rows, ["set_pos", "card_pos"]).select(*MAPPING_COLUMNS)


def bulk_mapping(cards: DataFrame, order: str = "input_pos") -> DataFrame:
    """Mapping from bulk cards: English, positive id, first wins, set in upper case."""
    rows = cards.filter((F.col("lang") == "en") & (F.col("arena_id") > 0)).select(
        F.col("arena_id").cast("bigint").alias("grp_id"),
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("mana_cost", F.lit("")).alias("manaCost"),
        F.coalesce("type_line", F.lit("")).alias("type"),
        F.coalesce("rarity", F.lit("common")).alias("rarity"),
        F.coalesce("colors", _no_texts()).alias("colors"),
        F.coalesce("color_identity", _no_texts()).alias("colorIdentity"),
        F.coalesce("oracle_text", F.lit("")).alias("text"),
        F.upper(F.coalesce("set", F.lit(""))).alias("setCode"),
        order,
    )
    return first_per_id(rows, [order]).select(*MAPPING_COLUMNS)


def choose_primary(card_tables: DataFrame | None, printings: DataFrame | None) -> DataFrame:
    """Card tables when given, else printings."""
    chosen = card_tables if card_tables is not None else printings
    if chosen is None:
        raise ValueError("no card source given")
    return chosen


def merge_backfill(base: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ids only ``extra`` has; take its text where the base text is empty.

    Returns the mapping and one row of counts (``new_cards``, ``text_backfills``). Ids are
    unique on both sides, so the full join has no hot key.
    """
    facts = [c for c in base.columns if c != "grp_id"]
    b = base.select("grp_id", F.struct(*facts).alias("b"))
    e = extra.select("grp_id", F.struct(*facts).alias("e"))
    both = b.join(e, "grp_id", "full")
    is_new = F.col("b").isNull()
    fills = (
        ~is_new
        & (F.coalesce(F.col("b.text"), F.lit("")) == "")
        & (F.coalesce(F.col("e.text"), F.lit("")) != "")
    )
    picked = [
        (
            F.when(is_new | fills, F.col(f"e.{c}"))
            if c == "text"
            else F.when(is_new, F.col(f"e.{c}"))
        )
        .otherwise(F.col(f"b.{c}"))
        .alias(c)
        for c in facts
    ]
    merged = both.select("grp_id", *picked)
    counts = both.agg(
        F.count_if(is_new).alias("new_cards"), F.count_if(fills).alias("text_backfills")
    )
    return merged, counts


def cards_per_set(mapping: DataFrame, sets: DataFrame) -> DataFrame:
    """Cards per requested set, 0 where it has none. ``sets`` has the column ``setCode``."""
    counts = mapping.groupBy("setCode").agg(F.count(F.lit(1)).alias("__n"))
    return sets.join(counts, "setCode", "left").select(
        "setCode", F.coalesce("__n", F.lit(0)).alias("cards")
    )


def with_card(df: DataFrame, mapping: DataFrame, key: str = "grp_id") -> DataFrame:
    """Left-join card facts; an unknown id is named ``Card #id``.

    The mapping side is broadcast by Spark when it is under the broadcast threshold; a
    larger one is shuffled, and AQE splits hot ids of ``df``.
    """
    facts = [c for c in mapping.columns if c not in ("grp_id", "name")]
    side = mapping.select(
        F.col("grp_id").alias("__id"), F.col("name").alias("__name"), *[col(c) for c in facts]
    )
    joined = df.join(side, col(key) == F.col("__id"), "left")
    fallback = F.concat(F.lit("Card #"), col(key).cast("string"))
    return joined.select(
        *[col(c) for c in df.columns],
        F.coalesce(F.nullif("__name", F.lit("")), fallback).alias("card_name"),
        *[col(c) for c in facts],
    )


def set_list(mapping: DataFrame) -> DataFrame:
    """Set codes for a filter, sorted."""
    return (
        mapping.filter(F.col("setCode") != "").select("setCode").distinct().orderBy("setCode")
    )


def cards_in_set(mapping: DataFrame, set_code: str = "") -> DataFrame:
    """Cards of one set; an empty code stands for all sets."""
    return mapping if not set_code else mapping.filter(F.col("setCode") == set_code)
