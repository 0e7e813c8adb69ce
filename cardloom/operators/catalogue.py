"""Bulk card records -> cards, sets, faces, application catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.cards import (
    best_price,
    colour_class,
    comma_list,
    comma_text,
    image_url,
    price,
    value_hint,
)
from cardloom.functions.exprs import col, natural_sort_key
from cardloom.operators.ordered import HOT_ROWS, row_positions

# Sets of the application catalogue, by release.
DEFAULT_SETS = (
    "MH2", "NEO", "SNC", "DMU", "BRO", "ONE", "MOM", "LTR", "WOE", "LCI", "MKM", "OTJ",
    "MH3", "BLB", "DSK", "FDN", "DFT", "TDM", "FIN", "EOE", "SPM", "TLA", "TMT",
)

# Card fields taken over as they are.
PLAIN_FIELDS = (
    "id", "name", "set", "set_name", "collector_number", "rarity", "type_line", "mana_cost",
    "cmc", "oracle_text", "power", "toughness", "loyalty", "layout",
)

# Face fields taken over as they are.
FACE_FIELDS = (
    "name", "mana_cost", "type_line", "oracle_text", "power", "toughness", "loyalty",
)


def paper_english(cards: DataFrame) -> DataFrame:
    """English cards that are not digital only (missing flag = paper)."""
    return cards.filter(
        (F.col("lang") == "en") & ~F.coalesce(F.col("digital"), F.lit(False))
    )


def normalise_prices(cards: DataFrame) -> DataFrame:
    """Add the three prices as numbers and the best of them."""
    p = F.col("prices")
    usd, foil, etched = price(p["usd"]), price(p["usd_foil"]), price(p["usd_etched"])
    return cards.select(
        "*",
        usd.alias("price_usd"),
        foil.alias("price_usd_foil"),
        etched.alias("price_usd_etched"),
        best_price(usd, foil, etched).alias("price_best"),
    )


def flatten_card(cards: DataFrame) -> DataFrame:
    """One flat row per card; lists become comma text."""
    return normalise_prices(cards).select(
        *PLAIN_FIELDS,
        comma_text("colors").alias("colors"),
        comma_text("color_identity").alias("color_identity"),
        comma_text("keywords").alias("keywords"),
        image_url("image_uris", "card_faces").alias("image_url"),
        "price_usd",
        "price_usd_foil",
        "price_usd_etched",
        "price_best",
    )


def sets_from_cards(
    cards: DataFrame,
    order: str = "input_pos",
    key: str = "set",
    facts: Sequence[str] = ("set_name", "released_at"),
) -> DataFrame:
    """Facts of the first card of each set; blank set codes have none."""
    first = F.min_by(F.struct(*[col(f) for f in facts]), col(order)).alias("__f")
    named = cards.filter(F.coalesce(col(key), F.lit("")) != "")
    return named.groupBy(col(key)).agg(first).select(col(key), "__f.*")


def card_faces(cards: DataFrame) -> DataFrame:
    """One row per face with its 0-based index; no shuffle."""
    faces = cards.select(
        F.col("id").alias("card_id"), F.posexplode("card_faces").alias("face_index", "f")
    )
    return faces.select(
        "card_id",
        "face_index",
        *[F.col(f"f.{c}").alias(c) for c in FACE_FIELDS],
        comma_text(F.col("f.colors")).alias("colors"),
    )


def filter_sets(
    df: DataFrame, codes: Sequence[str] = DEFAULT_SETS, key: str = "set"
) -> DataFrame:
    """Upper-case the set code and keep the listed ones."""
    upper = F.upper(col(key))
    wanted = [c.upper() for c in codes]
    kept = df.filter(upper.isin(*wanted))
    return kept.select(*[upper.alias(key) if c == key else col(c) for c in df.columns])


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """The table itself, or an error when it is empty."""
    if df.isEmpty():
        raise ValueError(f"no {what} to write")
    return df


def app_catalogue(cards: DataFrame) -> DataFrame:
    """Rows of ``flatten_card`` in the shape of the application catalogue."""
    return cards.select(
        "id",
        "name",
        F.col("set").alias("setCode"),
        F.col("set_name").alias("setName"),
        F.col("collector_number").alias("collectorNumber"),
        comma_list("colors").alias("colors"),
        F.coalesce("type_line", F.lit("")).alias("typeLine"),
        F.coalesce("rarity", F.lit("")).alias("rarity"),
        value_hint("price_best").alias("valueHint"),
        F.col("image_url").alias("imageUrl"),
    )


def cards_by_set(
    catalogue: DataFrame,
    order: str = "input_pos",
    key: str = "setCode",
    name: str = "setName",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Cards under their set, sets numbered in first-seen order.

    The result stays one row per card (``set_index``, first-seen set name), so a set with
    a third of all cards is never gathered into one value.
    """
    heads = catalogue.groupBy(col(key)).agg(
        F.min(col(order)).alias("__first"),
        F.min_by(col(name), col(order)).alias("__name"),
        F.count(F.lit(1)).alias("set_size"),
    )
    ranked = row_positions(heads, [], ["__first", key], "set_index", hot_rows=hot_rows)
    side = ranked.select(col(key).alias("__k"), "__name", "set_size", "set_index")
    joined = catalogue.join(side, col(key).eqNullSafe(F.col("__k")))
    return joined.select(
        "set_index",
        "set_size",
        *[F.col("__name").alias(name) if c == name else col(c) for c in catalogue.columns],
    )


def browse_cards(
    catalogue: DataFrame,
    set_code: str,
    colour: str = "ALL",
    term: str = "",
    key: str = "collectorNumber",
) -> DataFrame:
    """Cards of a set by colour class and name part, in collector order."""
    out = catalogue.filter(F.col("setCode") == set_code)
    if colour != "ALL":
        out = out.filter(colour_class("colors") == colour)
    term = term.strip().lower()
    if term:
        out = out.filter(F.lower("name").contains(term))
    return out.orderBy(natural_sort_key(key), "id")


def index_page(
    df: DataFrame,
    i: int | None = None,
    by: Sequence[str] = ("setCode",),
    key: str = "collectorNumber",
    tie: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``position`` of ``n`` for every row in collector order, or only the row at index ``i``."""
    k = natural_sort_key(key)
    keyed = df.select(
        "*",
        k["coarse"].alias("__coarse"),
        k["side"].alias("__side"),
        k["number"].alias("__num"),
        k["beyond"].alias("__beyond"),
        k["ordered"].alias("__runs"),
        k["raw"].alias("__raw"),
    )
    order = ["__coarse", "__side", "__num", "__beyond", "__runs", "__raw", tie]
    out = row_positions(keyed, list(by), order, "position", "n", hot_rows)
    out = out.drop("__coarse", "__side", "__num", "__beyond", "__runs", "__raw")
    return out if i is None else out.filter(F.col("position") == i + 1)
