"""Expressions over card attributes: prices, images, types, colours, mana."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.exprs import as_col, first_text, ordered_contains

# Contained text -> card type, in test order.
CARD_TYPES = (
    "creature", "instant", "sorcery", "enchantment", "artifact", "planeswalker", "land",
)

# Order in which the types of a deck are shown.
TYPE_ORDER = (
    "creature", "planeswalker", "instant", "sorcery", "enchantment", "artifact", "land",
    "other",
)

# Colour and rarity codes of the card tables.
COLOUR_CODES = {1: "W", 2: "U", 3: "B", 4: "R", 5: "G"}
RARITY_CODES = {0: "token", 1: "common", 2: "uncommon", 3: "rare", 4: "mythic", 5: "land"}

# Symbols that stand for one colour (or colourless) of mana.
COLOUR_SYMBOLS = ("W", "U", "B", "R", "G", "C")

# Image sizes from best to worst.
IMAGE_SIZES = ("normal", "large", "png")


def price(text: Column | str) -> Column:
    """Price text as double; null when it is missing or no number."""
    return as_col(text).try_cast("double")


def best_price(a: Column, b: Column, c: Column) -> Column:
    """Highest of the prices that are present."""
    return F.greatest(a, b, c)


def _best_image(uris: Column) -> Column:
    return first_text(*[uris[size] for size in IMAGE_SIZES])


def image_url(uris: Column | str, faces: Column | str) -> Column:
    """Card image, else the image of the first face that has one."""
    on_faces = F.filter(
        F.transform(as_col(faces), lambda f: _best_image(f["image_uris"])),
        lambda u: u.isNotNull(),
    )
    return F.coalesce(_best_image(as_col(uris)), F.try_element_at(on_faces, F.lit(1)))


def comma_text(values: Column | str) -> Column:
    """List as comma text; a missing list is the empty text."""
    return F.array_join(
        F.coalesce(as_col(values), F.array().cast("array<string>")), ","
    )


def comma_list(text: Column | str) -> Column:
    """Comma text as list; empty or missing text is the empty list."""
    t = as_col(text)
    empty = F.array().cast("array<string>")
    return F.when(t.isNull() | (t == ""), empty).otherwise(F.split(t, ","))


def value_hint(best: Column | str) -> Column:
    """``$1.50`` for a positive price, else null."""
    b = as_col(best)
    return F.when((b > 0) & ~F.isnan(b), F.format_string("$%.2f", b))


def colour_class(colours: Column | str) -> Column:
    """``C`` without colours, ``MULTI`` with several, else the colour itself."""
    c = as_col(colours)
    n = F.coalesce(F.size(c), F.lit(0))
    return F.when(n <= 0, "C").when(n > 1, "MULTI").otherwise(F.try_element_at(c, F.lit(1)))


def split_type_line(line: Column | str) -> Column:
    """Struct of ``main_type`` and ``subtype`` around the dash of a type line."""
    text = F.coalesce(as_col(line), F.lit(""))
    parts = F.filter(
        F.transform(F.split(text, "—"), lambda p: F.trim(p)), lambda p: p != ""
    )
    two = F.size(parts) >= 2
    return F.struct(
        F.when(two, F.try_element_at(parts, F.lit(1))).otherwise(text).alias("main_type"),
        F.when(two, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " — "))
        .otherwise("")
        .alias("subtype"),
    )


def card_type(type_text: Column | str) -> Column:
    """Main type of a card; the first type contained in the text decides."""
    text = F.coalesce(as_col(type_text), F.lit(""))
    return ordered_contains(text, [(t, t) for t in CARD_TYPES], F.lit("other"))


def type_rank(card_type_col: Column | str) -> Column:
    """Position of a type in the display order of a deck."""
    order = F.array(*[F.lit(t) for t in TYPE_ORDER])
    rank = F.array_position(order, as_col(card_type_col))
    return F.when(rank > 0, rank).otherwise(len(TYPE_ORDER)).cast("int")


def decode_rarity(code: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RARITY_CODES.items() for x in kv])
    return F.coalesce(table[as_col(code).cast("int")], F.lit("common"))


def decode_colours(codes: Column | str) -> Column:
    """``'1,3'`` -> ``['W', 'B']``; unknown codes stay as text, blanks are dropped."""
    table = F.create_map(
        *[F.lit(x) for k, v in COLOUR_CODES.items() for x in (str(k), v)]
    )
    parts = F.transform(
        F.split(F.coalesce(as_col(codes), F.lit("")), ","), lambda p: F.trim(p)
    )
    numbers = F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.coalesce(p.try_cast("bigint").cast("string"), p),
    )
    return F.transform(numbers, lambda n: F.coalesce(table[n], n))


def normalise_mana(text: Column | str) -> Column:
    """``o2oUoU`` -> ``{2}{U}{U}``."""
    return F.regexp_replace(F.coalesce(as_col(text), F.lit("")), "o([^o]+)", "{$1}")


def mana_list(cost: Column | str) -> Column:
    """Symbols of a mana cost in order."""
    return F.regexp_extract_all(as_col(cost), F.lit(r"\{([^}]+)\}"), F.lit(1))


def draw_probability(remaining: Column | str, library: Column | str) -> Column:
    """Chance in percent that the next card is one of ``remaining`` copies."""
    r, n = as_col(remaining), as_col(library)
    return F.when((r <= 0) | (n <= 0), 0.0).otherwise(
        F.least(r / n * F.lit(100.0), F.lit(100.0))
    )
