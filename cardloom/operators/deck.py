"""Deck lists: consolidation, tracking, text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.cards import (
    COLOUR_SYMBOLS,
    card_type,
    draw_probability,
    mana_list,
    type_rank,
)
from cardloom.functions.exprs import col
from cardloom.operators.idmap import with_card
from cardloom.operators.ordered import HOT_ROWS, previous

# Fixed value: grammar of a deck line (count, name, set in brackets, collector number).
DECK_LINE = r"^(\d+)\s+(.+?)(?:\s+\(([^)]+)\))?(?:\s+\d+)?$"


def consolidate_deck(
    decks: DataFrame, mapping: DataFrame, by: Sequence[str] = ("deck_id", "board"), tasks: int | None = None
) -> DataFrame:
    """Merge the printings of one name: summed quantity, ids, type, mana cost.

    Type and cost come from the printing listed first (``pos``, else the lowest id). Ids
    are summed before the card lookup, so a hot deck or card is reduced on the map side
    and the join sees one row per (deck, id). With ``tasks`` the rows are dealt to so many tasks by the
    first of ``by`` and all groups are made there, so a task's memory follows from their number; a deck
    of a great share of the rows is better left without.
    """
    if tasks is not None:
        decks = decks.repartition(tasks, col(by[0]))
    first = F.min("pos" if "pos" in decks.columns else "grp_id").alias("__first")
    per_id = decks.groupBy(*by, "grp_id").agg(
        F.sum("quantity").cast("bigint").alias("q"), first
    )
    at = F.struct("__first", "grp_id")
    named = with_card(per_id, mapping.select("grp_id", "name", "type", "manaCost"))
    return named.groupBy(*by, F.col("card_name").alias("name")).agg(
        F.sum("q").alias("quantity"),
        F.sort_array(F.collect_set("grp_id")).alias("grp_ids"),
        card_type(F.min_by("type", at)).alias("card_type"),
        F.coalesce(F.min_by("manaCost", at), F.lit("")).alias("mana_cost"),
    )


def remaining_cards(
    deck: DataFrame, seen: DataFrame, by: Sequence[str] = ("deck_id",)
) -> DataFrame:
    """Copies of each deck card still in the library.

    ``deck`` has a row per (by, name) with ``quantity`` and ``grp_ids``; ``seen`` a row per
    visible card with ``zone`` in hand / graveyard / battlefield / exile. Hand copies are
    subtracted as they are, so the count may go below zero; the other zones stop at zero.
    Cards outside the deck are ignored.
    """
    ids = deck.select(*by, "name", F.explode("grp_ids").alias("grp_id"))
    per_id = seen.groupBy(*by, "grp_id").agg(
        F.count_if(F.col("zone") == "hand").alias("h"),
        F.count_if(F.col("zone").isin("graveyard", "battlefield", "exile")).alias("o"),
    )
    counts = (
        per_id.join(ids, [*by, "grp_id"])
        .groupBy(*by, "name")
        .agg(F.sum("h").alias("in_hand"), F.sum("o").alias("__o"))
    )
    joined = deck.join(counts, [*by, "name"], "left")
    hand = F.coalesce("in_hand", F.lit(0))
    left = F.col("quantity") - hand
    return joined.select(
        *[col(c) for c in deck.columns],
        hand.alias("in_hand"),
        F.when(left <= 0, left)
        .otherwise(F.greatest(left - F.coalesce("__o", F.lit(0)), F.lit(0)))
        .alias("remaining"),
    )


def with_draw_probability(cards: DataFrame, library: str = "library_size") -> DataFrame:
    return cards.withColumn("draw_pct", draw_probability("remaining", library))


def deck_by_type(
    deck: DataFrame, by: Sequence[str] = ("deck_id", "board"), remaining: str = "remaining"
) -> DataFrame:
    """Remaining and total copies per card type in display order; empty types have no row."""
    return deck.groupBy(*by, "card_type").agg(
        F.sum(remaining).cast("bigint").alias("remaining"),
        F.sum("quantity").cast("bigint").alias("quantity"),
        F.count(F.lit(1)).alias("names"),
    ).select("*", type_rank("card_type").alias("type_rank"))


def mana_symbols(df: DataFrame, cost: str) -> DataFrame:
    """One row per symbol of a mana cost: position, upper-case symbol, kind."""
    rows = df.select("*", F.posexplode(mana_list(cost)).alias("symbol_pos", "__s"))
    symbol = F.upper("__s")
    return rows.select(
        *[col(c) for c in df.columns],
        "symbol_pos",
        symbol.alias("symbol"),
        F.when(symbol.isin(*COLOUR_SYMBOLS), "colour").otherwise("generic").alias("symbol_kind"),
    )


def _deck_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stripped lines of deck texts; lines after the first blank one are the sideboard."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    cut = df.select(col(key), lines.alias("__l")).select(
        col(key), F.array_position("__l", "").alias("__blank"), F.posexplode("__l").alias("pos", "line")
    )
    side = (F.col("__blank") > 0) & (F.col("pos") >= F.col("__blank"))
    return cut.filter((F.col("line") != "") & ~F.col("line").startswith("//")).select(
        col(key), "pos", "line", F.when(side, "side").otherwise("main").alias("board")
    )


def parse_deck_lists(
    df: DataFrame, key: str = "deck_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Deck texts -> (cards, errors).

    Same names (any case) of one board are summed under the spelling seen first; ``pos``
    is the line of that first spelling. Lines that are no ``quantity name`` are errors.
    """
    lines = _deck_lines(df, key, text)
    good = lines.filter(F.col("line").rlike(DECK_LINE)).select(
        col(key),
        "board",
        "pos",
        F.regexp_extract("line", DECK_LINE, 1).cast("bigint").alias("q"),
        F.trim(F.regexp_extract("line", DECK_LINE, 2)).alias("n"),
    )
    cards = (
        good.groupBy(col(key), "board", F.lower("n").alias("__k"))
        .agg(
            F.min_by("n", "pos").alias("name"),
            F.sum("q").alias("quantity"),
            F.min("pos").alias("pos"),
        )
        .drop("__k")
    )
    errors = lines.filter(~F.col("line").rlike(DECK_LINE)).select(
        col(key), "pos", F.concat(F.lit("Could not parse: "), "line").alias("error")
    )
    return cards, errors


def format_deck_lists(
    cards: DataFrame, key: str = "deck_id", pos: str = "pos"
) -> DataFrame:
    """Deck rows -> text: main deck lines, a blank line, sideboard lines.

    The list gathered per deck is the result itself: one entry per row of that deck.
    """
    entry = F.struct(
        col(pos).alias("p"),
        F.concat_ws(" ", F.col("quantity").cast("string"), F.col("name")).alias("l"),
    )
    boards = cards.groupBy(col(key)).agg(
        F.sort_array(F.collect_list(F.when(F.col("board") == "main", entry))).alias("m"),
        F.sort_array(F.collect_list(F.when(F.col("board") == "side", entry))).alias("s"),
    )
    main = F.transform("m", lambda e: e["l"])
    side = F.transform("s", lambda e: e["l"])
    blank = F.when(F.size("s") > 0, F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return boards.select(col(key), F.array_join(F.concat(main, blank, side), "\n").alias("text"))


def collection_grid(
    mapping: DataFrame, collection: DataFrame, set_code: str = ""
) -> DataFrame:
    """Cards of a set (all sets when empty) with the owned quantity, 0 if none."""
    cards = mapping if not set_code else mapping.filter(F.col("setCode") == set_code)
    owned = collection.select("grp_id", F.col("quantity").alias("__q"))
    return cards.join(owned, "grp_id", "left").select(
        "grp_id",
        "name",
        F.coalesce(F.nullif("rarity", F.lit("")), F.lit("common")).alias("rarity"),
        F.coalesce("__q", F.lit(0)).cast("bigint").alias("owned"),
    )


def turn_changes(
    states: DataFrame,
    by: Sequence[str] = ("match_id",),
    order: Sequence[str] = ("seq",),
    fields: Sequence[str] = ("turn", "library", "hand", "graveyard"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flags ``<field>_changed`` against the previous state; a first state never changes."""
    prior = previous(
        states, list(by), list(order), {f"__p_{f}": F.struct(F.col(f)) for f in fields}, hot_rows
    )
    flags = [
        (
            F.col(f"__p_{f}").isNotNull()
            & ~F.col(f).eqNullSafe(F.col(f"__p_{f}.{f}"))
        ).alias(f"{f}_changed")
        for f in fields
    ]
    return prior.select(*[col(c) for c in states.columns], *flags)
