"""Names and classes of play formats and platforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.exprs import as_col, ordered_contains

# Event-id pattern -> display name. The order is part of the
# semantics, since the first pattern contained in the event id decides.
FORMAT_NAMES = (
    ("Historic_Ladder", "Historic"),
    ("Traditional_Historic_Ladder", "Trad. Historic"),
    ("Ladder", "Standard"),
    ("Traditional_Ladder", "Trad. Standard"),
    ("Alchemy_Ladder", "Alchemy"),
    ("Explorer_Ladder", "Explorer"),
    ("Timeless_Ladder", "Timeless"),
    ("Historic_Play", "Historic Play"),
    ("Play", "Standard Play"),
    ("Bot_Match", "Bot Match"),
    ("DirectChallenge", "Direct Challenge"),
    ("PremierDraft", "Premier Draft"),
    ("QuickDraft", "Quick Draft"),
    ("TradDraft", "Trad. Draft"),
    ("CompDraft", "Competitive Draft"),
    ("PickTwoDraft", "Pick Two Draft"),
    ("Sealed", "Sealed"),
    ("Cube", "Cube"),
    ("JumpIn", "Jump In"),
    ("MidweekMagic", "Midweek Magic"),
)

# Patterns the short variant does not know.
NOT_IN_SHORT = ("CompDraft", "PickTwoDraft", "JumpIn", "MidweekMagic")

# Text contained in the display name -> category, in test order.
FORMAT_CATEGORIES = (
    ("draft", "Draft"),
    ("sealed", "Limited"),
    ("historic", "Historic"),
    ("explorer", "Explorer"),
    ("timeless", "Timeless"),
    ("alchemy", "Alchemy"),
    ("standard", "Standard"),
    ("cube", "Cube"),
)

# Platform texts by device class, in test order.
PLATFORM_CLASSES = (
    (("android", "ios", "phone"), "mobile"),
    (("mac", "windows", "pc"), "desktop"),
)

# Trailing date and set-code suffixes, stripped in this order.
SUFFIXES = (r"_\d{6,8}$", r"_[A-Z]{2,4}$", r"_\d{6,8}$", r"_[A-Z]{2,4}$")


def _named(event_id: Column, table, fallback: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for pair in table for x in pair])
    return F.coalesce(exact[event_id], ordered_contains(event_id, table, fallback))


def format_name(event_id: Column | str) -> Column:
    """Display name: exact id, then ordered containment, then the id without suffixes."""
    e = as_col(event_id)
    stripped = e
    for suffix in SUFFIXES:
        stripped = F.regexp_replace(stripped, suffix, "")
    spaced = F.regexp_replace(stripped, "([a-z])([A-Z])", "$1 $2")
    rest = (
        F.when(stripped == "", e)
        .when(stripped.contains("_"), stripped)
        .otherwise(spaced)
    )
    return F.when(e.isNull() | (e == ""), "Unknown").otherwise(
        _named(e, FORMAT_NAMES, rest)
    )


def format_name_short(event_id: Column | str) -> Column:
    """Short variant: fewer patterns, and an unknown id is cut at its first underscore."""
    e = as_col(event_id)
    known = [p for p in FORMAT_NAMES if p[0] not in NOT_IN_SHORT]
    return _named(e, known, F.substring_index(e, "_", 1))


def format_category(event_id: Column | str) -> Column:
    """Group of a format, decided on its display name, which is made once and not for every pattern."""
    name = F.array(F.lower(format_name(event_id)))
    return F.transform(name, lambda n: ordered_contains(n, FORMAT_CATEGORIES, F.lit("Other")))[0]


def is_limited(event_id: Column | str) -> Column:
    return as_col(event_id).rlike("(?i)draft|sealed")


def is_constructed(event_id: Column | str) -> Column:
    return ~is_limited(event_id)


def platform_class(platform: Column | str) -> Column:
    """``mobile``, ``desktop`` or the empty text."""
    p = F.coalesce(as_col(platform), F.lit(""))
    return ordered_contains(p, PLATFORM_CLASSES, F.lit(""))
