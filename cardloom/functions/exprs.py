"""Column helpers shared by every operator.

All of them are compositions of built-in functions, so they stay inside
whole-stage code generation and never start a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name: dots and back-ticks in card names are literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def emit(df, keep, fields, where=None):
    """Project ``fields`` per row and keep rows where ``where(struct)`` holds.

    The generator is a barrier: a filter on the new columns is not pushed below them, so
    long expressions are evaluated once and are not copied into every condition.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))
    if where is not None:
        one = F.filter(one, where)
    return df.select(*keep, F.inline(one))


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_number(*cols: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols])


def parse_int(c: Column | str) -> Column:
    """Leading integer of a text (``'12abc'`` -> 12), null when there is none."""
    digits = F.regexp_extract(as_col(c), r"^\s*([+-]?\d+)", 1)
    return digits.try_cast("bigint")


def contains_ci(c: Column, term: str) -> Column:
    """Case-insensitive substring test against a fixed term."""
    return F.lower(c).contains(term.lower())


def ordered_contains(
    c: Column, rules: Iterable[tuple[Sequence[str] | str, str]], default: Column | None
) -> Column:
    """First rule whose term occurs in ``c`` (any case) decides; list order is the semantics."""
    lowered = F.lower(c)
    chain = None
    for terms, value in rules:
        terms = [terms] if isinstance(terms, str) else terms
        hit = reduce(lambda a, b: a | b, [lowered.contains(t.lower()) for t in terms])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(default)


def win_rate(wins: Column, losses: Column) -> Column:
    """Percentage of decided matches won, 0 when none is decided; draws never count."""
    decided = wins + losses
    return F.when(decided > 0, wins / decided * F.lit(100.0)).otherwise(F.lit(0.0))


def rate_band(rate: Column | str) -> Column:
    """``positive`` from 55 up, ``negative`` from 45 down, else ``neutral``."""
    r = as_col(rate)
    return F.when(r >= 55, "positive").when(r <= 45, "negative").otherwise("neutral")


def natural_sort_key(c: Column | str, width: int = 20) -> Column:
    """Sort key that orders embedded numbers by value: leading integer, then text by number runs.

    Texts without a leading integer sort after those with one. Numbers have no greatest size: those
    beyond a bigint have a null ``number`` and sort by sign and ``beyond``, runs by length and digits.
    ``padded`` has runs of at least ``width`` digits; ``coarse`` is a whole number within 2**61 that never
    falls along the key, for cutting it into chunks.
    """
    text = F.coalesce(as_col(c).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def joined(number) -> Column:
        def part(r: Column) -> Column:
            return F.when(r.rlike(r"^\d"), number(F.regexp_replace(r, r"^0+(?=\d)", ""))).otherwise(F.lower(r))

        return F.array_join(F.transform(runs, part), "")

    def sized(digits: Column) -> Column:
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    lead = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    digits = F.regexp_replace(lead, r"^[+-]?0*(?=\d)", "")
    number = parse_int(text)
    # -1 and 1: an integer below and above all of a bigint
    side = F.when(number.isNotNull(), 0).when(lead.startswith("-"), -1).otherwise(1)
    falling = F.concat(
        F.lpad((F.lit(9_999_999_999) - F.length(digits)).cast("string"), 10, "0"),
        F.translate(digits, "0123456789", "9876543210"),
    )
    far = F.lit(2**61)
    within = F.least(F.greatest(number, -far), far)
    coarse = F.when(lead == "", far + 1).when(number.isNull(), side * far).otherwise(within)
    return F.struct(
        (lead == "").alias("no_number"),
        coarse.alias("coarse"),
        side.alias("side"),
        number.alias("number"),
        F.when(number.isNotNull() | (lead == ""), "").when(side < 0, falling).otherwise(sized(digits)).alias("beyond"),
        joined(sized).alias("ordered"),
        joined(lambda r: F.lpad(r, F.greatest(F.length(r), F.lit(width)), F.lit("0"))).alias("padded"),
        text.alias("raw"),
    )
