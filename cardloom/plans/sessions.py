"""Sessions of players: what is known at each event, with matches closed after a silence.

An event has ``player_id``, ``at`` (event time), ``seq`` (order among equal times), ``kind`` and the
facts of its kind:

| kind | facts |
|---|---|
| ``match_start`` | ``match_id``, ``team`` of the player |
| ``match_end`` | ``match_id`` |
| ``deck`` | ``deck_id``, ``deck_name`` |
| ``name`` | ``deck_name`` (a selection) |
| ``summary`` | ``deck_id``, ``deck_name`` (the list of own decks) |
| ``state`` | ``turn``, ``player_life``, ``opponent_life`` (null: not reported) |

``sessions`` works on a table of events; ``streaming.sessions`` gives the same rows on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.exprs import col, first_text
from cardloom.operators.fold import UNKNOWN_DECK, resolve_deck_names, session_context
from cardloom.operators.ordered import HOT_ROWS, previous, running_last

EVENTS = (
    "player_id string, at timestamp, seq bigint, kind string, match_id string, team int, deck_id string, "
    "deck_name string, turn int, player_life int, opponent_life int"
)
COLUMNS = tuple(c.split()[0] for c in EVENTS.split(", "))
TIMEOUT = "match_timeout"
ORDER = ("us", "seq")

# Turn and life totals of a match before its first state.
FIRST_STATE = (0, 20, 20)


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def _silences(events: DataFrame, timeout_us: int, until_us: int | None, hot_rows: int) -> DataFrame:
    """One ``match_timeout`` event for every match that a silence closes.

    A match is open from its start to the next end or start of the player; the first gap between two
    events in it that is longer than the time-out closes it, as does the time ``until`` after the
    player's last event.
    """
    kind = F.col("kind")
    opened = F.when(kind == "match_start", F.struct(F.col("us").alias("u"), F.col("seq").alias("s"), F.col("match_id").alias("m"))).when(
        kind == "match_end", F.struct(*[F.lit(None).cast("bigint").alias(n) for n in "us"], F.lit(None).cast("string").alias("m"))
    )
    known = running_last(events, ["player_id"], ORDER, {"__open": opened}, True, hot_rows)
    before = previous(
        known.select("player_id", "us", "seq", "__open"), ["player_id"], ORDER, {"__was": F.col("__open"), "__us": F.col("us")}, hot_rows
    )
    inner = before.filter(F.col("us") - F.col("__us") > timeout_us).select("player_id", F.col("__was").alias("open"), F.col("__us").alias("us"))
    gaps = inner
    if until_us is not None:
        last = known.groupBy("player_id").agg(F.max_by(F.struct("__open", "us"), F.struct(*ORDER)).alias("l"))
        tail = last.select("player_id", F.col("l.__open").alias("open"), F.col("l.us").alias("us"))
        gaps = inner.unionByName(tail.filter(F.col("us") + timeout_us <= until_us))
    first = gaps.filter(F.col("open.m").isNotNull()).groupBy("player_id", "open").agg(F.min("us").alias("us"))
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EVENTS.split(", ")[5:]]
    return first.select(
        "player_id",
        F.timestamp_micros(F.col("us") + timeout_us).alias("at"),
        F.lit(-1).cast("bigint").alias("seq"),  # before an event of the same time
        F.lit(TIMEOUT).alias("kind"),
        F.col("open.m").alias("match_id"),
        *blank,
        (F.col("us") + timeout_us).alias("us"),
    )


def sessions(
    events: DataFrame,
    timeout_seconds: int | None = None,
    until: str | None = None,
    name_seconds: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Events with what the session of their player knows just before each.

    Added: ``in_match``, ``current_match``, ``current_deck_id``, ``current_deck_name``, ``own_team`` (of the last
    start since the last end), ``last_turn``, ``last_player_life`` and ``last_opponent_life`` (of the states since
    the last start). Unknown names of decks come from the last summary of the deck before it, of at
    most ``name_seconds`` ago. With ``timeout_seconds`` matches are closed by a ``match_timeout``
    event after a silence; ``until`` is the time up to which silence is known.
    """
    events = events.select(*COLUMNS, micros("at").alias("us"))
    if timeout_seconds is not None:
        until_us = None
        if until is not None:
            until_us = events.sparkSession.range(1).select(micros(F.lit(until).cast("timestamp"))).head()[0]
        events = events.unionByName(_silences(events, timeout_seconds * 1_000_000, until_us, hot_rows))
    named = _named(events, name_seconds, hot_rows)
    kind = F.col("kind")
    # a silence ends a match for the session like its end does
    ends = named.withColumn("__kind", kind).withColumn("kind", F.when(kind == TIMEOUT, "match_end").otherwise(kind))
    told = session_context(_without_names(ends), ["player_id"], hot_rows, ORDER).withColumn("kind", F.col("__kind")).drop("__kind")
    start, end, state = kind == "match_start", kind.isin("match_end", TIMEOUT), kind == "state"
    none = F.lit(None).cast("int")
    team = F.when(start, F.struct(F.col("team").alias("x"))).when(end, F.struct(none.alias("x")))

    def fact(name: str, first: int, use: Column) -> Column:
        fresh = F.struct(F.lit(first).alias("x"))
        return F.when(start, fresh).when(state & use, F.struct(F.col(name).cast("int").alias("x")))

    values = {
        "__team": team,
        "__turn": fact("turn", FIRST_STATE[0], F.col("turn") > 0),
        "__life": fact("player_life", FIRST_STATE[1], F.col("player_life").isNotNull()),
        "__other": fact("opponent_life", FIRST_STATE[2], F.col("opponent_life").isNotNull()),
    }
    out = running_last(told, ["player_id"], ORDER, values, False, hot_rows)
    shown = F.coalesce("deck_name", "__hidden").alias("deck_name")
    return out.select(
        *[shown if c == "deck_name" else col(c) for c in COLUMNS],
        "in_match",
        "current_match",
        "current_deck_id",
        "current_deck_name",
        F.col("__team.x").alias("own_team"),
        F.coalesce("__turn.x", F.lit(FIRST_STATE[0])).alias("last_turn"),
        F.coalesce("__life.x", F.lit(FIRST_STATE[1])).alias("last_player_life"),
        F.coalesce("__other.x", F.lit(FIRST_STATE[2])).alias("last_opponent_life"),
    )


def _without_names(events: DataFrame) -> DataFrame:
    """Summaries name decks of a list, not the current one: hide their names from the context."""
    hidden = events.withColumn("__hidden", F.when(F.col("kind") == "summary", F.col("deck_name")))
    return hidden.withColumn("deck_name", F.when(F.col("kind") != "summary", F.col("deck_name")))


def _named(events: DataFrame, name_seconds: int | None, hot_rows: int) -> DataFrame:
    """Unknown names of decks from the summaries before them."""
    deck = F.col("kind") == "deck"
    listed = events.filter((F.col("kind") == "summary") & first_text(F.col("deck_id")).isNotNull() & first_text(F.col("deck_name")).isNotNull())
    if name_seconds is None:
        found = resolve_deck_names(events.filter(deck), listed, hot_rows=hot_rows, order=ORDER)
    else:
        packed = listed.withColumn("deck_name", F.to_json(F.struct(F.col("us").alias("u"), F.col("deck_name").alias("n"))))
        own = events.filter(deck).withColumn("__own", F.col("deck_name"))
        unknown = F.coalesce("__own", F.lit("")).isin("", UNKNOWN_DECK)
        blind = own.withColumn("deck_name", F.when(unknown, F.lit("")).otherwise(F.col("deck_name")))
        told = resolve_deck_names(blind, packed, hot_rows=hot_rows, order=ORDER)
        known = F.from_json(F.when(unknown, F.nullif("deck_name", F.lit(""))), "u bigint, n string")
        fresh = F.when(F.col("us") - known["u"] <= name_seconds * 1_000_000, known["n"])
        found = told.withColumn("deck_name", F.coalesce(fresh, "__own")).drop("__own")
    return events.filter(~deck).unionByName(found.select(*[col(c) for c in events.columns]))
