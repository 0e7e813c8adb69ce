"""Ordered events folded into current-state tables.

``seq`` is the order of events (any orderable column; see ``plans.log_flow`` for the one
built from log files). A fold is an aggregate with ``min_by`` / ``max_by`` over ``seq``:
it combines on the map side, needs no sort per key and gives the same result for every
partitioning, in batch and as a streaming aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.exprs import as_col, col, first_text, ordered_contains
from cardloom.operators.ordered import HOT_ROWS, running_last

UNKNOWN_DECK = "Unknown Deck"

# Match results.
RESULTS = ("win", "loss", "draw")

# Text in the end reason -> (text when won, text otherwise), in test order.
END_REASONS = (
    (("concede", "concession"), "Opponent Conceded", "Conceded"),
    (("timeout", "idle"), "Opponent Timed Out", "Timed Out"),
    (("disconnect", "connection"), "Opponent Disconnected", "Disconnected"),
)


def latest(c: Column | str, seq: Column | str = "seq") -> Column:
    """Value of the last event."""
    return F.max_by(as_col(c), as_col(seq))


def latest_set(c: Column | str, seq: Column | str = "seq") -> Column:
    """Value of the last event that carries one."""
    return F.max_by(as_col(c), F.when(as_col(c).isNotNull(), as_col(seq)))


def earliest(c: Column | str, seq: Column | str = "seq") -> Column:
    """Value of the first event."""
    return F.min_by(as_col(c), as_col(seq))


def fold_matches(starts: DataFrame, by: Sequence[str] = ("match_id",)) -> DataFrame:
    """Match starts -> one row per match.

    The first start keeps its time and play/draw side; later starts overwrite event,
    format and opponent, and deck and platform where they carry one. ``first_seq``,
    ``last_seq`` and ``name_seq`` (start that gave the deck name) feed the next folds.
    """
    named = F.when(F.col("deck_name").isNotNull(), F.col("seq"))
    return starts.groupBy(*by).agg(
        latest("event_id").alias("event_id"),
        latest("format").alias("format"),
        latest_set("deck_id").alias("deck_id"),
        latest_set("deck_name").alias("deck_name"),
        latest("opponent_name").alias("opponent_name"),
        F.lit("draw").alias("result"),
        F.lit(1).alias("game_count"),
        earliest("started_at").alias("started_at"),
        earliest("on_play").alias("on_play"),
        latest_set(first_text(F.col("opponent_platform"))).alias("opponent_platform"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.coalesce(F.max(named), F.min("seq")).alias("name_seq"),
    )


def apply_match_end(
    matches: DataFrame, ends: DataFrame, by: Sequence[str] = ("match_id",)
) -> DataFrame:
    """Latest end after the first start sets the outcome; ends of unknown matches are ignored.

    A start after that end puts the result back to ``draw`` and the count to 1.
    """
    last = ends.groupBy(*by).agg(
        F.max_by(
            F.struct("seq", "result", "game_count", "ended_at", "win_condition", "final_turn"),
            "seq",
        ).alias("e")
    )
    joined = matches.join(last, list(by), "left")
    valid = F.col("e.seq") > F.col("first_seq")
    stands = valid & (F.col("e.seq") > F.col("last_seq"))
    old = [c for c in matches.columns if c not in ("result", "game_count")]
    return joined.select(
        *[col(c) for c in old],
        F.when(stands, F.col("e.result")).otherwise(F.col("result")).alias("result"),
        F.when(stands, F.col("e.game_count")).otherwise(F.col("game_count")).alias("game_count"),
        F.when(valid, F.col("e.ended_at")).alias("ended_at"),
        F.when(valid, first_text(F.col("e.win_condition"))).alias("win_condition"),
        F.when(valid, F.nullif(F.col("e.final_turn"), F.lit(0))).alias("final_turn"),
    )


def fill_deck_name(
    matches: DataFrame, decks: DataFrame, by: Sequence[str] = ("match_id",)
) -> DataFrame:
    """First known deck name seen in a match fills a missing one; its id goes along."""
    seen = decks.filter(
        F.coalesce("deck_name", F.lit("")).isin("", UNKNOWN_DECK) == F.lit(False)
    ).select(*by, "seq", "deck_name", first_text(F.col("deck_id")).alias("deck_id"))
    since = matches.select(*by, "name_seq")
    first = (
        seen.join(since, list(by))
        .filter(F.col("seq") > F.col("name_seq"))
        .groupBy(*by)
        .agg(F.min_by(F.struct("deck_name", "deck_id"), "seq").alias("d"))
    )
    joined = matches.join(first, list(by), "left")
    open_name = F.col("deck_name").isNull() | (F.col("deck_name") == UNKNOWN_DECK)
    fill = open_name & F.col("d").isNotNull()
    return joined.select(
        *[
            F.when(fill, F.col("d.deck_name")).otherwise(F.col(c)).alias(c)
            if c == "deck_name"
            else F.when(fill, F.coalesce("d.deck_id", c)).otherwise(F.col(c)).alias(c)
            if c == "deck_id"
            else col(c)
            for c in matches.columns
        ]
    )


def session_context(
    events: DataFrame,
    by: Sequence[str] = ("player_id",),
    hot_rows: int = HOT_ROWS,
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Add what the session knows before each event.

    ``events``: ``kind`` (match_start, match_end, deck, name, …), ``match_id``,
    ``deck_id``, ``deck_name``. Added: ``in_match``, ``current_match``,
    ``current_deck_id`` (dropped at a match end) and ``current_deck_name`` (last known
    name, which outlives a match, else the name of the current deck).
    """
    kind = F.col("kind")
    start, end, deck = kind == "match_start", kind == "match_end", kind == "deck"
    none = F.lit(None).cast("string")
    known = ~F.coalesce("deck_name", F.lit("")).isin("", UNKNOWN_DECK)
    values = {
        "__match": F.when(start, F.struct(F.col("match_id").alias("x"))).when(
            end, F.struct(none.alias("x"))
        ),
        "__deck": F.when(
            deck, F.struct(F.col("deck_id").alias("i"), F.col("deck_name").alias("n"))
        ).when(end, F.struct(none.alias("i"), none.alias("n"))),
        "__name": F.when(known & ~start & ~end, F.col("deck_name")),
    }
    out = running_last(events, list(by), list(order), values, inclusive=False, hot_rows=hot_rows)
    return out.select(
        *[col(c) for c in events.columns],
        F.col("__match.x").isNotNull().alias("in_match"),
        F.col("__match.x").alias("current_match"),
        F.col("__deck.i").alias("current_deck_id"),
        F.coalesce("__name", first_text(F.col("__deck.n"))).alias("current_deck_name"),
    )


def carry_last_state(
    states: DataFrame,
    matches: DataFrame,
    by: Sequence[str] = ("match_id",),
    strict_reference: bool = False,
) -> DataFrame:
    """Last turn and life totals of each match since its last start (0 / 20 / 20 unseen).

    A life total of 0 is kept, so that a loss by damage can be told; with
    ``strict_reference`` only positive life totals count.
    """
    fresh = states.join(matches.select(*by, "last_seq"), list(by)).filter(
        F.col("seq") > F.col("last_seq")
    )

    def last_of(name: str) -> Column:
        c = F.col(name)
        use = c > 0 if strict_reference or name == "turn" else c.isNotNull()
        return F.max_by(c, F.when(use, F.col("seq"))).alias(name)

    last = fresh.groupBy(*by).agg(*[last_of(n) for n in ("turn", "player_life", "opponent_life")])
    return matches.select(*by).join(last, list(by), "left").select(
        *by,
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.coalesce("player_life", F.lit(20)).alias("player_life"),
        F.coalesce("opponent_life", F.lit(20)).alias("opponent_life"),
    )


def win_condition(
    result: Column | str, reason: Column | str, opponent_life: Column | str, life: Column | str
) -> Column:
    """How a match ended: by the reason text, else by whether the loser still had life."""
    r, won = as_col(result), as_col(result) == "win"
    text = F.lower(F.coalesce(as_col(reason), F.lit("")))
    loser_life = F.when(won, as_col(opponent_life)).when(r == "loss", as_col(life))
    by_life = (
        F.when(~r.isin("win", "loss"), "Unknown")
        .when(loser_life > 0, "Milled")
        .otherwise("Damage")
    )
    if_won = ordered_contains(text, [(t, w) for t, w, _ in END_REASONS], by_life)
    if_not = ordered_contains(text, [(t, n) for t, _, n in END_REASONS], by_life)
    return F.when(won, if_won).otherwise(if_not)


def resolve_deck_names(
    decks: DataFrame,
    summaries: DataFrame,
    by: Sequence[str] = ("player_id",),
    hot_rows: int = HOT_ROWS,
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Unknown deck name + known id -> name from the summaries seen before the deck."""
    mark = F.lit(None).cast("string")
    left = decks.withColumn("__sum", mark).withColumn("__is_deck", F.lit(True))
    right = summaries.select(
        *by, *order, "deck_id", F.col("deck_name").alias("__sum"), F.lit(False).alias("__is_deck")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    out = running_last(
        both, [*by, "deck_id"], list(order), {"__known": F.col("__sum")}, False, hot_rows
    ).filter("__is_deck")
    unknown = F.coalesce("deck_name", F.lit("")).isin("", UNKNOWN_DECK) & (
        F.coalesce("deck_id", F.lit("")) != ""
    )
    return out.select(
        *[
            F.when(unknown, F.coalesce("__known", "deck_name"))
            .otherwise(F.col("deck_name"))
            .alias("deck_name")
            if c == "deck_name"
            else col(c)
            for c in decks.columns
        ]
    )


def fold_collection(
    events: DataFrame, by: Sequence[str] = ("player_id",), at: str = "at"
) -> DataFrame:
    """Card quantities -> latest quantity per card; cards not mentioned stay."""
    return events.groupBy(*by, "grp_id").agg(
        latest("quantity").alias("quantity"), latest(at).alias("updated_at")
    )


def inventory_history(events: DataFrame, at: str = "at") -> DataFrame:
    """One snapshot row per inventory event (append only), numbered by ``seq``."""
    facts = [
        "gems", "gold", "wc_common", "wc_uncommon", "wc_rare", "wc_mythic", "vault_progress",
    ]
    keys = [c for c in ("player_id",) if c in events.columns]
    return events.select(
        *keys, F.col("seq").alias("id"), *facts, F.col(at).alias("recorded_at")
    )


def fold_decks(decks: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Deck versions -> latest version per deck, with the first creation time."""
    fields = [c for c in decks.columns if c not in (*by, "seq", "created_at")]
    return decks.groupBy(*by).agg(
        F.max_by(F.struct(*fields), "seq").alias("__d"),
        earliest("created_at").alias("created_at"),
    ).select(*by, "__d.*", "created_at")


def deck_by_id(decks: DataFrame, deck_id) -> DataFrame:
    return decks.filter(F.col("id") == deck_id)


def apply_notes(
    matches: DataFrame, notes: DataFrame, by: Sequence[str] = ("match_id",)
) -> DataFrame:
    """Latest note per match; an empty note removes it."""
    last = notes.groupBy(*by).agg(F.max_by(F.struct("note"), "seq").alias("__n"))
    joined = matches.join(last, list(by), "left")
    new = first_text(F.col("__n.note"))
    old = F.col("notes") if "notes" in matches.columns else F.lit(None).cast("string")
    keep = [col(c) for c in matches.columns if c != "notes"]
    return joined.select(
        *keep, F.when(F.col("__n").isNotNull(), new).otherwise(old).alias("notes")
    )


def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` the table lacks, as nulls, after its own."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


# Columns of the match table that must be set.
REQUIRED = ("id", "event_id", "format", "opponent_name", "result", "started_at")


def check_matches(matches: DataFrame) -> DataFrame:
    """Violations ``(id, problem)``: missing value, unknown result, repeated id."""
    problems = F.array_compact(
        F.array(
            *[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in REQUIRED],
            F.when(~F.col("result").isin(*RESULTS), F.lit("unknown result")),
        )
    )
    key = F.col("id").cast("string").alias("id")
    per_row = matches.select(key, F.explode(problems).alias("problem"))
    repeated = matches.filter(F.col("id").isNotNull()).groupBy(key).count().filter("count > 1")
    return per_row.union(repeated.select("id", F.lit("repeated id")))


def archetype_tags(tag_ops: DataFrame, by: Sequence[str] = ("deck_name",)) -> DataFrame:
    """Latest tag per deck name; an empty tag removes it."""
    last = tag_ops.groupBy(*by).agg(latest("tag").alias("tag"))
    return last.filter(F.coalesce("tag", F.lit("")) != "")
