"""Client log lines -> ordered events -> match, deck, collection and inventory tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.exprs import first_text
from cardloom.operators import events as E
from cardloom.operators import fold
from cardloom.operators import messages as M
from cardloom.operators.ordered import HOT_ROWS
from cardloom.plans.staging import stage
from cardloom.sources.scan import log_time


def with_player(lines: DataFrame, player: str | None = None) -> DataFrame:
    """Add ``player_id`` when the lines carry none."""
    if "player_id" in lines.columns:
        return lines
    return lines.withColumn("player_id", F.lit(player or "local"))


def parser_lines(lines: DataFrame, player: str | None = None) -> DataFrame:
    """Lines (or messages) of log files as one parser per player reads them: file after file.

    ``source_file`` becomes the player, and ``line_no`` the place (``log_time``, ``file``, ``line``) among the
    lines of all files, so the operators keep their state over a rotation and files of one name of two
    players stay apart. Files without a time in their name are left out.
    """
    lines = with_player(lines, player)
    place = F.struct(log_time("source_file").alias("log_time"), F.col("source_file").alias("file"), F.col("line_no").alias("line"))
    others = [c for c in lines.columns if c not in ("player_id", "source_file", "line_no")]
    name = F.coalesce(F.col("player_id").cast("string"), F.lit(""))
    return lines.select(name.alias("source_file"), place.alias("line_no"), *others).filter(F.col("line_no.log_time").isNotNull())


@dataclass(frozen=True)
class LogEvents:
    """Typed events of placed lines; every table has ``source_file`` (player), ``line_no`` (place), ``ord``."""

    messages: DataFrame
    routed: DataFrame
    inventory: DataFrame
    boosters: DataFrame
    collection: DataFrame
    match_starts: DataFrame
    match_ends: DataFrame
    game_states: DataFrame
    zone_cards: DataFrame
    decks: DataFrame
    deck_cards: DataFrame
    summaries: DataFrame
    selections: DataFrame


def events_of(
    messages: DataFrame, platform: str = "Mac", hot_rows: int = HOT_ROWS
) -> LogEvents:
    """Every typed event table of a message table (rows of ``extract_messages``)."""
    # Routed messages feed a dozen tables: written once, read by kind.
    routed = stage(M.route(messages), "routed", "kind")
    starts = E.match_starts(routed, platform)
    decks = E.deck_identity(E.deck_from_message(routed))
    course_cards, course_picks = E.course_decks(routed)
    where = ["source_file", "line_no", "ord"]

    # Courses of one message come in order; each gives a selection, then a deck.
    picks = course_picks.select(
        "source_file", "line_no", (F.col("ord") + F.col("course") / 1e6).alias("ord"),
        "deck_id", "deck_name",
    )
    course_heads = (
        course_cards.select(
            "source_file", "line_no", (F.col("ord") + F.col("course") / 1e6 + 5e-7).alias("ord"),
            "deck_id", "deck_name",
        )
        .distinct()
    )
    all_decks = decks.select(*where[:2], F.col("ord").cast("double").alias("ord"), "deck_id", "deck_name").unionByName(course_heads)
    named = ["source_file", "line_no", "ord", "deck_name"]
    others = all_decks.select(*named).unionByName(picks.select(*named))
    by_line = M.deck_name_from_line(messages, None, hot_rows).select(*named)
    asked = M.deck_from_request(
        routed, others.unionByName(by_line.withColumn("ord", F.col("ord").cast("double")))
    )
    known = others.unionByName(asked.select(*named))
    lined = M.deck_name_from_line(messages, known, hot_rows)
    selected = (
        picks.unionByName(asked.drop("origin"))
        .unionByName(lined.withColumn("ord", F.col("ord").cast("double")))
    )
    cards = E.normalise_deck_list(decks).withColumn("ord", F.col("ord").cast("double"))
    course_rows = course_cards.select(
        "source_file", "line_no", (F.col("ord") + F.col("course") / 1e6 + 5e-7).alias("ord"),
        "board", "pos", "grp_id", "quantity",
    )
    return LogEvents(
        messages=messages,
        routed=routed,
        inventory=E.inventory_events(routed),
        boosters=E.boosters(routed),
        collection=E.collection_events(routed),
        match_starts=starts,
        match_ends=E.match_ends(routed, starts, platform, hot_rows),
        game_states=E.game_states(routed),
        zone_cards=E.zone_cards(routed),
        decks=all_decks,
        deck_cards=cards.unionByName(course_rows),
        summaries=E.deck_summaries(routed),
        selections=selected,
    )


def ordered(events: DataFrame) -> DataFrame:
    """Add ``player_id``, ``seq`` (file time, file, line, order in the line) and ``at`` (file time)."""
    seq = F.struct(F.col("line_no").alias("line"), F.col("ord").cast("double").alias("ord"))
    return events.select(F.col("source_file").alias("player_id"), seq.alias("seq"), F.col("line_no.log_time").alias("at"), "*")


@dataclass(frozen=True)
class LogTables:
    matches: DataFrame
    collection: DataFrame
    inventory: DataFrame


def tables_of(
    lines: DataFrame, platform: str = "Mac", hot_rows: int = HOT_ROWS
) -> LogTables:
    """Current-state tables of the logs of many players.

    Event times are those of the log file, since the lines carry none.
    """
    messages = stage(M.extract_messages(parser_lines(lines), hot_rows), "messages")
    return tables_of_messages(messages, platform, hot_rows)


def tables_of_messages(messages: DataFrame, platform: str = "Mac", hot_rows: int = HOT_ROWS) -> LogTables:
    """The same from a stored message table of placed lines (``parser_lines``)."""
    ev = events_of(messages, platform, hot_rows)
    seen = ordered

    summaries = seen(ev.summaries).select("player_id", "seq", "deck_id", "deck_name")
    decks = fold.resolve_deck_names(
        _flat(seen(ev.decks).select("player_id", "seq", "deck_id", "deck_name")),
        _flat(summaries),
        hot_rows=hot_rows,
        order=["line", "tie"],
    )
    picks = _flat(seen(ev.selections).select("player_id", "seq", "deck_id", "deck_name"))
    starts = stage(_flat(seen(ev.match_starts)), "starts")
    ends = stage(_flat(seen(ev.match_ends)), "ends")
    states = _flat(seen(ev.game_states))
    base = ["player_id", "line", "tie", "seq"]

    def tagged(df: DataFrame, kind: str, *cols: str) -> DataFrame:
        return df.select(*base, F.lit(kind).alias("kind"), *cols)

    stream = (
        tagged(starts, "match_start", "match_id")
        .unionByName(tagged(ends, "match_end", "match_id"), allowMissingColumns=True)
        .unionByName(tagged(decks, "deck", "deck_id", "deck_name"), allowMissingColumns=True)
        .unionByName(tagged(picks, "name", "deck_id", "deck_name"), allowMissingColumns=True)
        .unionByName(tagged(states, "state", "turn", "player_life", "opponent_life",
                            "life_reported", "opponent_life_reported"), allowMissingColumns=True)
    )
    context = stage(
        fold.session_context(stream, hot_rows=hot_rows, order=["line", "tie"]), "context", "kind"
    )
    at_start = context.filter("kind = 'match_start'").select(
        "player_id", "seq", F.col("current_deck_name").alias("deck_name")
    )
    key = ["player_id", "match_id"]
    opened = starts.join(at_start, ["player_id", "seq"]).select(
        *key,
        "seq",
        "event_id",
        first_text(F.col("game_mode"), F.col("event_id")).alias("format"),
        F.lit(None).cast("string").alias("deck_id"),
        "deck_name",
        "opponent_name",
        "opponent_platform",
        F.col("at").alias("started_at"),
        (F.col("seat_id") == 1).alias("on_play"),
    )
    matches = fold.fold_matches(opened, key)
    in_match = context.filter("in_match").withColumn("match_id", F.col("current_match"))
    last = fold.carry_last_state(
        in_match.filter("kind = 'state'").select(
            *key, "seq", "turn",
            F.when(F.col("life_reported"), F.col("player_life")).alias("player_life"),
            F.when(F.col("opponent_life_reported"), F.col("opponent_life")).alias("opponent_life"),
        ),
        matches,
        key,
    )
    closed = ends.join(last, key).select(
        *key,
        "seq",
        "result",
        "game_count",
        F.col("at").alias("ended_at"),
        fold.win_condition("result", "reason", "opponent_life", "player_life").alias("win_condition"),
        F.col("turn").alias("final_turn"),
    )
    ended = fold.apply_match_end(matches, closed, key)
    named = fold.fill_deck_name(
        ended,
        in_match.filter("kind in ('deck', 'name')").select(*key, "seq", "deck_id", "deck_name"),
        key,
    )
    return LogTables(
        matches=named.withColumnRenamed("match_id", "id").drop("first_seq", "last_seq", "name_seq"),
        collection=fold.fold_collection(_flat(seen(ev.collection))),
        inventory=fold.inventory_history(_flat(seen(ev.inventory))),
    )


def _flat(df: DataFrame) -> DataFrame:
    """Order parts as plain columns next to ``seq``, for the ordered operators."""
    return df.withColumn("line", F.col("seq.line")).withColumn("tie", F.col("seq.ord"))
