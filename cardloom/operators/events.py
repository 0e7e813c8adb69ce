"""Routed messages -> typed event tables.

Input rows are those of ``messages.route``: ``(source_file, line_no, ord, kind, payload)``.
All work is inside a row (variant paths and array functions over one message), so these
operators are narrow; the few that look across messages say so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.exprs import as_col, col, emit, first_text, parse_int
from cardloom.functions.variants import (
    first_items,
    first_obj,
    first_text_of,
    first_whole_of,
    has,
    is_object,
    items,
    number,
    obj,
    strict_json,
    sub,
    text,
    whole,
)
from cardloom.operators.ordered import HOT_ROWS, running_last, split_hot

UNKNOWN_DECK = "Unknown Deck"
WHERE = ("source_file", "line_no", "ord")

# Message and state types of the log.
GAME_STATE = "GREMessageType_GameStateMessage"
CONNECT = "GREMessageType_ConnectResp"
PLAYING = "MatchGameRoomStateType_Playing"
COMPLETED = "MatchGameRoomStateType_MatchCompleted"
MATCH_SCOPE, GAME_SCOPE = "MatchScope_Match", "MatchScope_Game"

# Aliases of deck fields, in the order in which they are tried.
MAIN_FIELDS = ("mainDeck", "deckCards", "MainDeck")
SIDE_FIELDS = ("sideboard", "sideboardCards", "Sideboard")
CARD_ID_FIELDS = ("cardId", "grpId", "CardId")
QUANTITY_FIELDS = ("quantity", "Quantity")
DECK_NAME_FIELDS = ("name", "deckName", "Name", "DeckName")
DECK_ID_FIELDS = ("id", "deckId", "Id", "DeckId")
SUMMARY_FIELDS = ("summary", "Summary", "deckSummary", "DeckSummary")

# Inventory column -> aliases in the order in which they are tried.
INVENTORY_FIELDS = {
    "gems": ("Gems", "gems"),
    "gold": ("Gold", "gold"),
    "wc_common": ("WildCardCommons", "wcCommon", "wcCommons"),
    "wc_uncommon": ("WildCardUnCommons", "wcUncommon", "wcUncommons"),
    "wc_rare": ("WildCardRares", "wcRare", "wcRares"),
    "wc_mythic": ("WildCardMythics", "wcMythic", "wcMythics"),
    "draft_tokens": ("DraftTokens", "draftTokens"),
    "sealed_tokens": ("SealedTokens", "sealedTokens"),
}

# Fields that may hold the collection, in the order in which they are tried.
COLLECTION_FIELDS = (
    "cardsInInventory", "CardsInInventory", "collection", "Collection", "cards", "Cards",
)

# Zones of the tracked seat.
ZONES = {
    "ZoneType_Graveyard": "graveyard",
    "ZoneType_Hand": "hand",
    "ZoneType_Battlefield": "battlefield",
    "ZoneType_Exile": "exile",
}

PLAYERS = (
    "array<struct<userId string, playerName string, systemSeatId bigint, teamId bigint, "
    "platformId string, eventId string>>"
)
RESULTS = "array<struct<scope string, result string, winningTeamId bigint, reason string>>"


def _where(df: DataFrame) -> list[str]:
    return [c for c in WHERE if c in df.columns]


# --- decks -----------------------------------------------------------------------------


def _entry_id(e: Column) -> Column:
    return F.coalesce(
        F.when(is_object(e), first_whole_of(e, *CARD_ID_FIELDS)),
        F.when(F.schema_of_variant(e).rlike("^(BIGINT|DECIMAL|DOUBLE)"), whole(e, "$")),
    )


def _has_cards(deck: Column) -> Column:
    """A deck without main-deck entries is no deck."""
    return F.coalesce(
        F.exists(first_items(deck, *MAIN_FIELDS), lambda e: _entry_id(e).isNotNull()),
        F.lit(False),
    )


def _first_telling(routed: DataFrame) -> DataFrame:
    """Client messages reduced to their first game state or connect deck, as ``told``."""
    p = F.col("payload")
    client = F.coalesce(
        items(p, "$.greToClientEvent.greToClientMessages"),
        items(p, "$.GreToClientEvent.greToClientMessages"),
    )
    entries = F.transform(
        client,
        lambda m: F.struct(
            F.when(text(m, "$.type") == GAME_STATE, obj(m, "$.gameStateMessage")).alias("state"),
            F.when(text(m, "$.type") == CONNECT, obj(m, "$.connectResp.deckMessage")).alias("deck"),
        ),
    )
    telling = F.filter(
        F.col("__m"), lambda m: m["state"].isNotNull() | _has_cards(m["deck"])
    )
    keep = [c for c in routed.columns if c != "payload"]
    staged = emit(routed, [*keep, "payload"], {"__m": F.when(F.col("kind") == "gre", entries)})
    return emit(staged, [*keep, "payload"], {"told": F.try_element_at(telling, F.lit(1))})


def deck_from_message(routed: DataFrame) -> DataFrame:
    """Messages that submit a deck, with the deck object as ``deck``.

    Places are tried in order and the first that holds a deck with cards counts: a deck
    field, a submit request, a request text with a payload, a course submit, a payload
    text, and the connect answers of a client message before its first game state.
    """
    p = F.col("payload")
    at = [*_where(routed), "kind"]
    kinds = ("payload", "gre", "request", "course_deck", "params", "deck")
    placed = _first_telling(routed.filter(F.col("kind").isin(*kinds))).select(
        *at,
        first_obj(p, "deckPayload", "DeckPayload", "deck", "Deck").alias("d1"),
        first_obj(p, "submitDeckReq.deck", "SubmitDeckReq.deck").alias("d2"),
        strict_json(F.coalesce(text(p, "$.request"), text(p, "$.Request"))).alias("req"),
        first_obj(
            p,
            "CourseDeckSubmit.deck", "CourseDeckSubmit.Deck", "CourseDeckSubmit",
            "courseDeckSubmit.deck", "courseDeckSubmit.Deck", "courseDeckSubmit",
        ).alias("d4"),
        F.when(F.col("kind") == "payload", strict_json(text(p, "$.Payload"))).alias("d5"),
        F.when(F.col("told.state").isNull(), F.col("told.deck")).alias("d6"),
    )
    req = F.col("req")
    opened = emit(
        placed,
        [*at, "d1", "d2", "d4", "d5", "d6"],
        {"d3": F.coalesce(obj(req, "$.Payload"), strict_json(text(req, "$.Payload")))},
    )
    d3 = F.col("d3")
    asked = F.when(
        first_text_of(d3, "deckId", "DeckId").isNotNull()
        | has(d3, "mainDeck")
        | has(d3, "deckCards"),
        d3,
    )
    places = F.array("d1", "d2", asked, "d4", "d5", "d6")
    return emit(
        opened,
        at,
        {"deck": F.try_element_at(F.filter(places, _has_cards), F.lit(1))},
        lambda r: r["deck"].isNotNull(),
    )


def deck_identity(decks: DataFrame) -> DataFrame:
    """Add ``deck_id`` and ``deck_name`` from the aliases of a deck object."""
    d = F.col("deck")
    name = F.coalesce(
        first_text_of(d, *DECK_NAME_FIELDS),
        first_text_of(d, *[f"{s}.{n}" for s in SUMMARY_FIELDS for n in ("name", "Name")]),
        first_text_of(d, "deckInfo.name", "deckInfo.Name"),
        F.lit(UNKNOWN_DECK),
    )
    deck_id = F.coalesce(first_text_of(d, *DECK_ID_FIELDS), F.lit(""))
    return decks.select("*", deck_id.alias("deck_id"), name.alias("deck_name"))


def normalise_deck_list(decks: DataFrame) -> DataFrame:
    """Deck objects -> rows ``(…, board, pos, grp_id, quantity)``.

    Object entries stay rows (quantity 1 when absent or 0, id 0 dropped); bare numbers are
    counted per id at the place of their first occurrence.
    """
    at = _where(decks)
    d = F.col("deck")

    def entries(fields: Sequence[str], board: str) -> Column:
        cards = F.coalesce(first_items(d, *fields), F.array().cast("array<variant>"))
        return F.transform(
            cards,
            lambda e, i: F.struct(
                F.lit(board).alias("board"),
                i.alias("pos"),
                is_object(e).alias("listed"),
                _entry_id(e).alias("grp_id"),
                F.when(
                    is_object(e),
                    F.coalesce(first_whole_of(e, *QUANTITY_FIELDS), F.lit(1)),
                )
                .otherwise(1)
                .cast("bigint")
                .alias("quantity"),
            ),
        )

    rows = decks.select(
        *at, F.inline(F.concat(entries(MAIN_FIELDS, "main"), entries(SIDE_FIELDS, "side")))
    ).filter(F.col("grp_id").isNotNull())
    # Listed entries are their own group; equal bare numbers of a board share one.
    own = F.when(F.col("listed"), F.col("pos")).alias("__own")
    return (
        rows.groupBy(*at, "board", "grp_id", own)
        .agg(F.min("pos").alias("pos"), F.sum("quantity").alias("quantity"))
        .select(*at, "board", "pos", "grp_id", "quantity")
    )


def deck_summaries(routed: DataFrame) -> DataFrame:
    """Every ``(deck_id, deck_name)`` of the summaries, in message order."""
    at = _where(routed)
    s = F.col("s")
    rows = routed.filter(F.col("kind") == "summaries").select(
        *at, F.posexplode(items(F.col("payload"), "$.Summaries")).alias("pos", "s")
    )
    return rows.select(
        *at, "pos", first_text_of(s, "DeckId").alias("deck_id"), first_text_of(s, "Name").alias("deck_name")
    ).filter(F.col("deck_id").isNotNull() & F.col("deck_name").isNotNull())


def latest_summaries(summaries: DataFrame, by: Sequence[str] = ("source_file",)) -> DataFrame:
    """Deck dimension: last name per deck id."""
    order = F.struct(*[c for c in ("line_no", "ord", "pos") if c in summaries.columns])
    return summaries.groupBy(*by, "deck_id").agg(F.max_by("deck_name", order).alias("deck_name"))


def course_decks(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses -> (deck rows, selections).

    A selection needs a known summary name. A course deck with cards gives one row per
    card (main deck only) under its id and name.
    """
    at = _where(routed)
    courses = routed.filter(F.col("kind") == "courses").select(
        *at, F.posexplode(items(F.col("payload"), "$.Courses")).alias("course", "c")
    )
    c = F.col("c")
    selections = courses.select(
        *at,
        "course",
        F.coalesce(text(c, "$.CourseDeckSummary.DeckId"), F.lit("")).alias("deck_id"),
        first_text_of(c, "CourseDeckSummary.Name").alias("deck_name"),
    ).filter(F.col("deck_name").isNotNull() & (F.col("deck_name") != UNKNOWN_DECK))
    e = F.col("e")
    decks = courses.select(
        *at,
        "course",
        F.coalesce(text(c, "$.CourseDeck.DeckId"), F.lit("")).alias("deck_id"),
        F.coalesce(first_text_of(c, "CourseDeck.Name"), F.lit(UNKNOWN_DECK)).alias("deck_name"),
        F.posexplode(items(c, "$.CourseDeck.MainDeck")).alias("pos", "e"),
    ).select(
        *at,
        "course",
        "deck_id",
        "deck_name",
        F.lit("main").alias("board"),
        "pos",
        first_whole_of(e, "CardId", "cardId").alias("grp_id"),
        F.coalesce(first_whole_of(e, "Quantity", "quantity"), F.lit(1)).cast("bigint").alias("quantity"),
    ).filter(F.col("grp_id").isNotNull())
    return decks, selections


# --- inventory and collection ----------------------------------------------------------


def _inventory_block(p: Column) -> Column:
    bare = has(p, "Gems") | has(p, "gems") | has(p, "Gold") | has(p, "gold")
    return F.coalesce(
        obj(p, "$.InventoryInfo"),
        obj(p, "$.inventoryInfo"),
        obj(p, "$.PlayerInventory.InventoryInfo"),
        obj(p, "$.PlayerInventory"),
        obj(p, "$.payload.InventoryInfo"),
        F.when(bare, p),
    )


def inventory_events(routed: DataFrame) -> DataFrame:
    """Inventory snapshots; a missing or non-numeric value is 0, vault is in percent."""
    b = F.col("b")
    rows = emit(
        routed.filter(F.col("kind") == "inventory"),
        _where(routed),
        {"b": _inventory_block(F.col("payload"))},
        lambda r: r["b"].isNotNull(),
    )
    return rows.select(
        *_where(routed),
        *[number(b, *keys).cast("bigint").alias(n) for n, keys in INVENTORY_FIELDS.items()],
        (number(b, "TotalVaultProgress", "vaultProgress") / F.lit(1000.0)).alias("vault_progress"),
    )


def boosters(routed: DataFrame) -> DataFrame:
    """One row per booster entry of an inventory."""
    at = _where(routed)
    blocks = emit(
        routed.filter(F.col("kind") == "inventory"),
        at,
        {"b": _inventory_block(F.col("payload"))},
    )
    rows = blocks.select(
        *at, F.posexplode(first_items(F.col("b"), "Boosters", "boosters")).alias("pos", "x")
    ).filter(is_object(F.col("x")))
    x = F.col("x")
    return rows.select(
        *at,
        "pos",
        number(x, "CollationId", "collationId").cast("bigint").alias("collation_id"),
        number(x, "Count", "count").cast("bigint").alias("count"),
    )


def collection_events(routed: DataFrame) -> DataFrame:
    """Card quantities of a message: id map, id-quantity pairs or objects.

    The first collection field decides, at the top before the payload. Within a message
    the last entry of an id counts.
    """
    at = _where(routed)
    p = F.col("payload")
    field = F.coalesce(
        *[sub(p, f"$.{k}") for k in COLLECTION_FIELDS],
        *[sub(p, f"$.payload.{k}") for k in COLLECTION_FIELDS],
    )
    found = emit(routed.filter(F.col("kind") == "inventory"), at, {"c": field})
    none = F.lit(None).cast("bigint")

    def row(grp_id: Column, quantity: Column) -> Column:
        return F.struct(grp_id.cast("bigint").alias("grp_id"), quantity.cast("bigint").alias("quantity"))

    def map_entry(e: Column) -> Column:
        is_num = F.schema_of_variant(e["value"]).rlike("^(BIGINT|DECIMAL|DOUBLE)")
        return row(parse_int(e["key"]), F.when(is_num, F.try_variant_get(e["value"], "$", "double")))

    def list_entry(e: Column) -> Column:
        pair = items(e, "$")
        grp_id = number(e, "grpId", "GrpId", "id")
        quantity = number(e, "quantity", "Quantity", "count", "Count")
        return (
            F.when(
                F.size(pair) >= 2,
                row(parse_int(text(e, "$[0]")), parse_int(text(e, "$[1]"))),
            )
            .when(
                is_object(e) & (grp_id > 0),
                row(grp_id, F.when(quantity == 0, 1.0).otherwise(quantity)),
            )
            .otherwise(row(none, none))
        )

    as_map = F.transform(
        F.map_entries(F.try_variant_get("c", "$", "map<string,variant>")), map_entry
    )
    as_list = F.transform(items(F.col("c"), "$"), list_entry)
    rows = found.select(*at, F.posexplode(F.coalesce(as_map, as_list)).alias("pos", "x")).filter(
        F.col("x.grp_id").isNotNull() & F.col("x.quantity").isNotNull()
    )
    return rows.groupBy(*at, F.col("x.grp_id").alias("grp_id")).agg(
        F.max_by("x.quantity", "pos").alias("quantity")
    )


# --- matches ---------------------------------------------------------------------------


def local_player(players: Column | str, platform: str = "Mac") -> Column:
    """The only player, else the first on ``platform``, else the one in the highest seat."""
    p = as_col(players)
    seat = lambda x: F.coalesce(x["systemSeatId"], F.lit(0))
    highest = F.array_max(F.transform(p, seat))
    return F.when(F.size(p) == 1, F.try_element_at(p, F.lit(1))).otherwise(
        F.coalesce(
            F.try_element_at(F.filter(p, lambda x: x["platformId"] == platform), F.lit(1)),
            F.try_element_at(F.filter(p, lambda x: seat(x) == highest), F.lit(1)),
        )
    )


def _rooms(routed: DataFrame, state: str) -> DataFrame:
    path = "$.matchGameRoomStateChangedEvent.gameRoomInfo"
    p = F.col("payload")
    # told before the room is copied, as other states are half of the messages
    wanted = (F.col("kind") == "match") & (text(p, f"{path}.stateType") == state)
    return emit(routed.filter(wanted), _where(routed), {"room": obj(p, path)}, lambda r: r["room"].isNotNull())


def match_starts(routed: DataFrame, platform: str = "Mac") -> DataFrame:
    """Match starts with the own and the other player told apart."""
    at = _where(routed)
    r = F.col("room")
    rows = _rooms(routed, PLAYING).select(
        *at,
        obj(r, "$.gameRoomConfig").alias("cfg"),
        F.try_variant_get(r, "$.gameRoomConfig.reservedPlayers", PLAYERS).alias("players"),
    )
    rows = emit(
        rows.filter(F.col("cfg").isNotNull()),
        [*at, "cfg", "players"],
        {"me": local_player("players", platform)},
        lambda r: r["me"].isNotNull(),
    )
    me = F.col("me")
    other = F.coalesce(
        F.try_element_at(
            F.filter("players", lambda x: ~x["userId"].eqNullSafe(me["userId"])), F.lit(1)
        ),
        F.try_element_at("players", F.lit(1)),
    )
    rows = rows.select(*at, "cfg", "me", other.alias("opp"))
    cfg, opp, unknown = F.col("cfg"), F.col("opp"), F.lit("Unknown")
    zero = F.lit(0)
    return rows.select(
        *at,
        F.coalesce(first_text_of(cfg, "matchId"), F.lit("")).alias("match_id"),
        first_text(text(cfg, "$.eventId"), me["eventId"], unknown).alias("event_id"),
        first_text(opp["playerName"], unknown).alias("opponent_name"),
        F.coalesce(opp["platformId"], F.lit("")).alias("opponent_platform"),
        F.coalesce(me["systemSeatId"], zero).alias("seat_id"),
        F.coalesce(me["teamId"], zero).alias("team_id"),
        F.coalesce(first_text_of(cfg, "gameMode"), unknown).alias("game_mode"),
        first_text(me["playerName"], unknown).alias("player_name"),
    )


def match_winner(df: DataFrame, results: str = "results") -> DataFrame:
    """Add ``winning_team_id`` and ``game_count`` of a result list.

    The match result names the winner, else the team with most games (first seen wins
    ties), else the first result; a non-positive number when none tells.
    """
    listed = F.coalesce(col(results), F.array().cast(RESULTS))
    match = F.try_element_at(F.filter(listed, lambda x: x["scope"] == MATCH_SCOPE), F.lit(1))
    games = F.filter(listed, lambda x: x["scope"] == GAME_SCOPE)
    staged = df.select(
        "*",
        F.coalesce(match["winningTeamId"], F.lit(-1)).alias("__declared"),
        F.transform(games, lambda x: F.coalesce(x["winningTeamId"], F.lit(0))).alias("__games"),
        F.try_element_at(listed, F.lit(1))["winningTeamId"].alias("__first"),
    )
    tally = F.transform(
        F.array_distinct(F.filter("__games", lambda t: t > 0)),
        lambda t, i: F.struct(
            F.size(F.filter("__games", lambda w: w == t)).alias("n"),
            (-i).alias("p"),
            t.alias("t"),
        ),
    )
    counted = staged.select("*", F.array_max(tally)["t"].alias("__most"))
    declared = F.col("__declared")
    best = F.when(declared > 0, declared).otherwise(F.coalesce("__most", declared))
    fallback = F.coalesce(F.nullif("__first", F.lit(0)), best)
    return counted.select(
        *[col(c) for c in df.columns],
        F.when(best > 0, best).otherwise(fallback).cast("bigint").alias("winning_team_id"),
        F.greatest(F.size("__games"), F.lit(1)).alias("game_count"),
    )


def match_result(winner: Column, team: Column, reason: Column, results: Column) -> Column:
    """``win`` / ``loss`` / ``draw`` for the own team.

    With a winner: by team (team 2 is taken as the own one when it is unknown). Without
    one, a known player wins by a time-out or disconnect of the other side, and by a
    concession unless only another team has a won result.
    """
    low = F.lower(reason)
    none = F.coalesce(results, F.array().cast(RESULTS))
    ours = F.exists(
        none,
        lambda r: F.coalesce(r["winningTeamId"] == team, F.lit(False))
        | (F.coalesce(F.lower(r["result"]).contains("win"), F.lit(False)) & F.coalesce(r["scope"] == MATCH_SCOPE, F.lit(False))),
    )
    others = F.exists(
        none, lambda r: F.coalesce((r["winningTeamId"] != 0) & (r["winningTeamId"] != team), F.lit(False))
    )
    gone = low.contains("timeout") | low.contains("idle") | low.contains("disconnect") | low.contains("connection")
    conceded = low.contains("concede") | low.contains("concession")
    return (
        F.when(winner > 0, F.when(F.coalesce(team, F.lit(2)) == winner, "win").otherwise("loss"))
        .when(team.isNull(), "draw")
        .when(gone, "win")
        .when(conceded, F.when(ours | ~others, "win").otherwise("loss"))
        .otherwise("draw")
    )


def match_ends(
    routed: DataFrame, starts: DataFrame, platform: str = "Mac", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Match ends with result, winner, reason and game count.

    The own team is that of the last start before the end in the file, unless another end
    came in between; then it is told from the players of the end itself.
    """
    at = _where(routed)
    r = F.col("room")
    rows = _rooms(routed, COMPLETED).select(
        *at,
        F.lit(True).alias("is_end"),
        obj(r, "$.finalMatchResult").alias("fin"),
        text(r, "$.gameRoomConfig.matchId").alias("cfg_match"),
        F.try_variant_get(r, "$.gameRoomConfig.reservedPlayers", PLAYERS).alias("players"),
    ).filter(F.col("fin").isNotNull())
    rows = rows.select("*", local_player("players", platform).alias("me"))
    fin = F.col("fin")
    rows = match_winner(
        rows.select(
            *at,
            "is_end",
            first_text(text(fin, "$.matchId"), F.col("cfg_match"), F.lit("")).alias("match_id"),
            F.try_variant_get(fin, "$.resultList", RESULTS).alias("results"),
            text(fin, "$.matchCompletedReason").alias("completed"),
            F.when(F.col("me").isNotNull(), F.coalesce(F.col("me")["teamId"], F.lit(0))).alias("end_team"),
        )
    )
    known = starts.select(*at, F.lit(False).alias("is_end"), F.col("team_id").alias("start_team"))
    both = rows.unionByName(known, allowMissingColumns=True)
    box = F.when(F.col("is_end"), F.struct(F.lit(None).cast("bigint").alias("t"))).otherwise(
        F.struct(F.col("start_team").alias("t"))
    )
    order = [c for c in at if c != "source_file"]
    # every end and start is a match message: those are counted without reading them
    cut = split_hot(both, ["source_file"], order, hot_rows, sized_by=routed.filter(F.col("kind") == "match"))
    told = running_last(cut.df, ["source_file"], order, {"__last": box}, False, hot_rows, cut).filter("is_end")
    declared = F.try_element_at(
        F.filter("results", lambda x: x["scope"] == MATCH_SCOPE), F.lit(1)
    )
    told = told.select(
        "*",
        F.coalesce(F.col("__last.t"), "end_team").alias("team"),
        first_text(declared["reason"], F.col("completed"), F.lit("Unknown")).alias("reason"),
    )
    return told.select(
        *at,
        "match_id",
        match_result(F.col("winning_team_id"), F.col("team"), F.col("reason"), F.col("results")).alias("result"),
        "winning_team_id",
        "reason",
        "game_count",
    )


# --- game states -----------------------------------------------------------------------


def _state_messages(routed: DataFrame) -> DataFrame:
    """Client messages whose first telling entry is a game state, as ``g``."""
    return (
        _first_telling(routed.filter(F.col("kind") == "gre"))
        .select(*_where(routed), F.col("told.state").alias("g"))
        .filter(F.col("g").isNotNull())
    )


def _zone(zones: Column, zone_type: str, seat: int) -> Column:
    return F.try_element_at(
        F.filter(zones, lambda z: (z["type"] == zone_type) & (z["ownerSeatId"] == seat)), F.lit(1)
    )["objectInstanceIds"]


ZONE_LIST = (
    "array<struct<zoneId bigint, type string, ownerSeatId bigint, objectInstanceIds array<bigint>>>"
)
OBJECT_LIST = "array<struct<instanceId bigint, grpId bigint, zoneId bigint, ownerSeatId bigint>>"
SEAT_LIST = "array<struct<systemSeatNumber bigint, lifeTotal bigint>>"


def game_states(routed: DataFrame, seat: int = 1, other_seat: int = 2) -> DataFrame:
    """Turn, phase, life totals and zone sizes of the tracked seat, one row per message.

    Unreported life is 0 with ``life_reported`` / ``opponent_life_reported`` false.
    """
    at = _where(routed)
    g = F.col("g")
    staged = _state_messages(routed).select(
        *at,
        "g",
        F.try_variant_get(g, "$.players", SEAT_LIST).alias("players"),
        F.try_variant_get(g, "$.zones", ZONE_LIST).alias("zones"),
    )

    def life(number_: int) -> Column:
        told = F.filter(
            "players", lambda x: (x["systemSeatNumber"] == number_) & x["lifeTotal"].isNotNull()
        )
        return F.try_element_at(told, F.lit(-1))["lifeTotal"]

    def size(zone_type: str) -> Column:
        ids = _zone(F.col("zones"), zone_type, seat)
        return F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0))

    return staged.select(
        *at,
        F.coalesce(whole(g, "$.turnInfo.turnNumber"), F.lit(0)).alias("turn"),
        F.coalesce(whole(g, "$.turnInfo.activePlayer"), F.lit(0)).alias("active_player"),
        F.coalesce(whole(g, "$.turnInfo.priorityPlayer"), F.lit(0)).alias("priority_player"),
        first_text(text(g, "$.turnInfo.phase"), F.lit("Unknown")).alias("phase"),
        F.coalesce(life(seat), F.lit(0)).alias("player_life"),
        F.coalesce(life(other_seat), F.lit(0)).alias("opponent_life"),
        life(seat).isNotNull().alias("life_reported"),
        life(other_seat).isNotNull().alias("opponent_life_reported"),
        size("ZoneType_Library").alias("library"),
        size("ZoneType_Hand").alias("hand"),
        size("ZoneType_Graveyard").alias("graveyard"),
    )


def zone_cards(routed: DataFrame, seat: int = 1) -> DataFrame:
    """Cards the tracked seat has in each visible zone, in zone order.

    Instances are looked up among the objects of the same message (last one of an id);
    unknown instances and other owners are dropped. No shuffle.
    """
    at = _where(routed)
    g = F.col("g")
    typed = _state_messages(routed).select(
        *at,
        F.try_variant_get(g, "$.zones", ZONE_LIST).alias("zones"),
        F.filter(
            F.try_variant_get(g, "$.gameObjects", OBJECT_LIST),
            lambda o: (o["ownerSeatId"] == seat) & (o["instanceId"] != 0) & (o["grpId"] != 0),
        ).alias("objects"),
    )
    empty = F.array().cast("array<bigint>")
    per_zone = typed.select(
        *at,
        "objects",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("zone"),
                        F.coalesce(_zone(F.col("zones"), kind, seat), empty).alias("ids"),
                    )
                    for kind, name in ZONES.items()
                ]
            )
        ),
    )
    cards = per_zone.select(*at, "objects", "zone", F.posexplode("ids").alias("pos", "instance_id"))
    card = F.try_element_at(
        F.filter("objects", lambda o: o["instanceId"] == F.col("instance_id")), F.lit(-1)
    )
    return cards.select(*at, "zone", "pos", card["grpId"].alias("grp_id")).filter(
        F.col("grp_id").isNotNull()
    )
