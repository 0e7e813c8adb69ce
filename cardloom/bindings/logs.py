"""Log operators over lines that Spark writes from events and orders."""

from pyspark.sql import functions as F

from cardloom.bindings.registry import ORACLES, query, table, view
from cardloom.functions.exprs import emit
from cardloom.functions.variants import text, whole
from cardloom.operators import events as E
from cardloom.operators import messages as M
from cardloom.plans import log_flow
from cardloom.plans.staging import stage

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k"
EV = f"ev AS (SELECT event_id, user_id, event_type, ts, {K} FROM events)"
FILE = "concat('f', CAST(user_id AS STRING)) AS source_file"


def _spread(df):
    """The table is one small file; logs are many, so its rows go to all cores first."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def ev(spark, sf):
    return view(_spread(table(spark, sf, "events")), f"event_id, user_id, event_type, ts, {K}")


def _exploded(df, lines_sql: str):
    """One row per element of the array of lines of an event."""
    rows = df.selectExpr("*", FILE).select(
        "*", F.posexplode(F.expr(lines_sql)).alias("i", "line")
    )
    return rows.select(
        "source_file", (F.col("event_id") * 10 + F.col("i")).alias("line_no"), "line"
    )


def _single(df, json_sql: str):
    """One JSON line per event."""
    placed = df.selectExpr("*", FILE, "event_id * 10 AS line_no")
    return emit(placed, ["source_file", "line_no"], {"line": F.expr(json_sql)})


def _messages(df, json_sql: str):
    return M.extract_messages(_single(df, json_sql))


# --- lines to messages -------------------------------------------------------------------

FORMS = """CASE k % 7
  WHEN 0 THEN array(concat('[x]<== T(1) {"k": ', k, ', "e": ', event_id, '}'))
  WHEN 1 THEN array(concat('note {"k": ', k, ', "e": ', event_id, '} end'))
  WHEN 2 THEN array('==> T {', concat('"k": ', k, ','), concat('"e": ', event_id), '}')
  WHEN 3 THEN array('plain text', 'unclosed { brace')
  WHEN 4 THEN array(concat('==> T {"k": ', k, ','), '{"z":1}', '},', concat('{"k": ', k, ', "e": ', event_id, '}'))
  WHEN 5 THEN array(concat('==> T {"k": ', k, ', "a": [{"b": "}{"}'), concat('], "e": ', event_id, '}'))
  ELSE array('==> T {bad', concat('<== U {"k": ', k, ', "e": ', event_id, '}'), 'x {"q":1}', '}')
END"""
MESSAGES_SQL = f"""WITH {EV} SELECT {FILE}, event_id * 10 + CASE k % 7 WHEN 2 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 1
    WHEN 6 THEN 1 ELSE 0 END AS line_no, k, event_id AS e FROM ev WHERE k % 7 <> 3"""


def _message_rows(messages):
    v = F.col("payload")
    return messages.select(
        "source_file", "line_no", whole(v, "$.k").alias("k"), whole(v, "$.e").alias("e")
    )


@query("extract_messages", MESSAGES_SQL)
def _(spark, sf):
    return _message_rows(M.extract_messages(_exploded(ev(spark, sf), FORMS)))


@query("extract_messages_hot_file", MESSAGES_SQL)
def _(spark, sf):
    """The same with every file above the hot-key limit."""
    return _message_rows(M.extract_messages(_exploded(ev(spark, sf), FORMS), hot_rows=30))


def _over_files(lines):
    """The lines as two files a player, equal in name for all; where possible a block lies over the border."""
    begins = F.when((F.col("line_no") >= 3000) & (F.col("line_no") % 10 > 0), F.col("line_no"))
    border = lines.groupBy("source_file").agg(F.coalesce(F.min(begins), F.lit(4000)).alias("border"))
    newer = F.col("line_no") >= F.col("border")
    name = F.when(newer, "UTC_Log - 03-02-2024 09.30.00.log").otherwise("UTC_Log - 03-01-2024 10.00.00.log")
    split = lines.join(border, "source_file").select(F.col("source_file").alias("player_id"), name.alias("source_file"), "line_no", "line")
    return log_flow.parser_lines(split)


def _own_lines(df):
    """Places back to the numbers of the lines."""
    return df.withColumn("line_no", F.col("line_no.line"))


@query("extract_messages_over_files", MESSAGES_SQL)
def _(spark, sf):
    return _own_lines(_message_rows(M.extract_messages(_over_files(_exploded(ev(spark, sf), FORMS)))))


@query("extract_messages_over_files_hot", MESSAGES_SQL)
def _(spark, sf):
    lines = _over_files(_exploded(ev(spark, sf), FORMS))
    return _own_lines(_message_rows(M.extract_messages(lines, hot_rows=30)))


REPEATED = """CASE k % 3 WHEN 0 THEN concat('{"k": 0, "e": ', event_id, ', "k": ', k, '}')
  WHEN 1 THEN concat('<== T {"e": 1, "k": ', k, ', "e": ', event_id, '}')
  ELSE concat('{"x": {"a": 1, "a": 2}, "k": ', k, ', "e": ', event_id, '}') END"""


@query("extract_messages_repeated_keys", f"WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, k, event_id AS e FROM ev")
def _(spark, sf):
    return _message_rows(_messages(ev(spark, sf), REPEATED))


ROUTED = """CASE k % 10
  WHEN 0 THEN '{"InventoryInfo":{},"Summaries":[]}'
  WHEN 1 THEN '{"matchGameRoomStateChangedEvent":{}}'
  WHEN 2 THEN '{"greToClientEvent":{},"request":{}}'
  WHEN 3 THEN '{"Payload":"x","Summaries":[]}'
  WHEN 4 THEN '{"Courses":[],"request":{}}'
  WHEN 5 THEN '{"CourseDeck":{},"request":"r","params":{}}'
  WHEN 6 THEN '{"params":{},"Payload":5}'
  WHEN 7 THEN '{"Summaries":{}}'
  WHEN 8 THEN '{"DeckSubmit":null,"Request":1}'
  ELSE concat('{"x":', event_id, '}') END"""


@query(
    "route",
    f"""WITH {EV}, r AS (SELECT {FILE}, event_id * 10 AS line_no, CASE k % 10
      WHEN 0 THEN ['inventory'] WHEN 1 THEN ['match'] WHEN 2 THEN ['gre']
      WHEN 3 THEN ['payload', 'summaries'] WHEN 4 THEN ['courses']
      WHEN 5 THEN ['course_deck', 'request', 'params'] WHEN 6 THEN ['params']
      WHEN 8 THEN ['course_deck', 'request'] ELSE [] END AS kinds FROM ev)
    SELECT source_file, line_no, unnest(kinds) AS kind,
      CAST(generate_subscripts(kinds, 1) AS INTEGER) AS ord FROM r""",
)
def _(spark, sf):
    return M.route(_messages(ev(spark, sf), ROUTED)).select("source_file", "line_no", "kind", "ord")


# --- deck names ----------------------------------------------------------------------------

NAME_LINES = """CASE k % 4
  WHEN 0 THEN concat('==> Event_SetDeck {"id":"D', k, '", "NAME": "Deck ', k % 3, '"}')
  WHEN 1 THEN concat('==> DeckSubmitV3 {"x":1, "deckName":"Deck ', k % 2, '"}')
  WHEN 2 THEN concat('<== Join {"courseDeck":{"Name":"Unknown Deck", "name":"Deck ', k, '"}}')
  ELSE concat('<== Other {"name":"Deck ', k, '"}') END"""


@query(
    "deck_name_from_line",
    f"""WITH {EV}, c AS (SELECT {FILE}, event_id * 10 AS line_no,
      CASE WHEN k % 4 = 0 THEN concat('D', k) ELSE '' END AS deck_id,
      concat('Deck ', CASE WHEN k % 4 = 0 THEN k % 3 ELSE k % 2 END) AS deck_name
      FROM ev WHERE k % 4 IN (0, 1)),
    p AS (SELECT *, lag(deck_name) OVER (PARTITION BY source_file ORDER BY line_no) AS prev FROM c)
    SELECT source_file, line_no, deck_id, deck_name FROM p WHERE deck_name IS DISTINCT FROM prev""",
)
def _(spark, sf):
    return M.deck_name_from_line(_messages(ev(spark, sf), NAME_LINES)).drop("ord")


REQUESTS = """CASE k % 6
  WHEN 0 THEN concat('{"request":{"deck":{"Id":"D', k, '","deckName":"R', k, '"}}}')
  WHEN 1 THEN to_json(named_struct('Request', concat('{"DeckPayload":{"name":"S', k, '"},"deckName":"late"}')))
  WHEN 2 THEN concat('{"params":{"DeckName":"P', k, '","Id":"I', k, '"}}')
  WHEN 3 THEN concat('{"CourseDeck":{"DeckId":"C', k, '","Name":"C', k, '","id":"no"}}')
  WHEN 4 THEN '{"request":{"deck":{"name":"Unknown Deck"}},"params":{"deck":5}}'
  ELSE '{"request":"no json"}' END"""


@query(
    "deck_from_request",
    f"""WITH {EV}, n AS (SELECT {FILE}, event_id * 10 AS line_no, k % 6 AS g,
      CASE k % 6 WHEN 0 THEN concat('D', k) WHEN 1 THEN '' WHEN 2 THEN concat('I', k) ELSE concat('C', k) END AS deck_id,
      CASE k % 6 WHEN 0 THEN concat('R', k) WHEN 1 THEN concat('S', k) WHEN 2 THEN concat('P', k)
        ELSE concat('C', k) END AS deck_name,
      CASE WHEN k % 6 = 2 THEN 'direct' ELSE 'nested' END AS origin FROM ev WHERE k % 6 < 4)
    SELECT source_file, line_no, deck_id, deck_name, origin FROM n
    QUALIFY origin = 'nested' OR row_number() OVER (PARTITION BY source_file ORDER BY line_no) = 1""",
)
def _(spark, sf):
    routed = M.route(_messages(ev(spark, sf), REQUESTS))
    return M.deck_from_request(routed).drop("ord")


# --- decks -------------------------------------------------------------------------------

DECK_BODY = """concat('{"mainDeck":[{"cardId":', k, ',"quantity":', event_id % 3, '},7,9,7,{"grpId":0}],
  "sideboardCards":[{"grpId":', k + 1, ',"Quantity":2}],', CASE k % 4 WHEN 0 THEN '"Name":"N'
  WHEN 1 THEN '"name":"","Summary":{"Name":"N' WHEN 2 THEN '"deckInfo":{"name":"N' ELSE '"x":{"y":"' END,
  k, CASE k % 4 WHEN 0 THEN '"' ELSE '"}' END, ',"DeckId":"D', k, '"}')"""
DECK_LINES = f"""CASE k % 5
  WHEN 0 THEN to_json(named_struct('Payload', {DECK_BODY}))
  WHEN 1 THEN concat('{{"greToClientEvent":{{"greToClientMessages":[{{"type":"GREMessageType_ConnectResp",',
    '"connectResp":{{"deckMessage":', {DECK_BODY}, '}}}}]}}}}')
  WHEN 2 THEN concat('{{"greToClientEvent":{{"greToClientMessages":[{{"type":"GREMessageType_GameStateMessage",',
    '"gameStateMessage":{{}}}},{{"type":"GREMessageType_ConnectResp","connectResp":{{"deckMessage":', {DECK_BODY}, '}}}}]}}}}')
  WHEN 3 THEN concat('{{"params":1,"CourseDeckSubmit":{{"Deck":', {DECK_BODY}, '}}}}')
  ELSE to_json(named_struct('request', to_json(named_struct('Payload', {DECK_BODY})))) END"""
HELD = "k % 5 <> 2"


def deck_messages(spark, sf):
    body = DECK_LINES.replace("\n  \"side", "\"side")
    return E.deck_from_message(M.route(_messages(ev(spark, sf), body)))


@query(
    "deck_from_message",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no,
      CASE k % 5 WHEN 0 THEN 'payload' WHEN 1 THEN 'gre' WHEN 3 THEN 'params' ELSE 'request' END AS kind
    FROM ev WHERE {HELD}""",
)
def _(spark, sf):
    return deck_messages(spark, sf).select("source_file", "line_no", "kind")


@query(
    "deck_identity",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, concat('D', k) AS deck_id,
      CASE WHEN k % 4 = 3 THEN 'Unknown Deck' ELSE concat('N', k) END AS deck_name FROM ev WHERE {HELD}""",
)
def _(spark, sf):
    return E.deck_identity(deck_messages(spark, sf)).select(
        "source_file", "line_no", "deck_id", "deck_name"
    )


@query(
    "normalise_deck_list",
    f"""WITH {EV}, d AS (SELECT {FILE}, event_id * 10 AS line_no, event_id, k FROM ev WHERE {HELD})
    SELECT source_file, line_no, 'main' AS board, CAST(0 AS INTEGER) AS pos, k AS grp_id,
      CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END AS quantity FROM d WHERE k > 0
    UNION ALL SELECT source_file, line_no, 'main', 1, 7, 2 FROM d
    UNION ALL SELECT source_file, line_no, 'main', 2, 9, 1 FROM d
    UNION ALL SELECT source_file, line_no, 'side', 0, k + 1, 2 FROM d""",
)
def _(spark, sf):
    return E.normalise_deck_list(deck_messages(spark, sf)).drop("ord")


SUMMARIES = """concat('{"Summaries":[{"DeckId":"D', k % 10, '","Name":"S', k, '"},{"DeckId":"","Name":"q"},{"DeckId":"E', k, '"},{"DeckId":"F","Name":"',
  event_id, '"}]}')"""


@query(
    "deck_summaries",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, CAST(0 AS INTEGER) AS pos, concat('D', k % 10) AS deck_id,
      concat('S', k) AS deck_name FROM ev
    UNION ALL SELECT {FILE}, event_id * 10, 3, 'F', CAST(event_id AS VARCHAR) FROM ev""",
)
def _(spark, sf):
    return E.deck_summaries(M.route(_messages(ev(spark, sf), SUMMARIES))).drop("ord")


@query(
    "latest_summaries",
    f"""WITH {EV}, s AS (SELECT {FILE}, event_id AS o, concat('D', k % 10) AS deck_id, concat('S', k) AS deck_name FROM ev
      UNION ALL SELECT {FILE}, event_id, 'F', CAST(event_id AS VARCHAR) FROM ev)
    SELECT source_file, deck_id, arg_max(deck_name, o) AS deck_name FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return E.latest_summaries(E.deck_summaries(M.route(_messages(ev(spark, sf), SUMMARIES))))


COURSES = """concat('{"Courses":[{"CourseDeckSummary":{"DeckId":"X', k, '","Name":"',
  CASE WHEN k % 3 = 0 THEN 'Unknown Deck' ELSE concat('CS', k) END, '"}},{"CourseDeck":{"DeckId":"Y', k, '",',
  '"MainDeck":[{"CardId":', k, ',"Quantity":3},{"cardId":5},{"CardId":0}]}}]}')"""


@query(
    "course_decks",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, CAST(1 AS INTEGER) AS course, concat('Y', k) AS deck_id,
      'Unknown Deck' AS deck_name, 'main' AS board, CAST(0 AS INTEGER) AS pos, k AS grp_id, CAST(3 AS BIGINT) AS quantity
      FROM ev WHERE k > 0
    UNION ALL SELECT {FILE}, event_id * 10, 1, concat('Y', k), 'Unknown Deck', 'main', 1, 5, 1 FROM ev""",
)
def _(spark, sf):
    return E.course_decks(M.route(_messages(ev(spark, sf), COURSES)))[0].drop("ord")


@query(
    "course_selections",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, CAST(0 AS INTEGER) AS course, concat('X', k) AS deck_id,
      concat('CS', k) AS deck_name FROM ev WHERE k % 3 <> 0""",
)
def _(spark, sf):
    return E.course_decks(M.route(_messages(ev(spark, sf), COURSES)))[1].drop("ord")


# --- inventory and collection --------------------------------------------------------------

BLOCK = """concat('{"Gems":', k, ',"gold":"', event_id, 'abc","WildCardCommons":"x","wcCommons":4,"wcRare":"12.7",',
  '"WildCardMythics":null,"TotalVaultProgress":', k * 7, ',"SealedTokens":true,"Boosters":[{"CollationId":', k,
  ',"Count":"', event_id % 7, '"},5,{"collationId":3}]}')"""
CARDS = """CASE k % 3 WHEN 0 THEN concat('{"', k, '":3,"', k, 'x":4,"n":1,"8":"s"}')
  WHEN 1 THEN concat('[[', k, ',1],[', k, ',"2b"],[1],[900]]')
  ELSE concat('[{"grpId":', k, ',"quantity":0},{"id":901,"Count":5},{"GrpId":-1}]') END"""
INVENTORY = f"""CASE k % 5
  WHEN 0 THEN concat('{{"InventoryInfo":', {BLOCK}, ',"collection":', {CARDS}, '}}')
  WHEN 1 THEN concat('{{"inventoryInfo":', {BLOCK}, ',"payload":{{"Cards":', {CARDS}, '}}}}')
  WHEN 2 THEN concat('{{"PlayerInventory":{{"InventoryInfo":', {BLOCK}, '}},"cardsInInventory":', {CARDS}, '}}')
  WHEN 3 THEN concat('{{"PlayerInventory":', {BLOCK}, ',"Collection":', {CARDS}, '}}')
  ELSE concat('{{"PlayerInventory":5,"payload":{{"InventoryInfo":', {BLOCK}, '}},"CardsInInventory":', {CARDS}, '}}') END"""


def inventory(spark, sf):
    return M.route(_messages(ev(spark, sf), INVENTORY))


@query(
    "inventory_events",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, k AS gems, event_id AS gold, CAST(4 AS BIGINT) AS wc_common,
      CAST(0 AS BIGINT) AS wc_uncommon, CAST(12 AS BIGINT) AS wc_rare, CAST(0 AS BIGINT) AS wc_mythic,
      CAST(0 AS BIGINT) AS draft_tokens, CAST(0 AS BIGINT) AS sealed_tokens,
      CAST(k * 7 AS DOUBLE) / 1000 AS vault_progress FROM ev""",
)
def _(spark, sf):
    return E.inventory_events(inventory(spark, sf)).drop("ord")


@query(
    "boosters",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, CAST(0 AS INTEGER) AS pos, k AS collation_id, event_id % 7 AS count FROM ev
    UNION ALL SELECT {FILE}, event_id * 10, 2, 3, 0 FROM ev""",
)
def _(spark, sf):
    return E.boosters(inventory(spark, sf)).drop("ord")


@query(
    "collection_events",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, k AS grp_id,
      CAST(CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS quantity FROM ev
    UNION ALL SELECT {FILE}, event_id * 10, 901, 5 FROM ev WHERE k % 3 = 2""",
)
def _(spark, sf):
    return E.collection_events(inventory(spark, sf)).drop("ord")


# --- matches -----------------------------------------------------------------------------

PLAYERS = """concat('"reservedPlayers":[{"userId":"u', o_custkey, '","playerName":"c', o_custkey,
  '","systemSeatId":1,"teamId":1,"platformId":"', CASE WHEN o_orderkey % 3 = 0 THEN 'Mac' ELSE 'Web' END,
  '"},{"userId":"o', o_orderkey, '","playerName":"', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('opp', o_orderkey) END,
  '","systemSeatId":2,"teamId":2,"platformId":"Android","eventId":"', o_orderpriority, '"}]')"""
ROOM = '{"matchGameRoomStateChangedEvent":{"gameRoomInfo":{"stateType":"MatchGameRoomStateType_'
START_LINE = f"""concat('{ROOM}Playing","gameRoomConfig":{{"matchId":"m', o_orderkey, '",',
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '"eventId":"Ladder","gameMode":"GM",' END, {PLAYERS}, '}}}}}}}}')"""
# Results by status and key: match winner, game wins, first result, or none.
RESULTS = """CASE
  WHEN o_orderkey % 6 = 0 THEN concat('{"scope":"MatchScope_Match","winningTeamId":', CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END, ',"reason":"Concede"}')
  WHEN o_orderkey % 6 = 1 THEN '{"scope":"MatchScope_Game","winningTeamId":2},{"scope":"MatchScope_Game","winningTeamId":1},{"scope":"MatchScope_Game","winningTeamId":1}'
  WHEN o_orderkey % 6 = 2 THEN '{"scope":"MatchScope_Game","winningTeamId":2},{"scope":"MatchScope_Game","winningTeamId":1}'
  WHEN o_orderkey % 6 = 3 THEN '{"scope":"x","winningTeamId":1},{"scope":"MatchScope_Match"}'
  ELSE '{"scope":"MatchScope_Game","result":"none"}' END"""
END_LINE = f"""concat('{ROOM}MatchCompleted","gameRoomConfig":{{"matchId":"m', o_orderkey, '",', {PLAYERS},
  '}},"finalMatchResult":{{"matchCompletedReason":"', CASE o_orderstatus WHEN 'F' THEN 'Timeout' WHEN 'O' THEN 'Concession' ELSE 'Other' END,
  '","resultList":[', {RESULTS}, ']}}}}}}}}')"""
# Every order has an end; a start line only when its key is no multiple of 5.
ORDER_LINES = f"""CASE WHEN o_orderkey % 5 = 0 THEN array(CAST(NULL AS STRING), {END_LINE})
  ELSE array({START_LINE}, {END_LINE}) END"""
ORDER_FILE = "concat('c', CAST(o_custkey AS STRING)) AS source_file"


def order_lines(spark, sf, file_sql=ORDER_FILE, *extra):
    rows = _spread(table(spark, sf, "orders")).selectExpr(file_sql, *extra, "o_orderkey", f"{ORDER_LINES} AS ls")
    cols = [c for c in rows.columns if c not in ("o_orderkey", "ls")]
    return rows.select(*cols, "o_orderkey", F.posexplode("ls").alias("i", "line")).select(
        *cols, (F.col("o_orderkey") * 2 + F.col("i")).alias("line_no"), "line"
    ).filter(F.col("line").isNotNull())


def order_routed(spark, sf):
    return stage(M.route(M.extract_messages(order_lines(spark, sf))), "routed", "kind")


MAC = "o_orderkey % 3 = 0"
STARTS_SQL = f"""SELECT {ORDER_FILE}, o_orderkey * 2 AS line_no, concat('m', o_orderkey) AS match_id,
    CASE WHEN o_orderkey % 2 = 1 THEN 'Ladder' WHEN {MAC} THEN 'Unknown' ELSE o_orderpriority END AS event_id,
    CASE WHEN NOT ({MAC}) THEN concat('c', o_custkey) WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE concat('opp', o_orderkey) END AS opponent_name,
    CASE WHEN {MAC} THEN 'Android' ELSE 'Web' END AS opponent_platform,
    CAST(CASE WHEN {MAC} THEN 1 ELSE 2 END AS BIGINT) AS seat_id, CAST(CASE WHEN {MAC} THEN 1 ELSE 2 END AS BIGINT) AS team_id,
    CASE WHEN o_orderkey % 2 = 1 THEN 'GM' ELSE 'Unknown' END AS game_mode,
    CASE WHEN {MAC} THEN concat('c', o_custkey) WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE concat('opp', o_orderkey) END AS player_name
  FROM orders WHERE o_orderkey % 5 <> 0"""


@query("match_starts", STARTS_SQL)
def _(spark, sf):
    return E.match_starts(order_routed(spark, sf)).drop("ord")


WINNER = """CASE WHEN o_orderkey % 6 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END WHEN o_orderkey % 6 = 1 THEN 1
  WHEN o_orderkey % 6 = 2 THEN 2 WHEN o_orderkey % 6 = 3 THEN 1 ELSE -1 END"""
COMPLETED = "CASE o_orderstatus WHEN 'F' THEN 'Timeout' WHEN 'O' THEN 'Concession' ELSE 'Other' END"
ENDS_SQL = f"""SELECT {ORDER_FILE}, o_orderkey * 2 + 1 AS line_no, concat('m', o_orderkey) AS match_id,
    CASE WHEN {WINNER} > 0 THEN CASE WHEN {WINNER} = CASE WHEN {MAC} THEN 1 ELSE 2 END THEN 'win' ELSE 'loss' END
      WHEN o_orderstatus = 'F' OR o_orderstatus = 'O' THEN 'win' ELSE 'draw' END AS result,
    CAST({WINNER} AS BIGINT) AS winning_team_id,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Concede' ELSE {COMPLETED} END AS reason,
    CAST(CASE o_orderkey % 6 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS game_count
  FROM orders"""


@query("match_ends", ENDS_SQL)
def _(spark, sf):
    routed = order_routed(spark, sf)
    return E.match_ends(routed, E.match_starts(routed)).drop("ord")


@query(
    "match_winner",
    f"""SELECT o_orderkey AS id, CAST({WINNER} AS BIGINT) AS winning_team_id,
      CAST(CASE o_orderkey % 6 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS game_count FROM orders""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"concat('[', {RESULTS}, ']') AS j")
    listed = rows.select("id", F.from_json("j", E.RESULTS).alias("results"))
    return E.match_winner(listed).select("id", "winning_team_id", "game_count")


@query(
    "local_player",
    f"SELECT o_orderkey AS id, CAST(CASE WHEN {MAC} THEN 1 ELSE 2 END AS BIGINT) AS seat FROM orders",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"concat('{{', {PLAYERS}, '}}') AS j".replace("}}'", "}'").replace("'{{", "'{"))
    players = F.from_json("j", f"reservedPlayers {E.PLAYERS}")["reservedPlayers"]
    return rows.select("id", players.alias("p")).select("id", E.local_player("p")["systemSeatId"].alias("seat"))


# --- game states ---------------------------------------------------------------------------

STATE = """concat('{"greToClientEvent":{"greToClientMessages":[{"type":"GREMessageType_UIMessage"},',
  '{"type":"GREMessageType_GameStateMessage","gameStateMessage":{"turnInfo":{"turnNumber":', k, ',"activePlayer":', k % 2,
  CASE WHEN k % 4 = 0 THEN '' ELSE ',"phase":"Main"' END, '},"players":[{"systemSeatNumber":1', CASE WHEN k % 3 = 0 THEN '' ELSE concat(',"lifeTotal":', k % 21) END,
  '},{"systemSeatNumber":2,"lifeTotal":', k % 5, '}],"zones":[{"type":"ZoneType_Hand","ownerSeatId":2,"objectInstanceIds":[1]},',
  '{"type":"ZoneType_Hand","ownerSeatId":1,"objectInstanceIds":[', event_id, ',', event_id + 1, ',', event_id + 2, ']},',
  '{"type":"ZoneType_Library","ownerSeatId":1,"objectInstanceIds":[1,2', CASE WHEN k % 2 = 0 THEN ',3' ELSE '' END, ']},',
  '{"type":"ZoneType_Exile","ownerSeatId":1,"objectInstanceIds":[', event_id + 3, ']},{"type":"ZoneType_Graveyard","ownerSeatId":1}],',
  '"gameObjects":[{"instanceId":', event_id, ',"grpId":5,"ownerSeatId":1},{"instanceId":', event_id, ',"grpId":', k + 1, ',"ownerSeatId":1},',
  '{"instanceId":', event_id + 1, ',"grpId":8,"ownerSeatId":2},{"instanceId":', event_id + 2, ',"grpId":9,"ownerSeatId":1},',
  '{"instanceId":', event_id + 3, ',"grpId":', k, ',"ownerSeatId":1}]}}]}}')"""


def states(spark, sf):
    return M.route(_messages(ev(spark, sf), STATE))


@query(
    "game_states",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, k AS turn, k % 2 AS active_player, CAST(0 AS BIGINT) AS priority_player,
      CASE WHEN k % 4 = 0 THEN 'Unknown' ELSE 'Main' END AS phase, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 21 END AS player_life,
      k % 5 AS opponent_life, k % 3 <> 0 AS life_reported, TRUE AS opponent_life_reported,
      CAST(CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS library, CAST(3 AS INTEGER) AS hand, CAST(0 AS INTEGER) AS graveyard FROM ev""",
)
def _(spark, sf):
    return E.game_states(states(spark, sf)).drop("ord")


@query(
    "zone_cards",
    f"""WITH {EV} SELECT {FILE}, event_id * 10 AS line_no, 'hand' AS zone, CAST(0 AS INTEGER) AS pos, k + 1 AS grp_id FROM ev WHERE event_id > 0
    UNION ALL SELECT {FILE}, event_id * 10, 'hand', 2, 9 FROM ev
    UNION ALL SELECT {FILE}, event_id * 10, 'exile', 0, k FROM ev WHERE k > 0""",
)
def _(spark, sf):
    return E.zone_cards(states(spark, sf)).drop("ord")


# --- whole flow ----------------------------------------------------------------------------

PLAYER = "concat('p', CAST(o_custkey % 50 AS STRING))"
LOG_FILE = f"concat({PLAYER}, '/UTC_Log - ', {{stamp}}, '.log') AS source_file"
SPARK_STAMP = "date_format(o_orderdate, 'MM-dd-yyyy HH.mm.ss')"
DUCK_STAMP = "strftime(o_orderdate, '%m-%d-%Y %H.%M.%S')"


def player_lines(spark, sf):
    return order_lines(spark, sf, LOG_FILE.format(stamp=SPARK_STAMP), f"{PLAYER} AS player_id")


@query(
    "log_matches",
    f"""WITH s AS ({STARTS_SQL}), e AS ({ENDS_SQL}), o AS (SELECT concat('m', o_orderkey) AS id, {PLAYER} AS player_id,
      o_orderdate FROM orders)
    SELECT o.player_id, s.match_id AS id, s.event_id, s.game_mode AS format, s.opponent_name, s.opponent_platform,
      s.seat_id = 1 AS on_play, e.result, e.game_count, o.o_orderdate AS started_at, o.o_orderdate AS ended_at,
      CASE WHEN e.reason = 'Concede' OR e.reason = 'Concession' THEN CASE WHEN e.result = 'win' THEN 'Opponent Conceded' ELSE 'Conceded' END
        WHEN e.reason = 'Timeout' THEN CASE WHEN e.result = 'win' THEN 'Opponent Timed Out' ELSE 'Timed Out' END
        WHEN e.result = 'draw' THEN 'Unknown' ELSE 'Milled' END AS win_condition
    FROM s JOIN e USING (match_id) JOIN o ON o.id = s.match_id""",
)
def _(spark, sf):
    m = log_flow.tables_of(player_lines(spark, sf)).matches
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")]
    return m.select(
        "player_id", "id", "event_id", "format", "opponent_name", "opponent_platform", "on_play",
        "result", "game_count", *ntz, "win_condition",
    )


# --- the same over two files a player ----------------------------------------------------


@query("deck_name_from_line_over_files", ORACLES["deck_name_from_line"])
def _(spark, sf):
    lines = _over_files(_single(ev(spark, sf), NAME_LINES))
    return _own_lines(M.deck_name_from_line(M.extract_messages(lines))).drop("ord")


@query("deck_from_request_over_files", ORACLES["deck_from_request"])
def _(spark, sf):
    routed = M.route(M.extract_messages(_over_files(_single(ev(spark, sf), REQUESTS))))
    return _own_lines(M.deck_from_request(routed)).drop("ord")


@query("match_ends_over_files", ENDS_SQL)
def _(spark, sf):
    routed = stage(M.route(M.extract_messages(_over_files(order_lines(spark, sf)))), "routed", "kind")
    return _own_lines(E.match_ends(routed, E.match_starts(routed))).drop("ord")
