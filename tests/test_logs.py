"""Log files on disk: scan, flow, stream."""

import json

import pytest
from pyspark.sql import functions as F

from cardloom.operators import fold
from cardloom.plans import log_flow
from cardloom.sources import scan
from cardloom.streaming import stream

OLD = "UTC_Log - 03-01-2024 10.00.00.log"
NEW = "UTC_Log - 03-02-2024 09.30.00.log"


def room(state, match, results=None, mine="Mac"):
    cfg = {
        "matchId": match, "eventId": "Ladder", "gameMode": "Std",
        "reservedPlayers": [
            {"userId": "me", "playerName": "Me", "systemSeatId": 1, "teamId": 1, "platformId": mine},
            {"userId": "op", "playerName": "Opp " + match, "systemSeatId": 2, "teamId": 2, "platformId": "Windows"},
        ],
    }
    info = {"stateType": "MatchGameRoomStateType_" + state, "gameRoomConfig": cfg}
    if results is not None:
        info["finalMatchResult"] = {"matchId": match, "matchCompletedReason": "Success", "resultList": results}
    return json.dumps({"matchGameRoomStateChangedEvent": {"gameRoomInfo": info}})


def state(turn, mine, other):
    players = [{"systemSeatNumber": 1, "lifeTotal": mine}, {"systemSeatNumber": 2, "lifeTotal": other}]
    msg = {"type": "GREMessageType_GameStateMessage", "gameStateMessage": {"turnInfo": {"turnNumber": turn}, "players": players}}
    return json.dumps({"greToClientEvent": {"greToClientMessages": [msg]}})


WON = [{"scope": "MatchScope_Match", "winningTeamId": 1, "reason": "Game"}]
LOST = [{"scope": "MatchScope_Match", "winningTeamId": 2, "reason": "ResultReason_Concede"}]
DECK = {"mainDeck": [{"cardId": 5, "quantity": 4}], "DeckId": "d9"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    first = [
        "start", "", '<== Decks {"Summaries":[{"DeckId":"d9","Name":"Summed"}]}',
        "[x]==> " + room("Playing", "m1"), state(3, 20, 7), state(5, 18, 0),
        "<== " + room("MatchCompleted", "m1", WON), "   ",
    ]
    second = [
        '==> SetDeck {', '"deck": {"id":"q","name":"Named"}', "}", "==> " + room("Playing", "m2"),
        json.dumps({"Payload": json.dumps(DECK)}), state(2, 4, 20),
        room("MatchCompleted", "m2", LOST), room("MatchCompleted", "gone", WON),
        '{"InventoryInfo":{"Gems":5,"TotalVaultProgress":450},"cards":{"11":3,"12":1}}',
    ]
    (d / OLD).write_text("\n".join(first))
    (d / NEW).write_text("\r\n".join(second))
    (d / "other.log").write_text("ignored")
    return str(d)


def by_id(matches):
    return {r.id: r for r in matches.collect()}


def test_lines_and_latest(spark, folder):
    lines = scan.read_client_logs(spark, folder)
    rows = lines.orderBy("source_file", "line_no").collect()
    assert [r.line for r in rows if r.source_file == OLD][0] == "start"
    assert sum(r.source_file == OLD for r in rows) == 6
    assert {r.source_file for r in rows} == {OLD, NEW}
    assert scan.latest_log(lines).select("source_file").distinct().collect()[0][0] == NEW


def test_position_grows_over_split_files(spark, tmp_path):
    (tmp_path / OLD).write_text("\n".join(f"line {i}" for i in range(3000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = scan.read_client_logs(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        got = [r.line for r in rows.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == [f"line {i}" for i in range(3000)]


def check_tables(tables):
    m = by_id(tables.matches)
    assert set(m) == {"m1", "m2"}
    one, two = m["m1"], m["m2"]
    assert (one.result, one.win_condition, one.final_turn, one.deck_name) == ("win", "Damage", 5, None)
    assert (two.result, two.win_condition, two.final_turn) == ("loss", "Conceded", 2)
    assert (two.deck_name, two.opponent_name, two.on_play, two.format) == ("Summed", "Opp m2", True, "Std")
    assert str(two.started_at) == "2024-03-02 09:30:00"
    assert {(r.grp_id, r.quantity) for r in tables.collection.collect()} == {(11, 3), (12, 1)}
    assert [(r.gems, r.vault_progress) for r in tables.inventory.collect()] == [(5, 0.45)]


def test_batch_flow(spark, folder):
    check_tables(log_flow.tables_of(scan.read_client_logs(spark, folder)))


def test_stream_equals_batch(spark, folder, tmp_path):
    lines = scan.stream_client_logs(spark, folder, max_files_per_trigger=1)
    q = stream.write_messages(lines, str(tmp_path / "m"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    check_tables(stream.tables_of_stream(spark, str(tmp_path / "m")))


@pytest.fixture(scope="module")
def players(tmp_path_factory):
    """Two players with files of the same names; p1's match ends, and a block closes, in the newer file."""
    d = tmp_path_factory.mktemp("players")
    for p in ("p1", "p2 é"):
        (d / p).mkdir()
    (d / "p1" / OLD).write_text("\n".join(["==> " + room("Playing", "m1", mine="Web"), state(4, 3, 20), "==> Deck {", '"Payload":']))
    (d / "p1" / NEW).write_text("\n".join([json.dumps(json.dumps(DECK)), "}", room("MatchCompleted", "m1", LOST)]))
    (d / "p2 é" / OLD).write_text("==> " + room("Playing", "m1"))
    (d / "p2 é" / NEW).write_text(room("MatchCompleted", "m1", WON) + "\n" + '==> SetDeck {"deck": {"id":"q","name":"Named"}}')
    return str(d)


def check_players(tables):
    m = {r.player_id: r for r in tables.matches.collect()}
    assert set(m) == {"p1", "p2 é"}
    one, two = m["p1"], m["p2 é"]
    assert (one.id, one.win_condition, one.final_turn) == ("m1", "Opponent Conceded", 4)  # team of the start in the older file
    assert (one.result, str(one.started_at)[:10], str(one.ended_at)[:10]) == ("win", "2024-03-01", "2024-03-02")
    assert (two.id, two.result, two.final_turn, two.win_condition) == ("m1", "win", None, "Milled")


def test_one_parser_per_player_over_files(spark, players):
    lines = scan.read_client_logs(spark, players, per_player=True)
    assert {r.player_id for r in lines.select("player_id").distinct().collect()} == {"p1", "p2 é"}
    check_players(log_flow.tables_of(lines))
    check_players(log_flow.tables_of(lines, hot_rows=2))
    messages = log_flow.M.extract_messages(log_flow.parser_lines(lines))
    inside = messages.filter("source_file = 'p1' AND line_no.file = '" + NEW + "'").orderBy("line_no").collect()
    assert [r.line for r in inside][0] == "}"  # the block of the older file


def test_stream_of_players(spark, players, tmp_path):
    lines = scan.stream_client_logs(spark, players, max_files_per_trigger=1, per_player=True)
    q = stream.write_messages(lines, str(tmp_path / "m"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    check_players(stream.tables_of_stream(spark, str(tmp_path / "m")))


def test_streamed_fold_equals_batch(spark, tmp_path):
    rows = [(f"c{i % 5}", i % 7, i) for i in range(60)]
    df = spark.createDataFrame(rows, "player_id string, quantity int, seq bigint").selectExpr(
        "player_id", "seq % 4 AS grp_id", "quantity", "seq", "timestamp_seconds(seq) AS at"
    )
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.fold_stream(events, fold.fold_collection, str(tmp_path / "s"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = stream.read_state(spark, str(tmp_path / "s"), ["player_id", "grp_id"])
    want = fold.fold_collection(df)
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_strict_life_rule(spark):
    states = spark.createDataFrame([("m", 2, 5, 20, 9), ("m", 3, 0, 18, 0)], "match_id string, seq int, turn int, player_life int, opponent_life int")
    m = spark.createDataFrame([("m", 1), ("n", 1)], "match_id string, last_seq int")
    row = lambda strict: sorted(map(tuple, fold.carry_last_state(states, m, strict_reference=strict).collect()))
    assert row(False) == [("m", 5, 18, 0), ("n", 0, 20, 20)]
    assert row(True) == [("m", 5, 18, 9), ("n", 0, 20, 20)]


def test_no_start_no_match(spark):
    starts = spark.createDataFrame([], "match_id string, seq int, event_id string, format string, deck_id string, deck_name string, opponent_name string, started_at timestamp, on_play boolean, opponent_platform string")
    assert fold.fold_matches(starts).filter(F.lit(True)).count() == 0
