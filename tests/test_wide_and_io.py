"""Headers, wide scans and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cardloom.functions import cards as C
from cardloom.operators import catalogue as K
from cardloom.operators import deck as D
from cardloom.operators import idmap as I
from cardloom.operators import stats
from cardloom.operators import wide as W
from cardloom.sources import scan, sinks

HEADER = ["expansion", "won", "num_turns", "deck_Elf, Big", "deck_deck_x.y", "sideboard_Elf, Big", "sideboard_deck_x.y"]


@pytest.mark.parametrize(
    "name,kind",
    [
        ("user_n_games_bucket", "smallint"), ("user_game_win_rate_bucket", "float"), ("pack_card_Elf", "tinyint"),
        ("opening_hand", "string"), ("opening_hand_Elf", "tinyint"), ("on_play", "boolean"), ("candidate_hand_3", "string"),
        ("user_turn_12_cards_drawn", "string"), ("oppo_turn_2_cards_drawn", "tinyint"), ("oppo_turn_2_cards_tutored", "tinyint"),
        ("user_turn_1_oppo_mana_spent", "float"), ("oppo_turn_3_eot_user_life", "float"), ("user_turn_3_eot_user_cards_in_hand", "string"),
        ("user_turn_3_eot_oppo_cards_in_hand", "float"), ("user_total_mana_spent", "smallint"), ("oppo_total_cards_drawn_or_tutored", "tinyint"),
        ("user_turn_4_creatures_blitzed", "tinyint"), ("pick", "string"), ("drawn_pick", "tinyint"),
    ],
)
def test_type_rules(name, kind):
    schema, unmatched = W.schema_for_header([name])
    assert schema[0].dataType.simpleString() == kind and not unmatched


def test_unmatched_and_classes(spark):
    assert W.schema_for_header(["strange", "rank"])[1] == ["strange"]
    game = {r.column: (r.category, r.card) for r in W.classify_game_columns(spark, HEADER).collect()}
    assert game["deck_deck_x.y"] == ("deck", "deck_x.y") and game["won"] == ("meta", None)
    replay = W.classify_replay_columns(spark, ["user_turn_12_lands_played", "deck_A", "rank"]).collect()
    assert [(r.category, r.player, r.turn, r.field) for r in replay][0] == ("turn", "user", 12, "lands_played")


def test_check_columns(spark):
    assert W.check_columns(spark, HEADER).count() == 0
    bad = W.check_columns(spark, [*HEADER, "deck_Only", "won"]).collect()
    assert {(r.problem, r.column) for r in bad} == {
        ("duplicate column", "won"), ("card missing in position", "sideboard_Only"),
    }
    clash = W.check_columns(spark, ["a_turn_1_x", "a_turn_01_x"], "replay").collect()
    assert clash[0].problem == "duplicate key"


def test_wide_scan_melt_pivot(spark, tmp_path):
    name = "game_data_public.LTR.Sealed.csv.gz"
    lines = ['expansion,won,num_turns,"deck_Elf, Big",deck_deck_x.y,"sideboard_Elf, Big",sideboard_deck_x.y',
             "LTR,True,3,1,0,0,2", "LTR,False,4,0,0,0,0", "LTR,True,5,0,3,0,0"]
    with gzip.open(tmp_path / name, "wt") as f:
        f.write("\n".join(lines) + "\n")
    logs = scan.read_wide_logs(spark, str(tmp_path), "LTR", "Sealed", "game")
    assert W.row_count(logs).head().n == 3 and dict(logs.dtypes)["won"] == "boolean"
    meta = W.game_columns(HEADER)
    long = W.melt_cards(logs, meta, ["game_id"])
    assert sorted((r.position, r.card_name, r.n) for r in long.collect()) == [
        ("deck", "Elf, Big", 1), ("deck", "deck_x.y", 3), ("sideboard", "deck_x.y", 2),
    ]
    assert W.pivot_cards(long, meta, ["game_id"]).count() == 2
    path = str(tmp_path / "out")
    assert sinks.write_processed(logs, path) and not sinks.write_processed(logs, path)
    assert sinks.write_processed(logs, path, refresh=True)
    assert scan.read_processed(spark, path).count() == 3
    with gzip.open(tmp_path / "game_data_public.X.Sealed.csv.gz", "wt") as f:
        f.write("a,a\n1,2\n")
    with pytest.raises(ValueError):
        scan.read_wide_logs(spark, str(tmp_path), "X", "Sealed", "game")


def test_turn_features_and_unknown_meta(spark):
    df = spark.createDataFrame([(1, "True", "3.0", "7", None)], "g int, won string, user_turn_1_a string, oppo_turn_2_a string, user_turn_1_b string")
    meta = W.replay_columns(df.columns)
    assert tuple(W.turn_features(df, meta, ["a"], ["g"]).first()) == (1, 1, 3, 7)
    with pytest.raises(ValueError):
        W.select_meta(df, ["nope"])


def test_bulk_json_and_printings(spark, tmp_path):
    face = {"name": "F", "image_uris": {"normal": "", "png": "face.png"}}
    cards = [
        {"id": "1", "lang": "en", "name": "A", "set": "ltr", "set_name": "L", "prices": {"usd": "1.5", "usd_foil": "x"}, "card_faces": [{"name": "E"}, face], "arena_id": 9},
        {"id": "2", "lang": "en", "digital": True, "set": "ltr"}, {"id": "3", "lang": "de", "set": "ltr"},
        {"id": "4", "lang": "en", "set": "ltr", "set_name": "Other", "colors": ["W", "U"]},
    ]
    (tmp_path / "c.json").write_text(json.dumps(cards))
    kept = K.paper_english(scan.read_cards_bulk(spark, str(tmp_path / "c.json")))
    flat = {r.id: r for r in K.flatten_card(kept).collect()}
    assert set(flat) == {"1", "4"}
    assert (flat["1"].price_best, flat["1"].price_usd_foil, flat["1"].image_url) == (1.5, None, "face.png")
    assert (flat["1"].colors, flat["4"].colors) == ("", "W,U")
    assert [tuple(r) for r in K.sets_from_cards(kept).collect()] == [("ltr", "L", None)]
    assert [(r.card_id, r.face_index) for r in K.card_faces(kept).collect()] == [("1", 0), ("1", 1)]
    doc = {"data": {"AAA": {"cards": [{"name": "P", "identifiers": {"mtgArenaId": "9"}}, {"identifiers": {}}]},
                    "BBB": {"cards": [{"name": "Q", "identifiers": {"mtgArenaId": "9"}}, {"name": "R", "identifiers": {"mtgArenaId": "x"}}]}}}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    m = I.printings_mapping(scan.read_printings(spark, str(tmp_path / "p.json")))
    assert [(r.grp_id, r.name, r.setCode) for r in m.collect()] == [(9, "P", "AAA")]
    merged, counts = I.merge_backfill(m, I.bulk_mapping(kept))
    assert merged.count() == 1 and tuple(counts.first()) == (0, 0)
    again, _ = I.merge_backfill(merged, I.bulk_mapping(kept))
    assert again.exceptAll(merged).count() == 0
    with pytest.raises(ValueError):
        K.require_rows(flat_none := kept.filter(F.lit(False))) and flat_none


def test_export_and_catalogue_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1, 'De"ck', "Opp, x", "Ladder", "win", 2, True)], "id int, deck_name string, opponent_name string, format string, result string, game_count int, on_play boolean").withColumn("started_at", F.to_timestamp(F.lit("2024-01-02 03:04:05"))).withColumn("event_id", F.lit("E"))
    sinks.export_matches_csv(m, str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("part-*.csv") for x in p.read_text().splitlines()]
    assert '"2024-01-02 03:04:05","De""ck","Opp, x","Standard","WIN","2","Yes"' in lines
    with pytest.raises(ValueError):
        sinks.export_matches_json(m.filter("id > 1"), str(tmp_path / "json"))


def test_deck_text_boards_and_errors(spark):
    text = "4 Elf (LTR) 12\n// note\n2 elf\nbad line\n\n1 Orc 7\n"
    cards, errors = D.parse_deck_lists(spark.createDataFrame([("d", text)], "deck_id string, text string"))
    assert sorted((r.board, r.name, r.quantity) for r in cards.collect()) == [("main", "Elf", 6), ("side", "Orc", 1)]
    assert [r.error for r in errors.collect()] == ["Could not parse: bad line"]


def test_hand_may_go_negative(spark):
    deck = spark.createDataFrame([("d", "A", 2, [1, 2]), ("d", "B", 3, [3])], "deck_id string, name string, quantity bigint, grp_ids array<bigint>")
    seen = spark.createDataFrame([("d", 1, "hand")] * 2 + [("d", 2, "hand"), ("d", 3, "exile"), ("d", 9, "hand"), ("d", 1, "graveyard")], "deck_id string, grp_id bigint, zone string")
    assert {r.name: (r.in_hand, r.remaining) for r in D.remaining_cards(deck, seen).collect()} == {"A": (3, -1), "B": (0, 2)}


def test_small_expressions(spark):
    row = spark.range(1).select(
        C.normalise_mana(F.lit("o2oUoU")).alias("m"), C.decode_colours(F.lit("1, ,6")).alias("c"),
        C.split_type_line(F.lit("A — B — C")).alias("t"), C.value_hint(F.lit(0.0)).alias("v"),
    ).first()
    assert (row.m, row.c, tuple(row.t), row.v) == ("{2}{U}{U}", ["W", "6"], ("A", "B — C"), None)


def test_rolling_needs_two_points(spark):
    from datetime import datetime

    def at(n):
        return spark.range(n).selectExpr("id", "timestamp_seconds(1700000000 + id) AS started_at", "'win' AS result")

    now = datetime(2023, 11, 20)
    assert stats.rolling_win_rate(at(7), now).count() == 0
    assert [r.win_rate for r in stats.rolling_win_rate(at(8), now, hot_rows=3).collect()] == [100.0, 100.0]


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_numbers_of_any_length_sort_by_value(spark, hot_rows):
    from cardloom.functions.exprs import natural_sort_key
    from cardloom.operators.catalogue import index_page

    want = [
        "-2" + "0" * 21, "-1" + "0" * 21, "-7", "5", "17", "17a", "17b2", "17b10", str(2**62 - 1), str(2**62), str(2**62 + 1), "9" * 18 + "99",
        "2" + "0" * 20, "1" + "0" * 21, "1" + "0" * 21 + "a", "A-2", "A-12", "A-2" + "0" * 20, "A-1" + "0" * 21, "b",
    ]
    df = spark.createDataFrame([(i, "s", x) for i, x in enumerate(want)], "id long, setCode string, collectorNumber string").repartition(5)
    got = index_page(df, hot_rows=hot_rows).orderBy("position").collect()
    assert [r["collectorNumber"] for r in got] == want
    assert [r["collectorNumber"] for r in df.orderBy(natural_sort_key("collectorNumber")).collect()] == want


@pytest.fixture
def many_lines(spark, tmp_path, monkeypatch):
    """A folder of 400 order lines and their parts, of which a task shall group about 20."""
    from cardloom.bindings import registry

    monkeypatch.setattr(registry, "ROWS_PER_TASK", 20)
    lines = spark.range(400).selectExpr(
        "CAST(id DIV 4 AS BIGINT) AS l_orderkey", "id % 30 AS l_partkey", "id % 7 AS l_suppkey", "CAST(1 + id % 7 AS INT) AS l_linenumber",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "substring('ANR', CAST(1 + id % 3 AS INT), 1) AS l_returnflag", "substring('FO', CAST(1 + id % 2 AS INT), 1) AS l_linestatus",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.range(30).selectExpr("id AS p_partkey", "concat('n', id % 9) AS p_name", "CAST(id AS INT) AS p_size", "'T' AS p_type", "'b' AS p_brand")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name,key", [("pivot_cards", "game_id"), ("turn_features", "game_id"), ("deck_by_type", "deck_id"), ("consolidate_deck", "deck_id")])
def test_a_task_groups_a_bounded_number_of_rows(spark, many_lines, name, key):
    from cardloom.bindings import QUERIES

    rows = QUERIES[name](spark, many_lines)
    per_task = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct(key).alias("n")).collect()]
    assert sum(per_task) == rows.select(key).distinct().count() > 90
    assert rows.rdd.getNumPartitions() == 20 and max(per_task) < 20


def test_changed_rows_are_counted_on_both_sides(spark, many_lines, monkeypatch):
    from cardloom.bindings import QUERIES, wide

    count = lambda: QUERIES["melt_pivot_identity"](spark, many_lines).head().changed_rows
    assert count() == 0
    whole = W.pivot_cards
    monkeypatch.setattr(wide.Wd, "pivot_cards", lambda *a: whole(*a).filter("game_id % 10 <> 0").withColumn("deck_A F", F.when(F.col("game_id") == 1, 99).otherwise(F.col("`deck_A F`"))))
    missing = sum(1 for r in whole(W.melt_cards(wide.game_logs(spark, many_lines), wide.game_meta(), ["game_id"]), wide.game_meta(), ["game_id"]).collect() if r.game_id % 10 == 0)
    assert count() == missing + 2
