"""Folds that rewrite touched buckets equal the folds of all events."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import fold
from cardloom.streaming import refold

MATCHES = (
    "match_id string, kind string, seq bigint, event_id string, format string, deck_id string, deck_name string, opponent_name string, "
    "opponent_platform string, started_at timestamp, on_play boolean, result string, game_count int, ended_at timestamp, win_condition string, final_turn int"
)


def match_events(spark, n=400, seed=2):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    rows = [
        (
            f"m{r.randrange(30)}", pick("start", "start", "end", "name"), i, f"e{i}", "f", pick(None, "d1", "d2"), pick(None, "", "Unknown Deck", "A", "B"),
            f"o{i % 5}", pick(None, "", "Mac"), None, pick(True, False), pick("win", "loss"), i % 3, None, pick(None, "Damage"), i % 9,
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, MATCHES)
    return df.withColumn("started_at", F.timestamp_seconds("seq")).withColumn("ended_at", F.timestamp_seconds(F.col("seq") + 1))


def card_events(spark, n=600):
    rows = [(f"c{i % 5}", i % 7, i % 11, i) for i in range(n)]
    df = spark.createDataFrame(rows, "player_id string, grp_id int, quantity int, seq bigint")
    return df.withColumn("at", F.timestamp_seconds("seq"))


def deck_events(spark, n=200):
    rows = [(f"d{i % 9}", f"name {i}", i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, name string, seq bigint").withColumn("created_at", F.timestamp_seconds("seq"))


def whole_matches(e):
    m = fold.apply_match_end(fold.fold_matches(e.filter("kind = 'start'")), e.filter("kind = 'end'"))
    return fold.fill_deck_name(m, e.filter("kind = 'name'"))


CASES = {
    "matches": (match_events, refold.match_fold(), whole_matches),
    "collection": (card_events, refold.collection_fold(), fold.fold_collection),
    "decks": (deck_events, refold.deck_fold(), fold.fold_decks),
}


def same(got, want):
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", CASES)
def test_batches_in_any_order_equal_the_whole_fold(spark, tmp_path, name):
    events, one, whole = CASES[name]
    df = events(spark).cache()
    for i in range(4):
        part = df.filter(F.pmod(F.hash("seq"), F.lit(4)) == i)
        refold.refold_batch(part, i, one, str(tmp_path / "s"), buckets=5)
    same(refold.read_folded(spark, one, str(tmp_path / "s"), df.schema), whole(df))
    empty = refold.read_folded(spark, one, str(tmp_path / "none"), df.schema)
    assert empty.collect() == []
    assert refold.refold_batch(df.limit(0), 9, one, str(tmp_path / "s"), buckets=5) == 0


def files(folder):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names)


def test_files_stay_level_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    one, folder = refold.collection_fold(), str(tmp_path / "s")
    df = card_events(spark).cache()
    read, held = [], []
    for i in range(20):
        part = df.filter(F.col("seq") % 20 == i)
        read.append(refold.refold_batch(part, i, one, folder, buckets=4))
        held.append(files(folder))
    assert max(read) <= 4
    assert max(held) == max(held[:5]) <= 4 * refold.KEPT  # no more than in the first batches
    before = refold.read_folded(spark, one, folder, df.schema).collect()
    again = df.filter(F.col("seq") % 20 == 19)
    assert refold.refold_batch(again, 19, one, folder, buckets=4) == read[-1]
    assert sorted(before) == sorted(refold.read_folded(spark, one, folder, df.schema).collect())
    assert files(folder) == held[-1]
    same(refold.read_folded(spark, one, folder, df.schema), fold.fold_collection(df))


def test_only_touched_buckets_are_written(spark, tmp_path):
    one, folder = refold.deck_fold(), str(tmp_path / "s")
    df = deck_events(spark).cache()
    refold.refold_batch(df, 0, one, folder, buckets=6)
    assert refold.refold_batch(df.filter("id = 'd3'"), 1, one, folder, buckets=6) == 1
    assert files(os.path.join(folder, "data", "version=1")) == 1


def test_stream_of_files(spark, tmp_path):
    one, folder = refold.collection_fold(), str(tmp_path / "s")
    df = card_events(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refold.refold_stream(events, one, folder, str(tmp_path / "c"), buckets=4)
    assert q.awaitTermination(120)
    assert q.exception() is None
    same(refold.read_folded(spark, one, folder, df.schema), fold.fold_collection(df))
