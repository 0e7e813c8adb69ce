"""Sessions on a stream equal those of the table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cardloom.plans.sessions import COLUMNS, EVENTS, sessions
from cardloom.streaming.sessions import HELD, Sessions, stream_sessions


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """State is kept per partition; two are enough here."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def history(players=6, steps=60, seed=3):
    """Events of some players, mostly one to sixty seconds apart, at times much later."""
    r = random.Random(seed)
    rows = []
    for p in range(players):
        at, match = 0, 0
        for seq in range(steps):
            at += r.choice((0, 1, 5, 20, 60, 60, 400))
            kind = r.choice(("match_start", "match_end", "deck", "deck", "name", "summary", "state", "state"))
            match += kind == "match_start"
            facts = {
                "match_start": {"match_id": f"m{p}-{match}" if r.random() < 0.9 else None, "team": r.choice((1, 2, None))},
                "match_end": {"match_id": f"m{p}-{match}"},
                "deck": {"deck_id": r.choice(("d1", "d2", "", None)), "deck_name": r.choice((None, "", "Unknown Deck", "Own"))},
                "name": {"deck_name": r.choice(("Chosen", "Unknown Deck", None))},
                "summary": {"deck_id": r.choice(("d1", "d2")), "deck_name": f"List {seq}"},
                "state": {"turn": r.choice((None, 0, 3, seq)), "player_life": r.choice((None, 0, 9)), "opponent_life": r.choice((None, 4))},
            }[kind]
            rows.append((f"p{p}", at, seq, kind, *[facts.get(c) for c in COLUMNS[4:]]))
    return rows


def table(spark, rows):
    raw = spark.createDataFrame(rows, EVENTS.replace("at timestamp", "at bigint"))
    return raw.withColumn("at", F.timestamp_seconds("at"))


def shuffled(rows, delay, seed=1):
    """Batches in which no event comes more than ``delay`` after a later one."""
    r = random.Random(seed)
    placed = sorted(rows, key=lambda x: x[1] + r.random() * delay)
    size = len(rows) // 3 + 1
    return [placed[i : i + size] for i in range(0, len(placed), size)]


def stream(spark, tmp_path, batches, restart, **options):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = table(spark, []).schema
    for i, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.mode("append").parquet(source)
        if not restart and i < len(batches) - 1:
            continue
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = (
            stream_sessions(events, **options).writeStream.format("parquet").option("checkpointLocation", check)
            .option("path", out).trigger(availableNow=True).start()
        )
        assert q.awaitTermination(300)
        assert q.exception() is None
    return spark.read.parquet(out)


@pytest.mark.parametrize("timeout,names", [(None, None), (90, 150)])
def test_stream_of_late_events_equals_the_table(spark, tmp_path, timeout, names):
    rows = history()
    end = max(r[1] for r in rows)
    far = ("zz", end + 100_000, 0, "name", *[None] * 7)  # moves the watermark past all others
    later = ("zz", end + 100_001, 0, "name", *[None] * 7)
    options = {"timeout_seconds": timeout, "name_seconds": names}
    got = stream(spark, tmp_path, [*shuffled(rows, 100), [far], [later]], timeout is not None, delay="100 seconds", **options)
    got = got.filter("player_id <> 'zz'")
    until = None if timeout is None else str(table(spark, [far]).select(F.col("at") - F.expr("INTERVAL 100 SECONDS")).head()[0])
    want = sessions(table(spark, rows), timeout_seconds=timeout, until=until, name_seconds=names)
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    if timeout:
        assert want.filter("kind = 'match_timeout'").count() > 5


def test_summary_before_and_after_its_deck(spark):
    row = lambda at, kind, d, n: ("p", at, at, kind, None, None, d, n, None, None, None)
    rows = [row(1, "deck", "d", None), row(2, "summary", "d", "A"), row(3, "deck", "d", "Unknown Deck"), row(50, "deck", "d", None)]
    told = lambda **o: [r.deck_name for r in sessions(table(spark, rows), **o).filter("kind = 'deck'").orderBy("at").collect()]
    assert told() == [None, "A", "A"]
    assert told(name_seconds=10) == [None, "A", None]


def test_hot_player_equals_the_plain_window(spark):
    rows = history(players=2, steps=120)
    plain, cut = (sessions(table(spark, rows), timeout_seconds=90, name_seconds=150, hot_rows=h) for h in (1000, 10))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    assert sessions(table(spark, [])).collect() == []


class Calls:
    """A state handle that counts its messages; ``texts`` are those of the only list."""

    def __init__(self):
        self.count, self.texts, self.wakes = 0, [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, ms):  # noqa: N802
        self.count, self.wakes = self.count + 1, [*self.wakes, ms]

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.upto

    def appendValue(self, value):  # noqa: N802
        self.count, self.texts = self.count + 1, [*self.texts, value]

    def put(self, values):
        self.count, self.texts = self.count + 1, list(values)

    def get(self):
        self.count += 1
        return iter(self.texts)


@pytest.mark.parametrize("names", [None, 10_000])
def test_calls_of_the_state_do_not_grow_with_events(names):
    kinds = ("summary", "deck", "match_start", "state", "match_end")
    event = lambda i: {"us": i * 1_000_000, "seq": i, "kind": kinds[i % 5], "deck_id": f"d{i // 5 % 7}"}
    events = [event(i) | ({"deck_name": f"n{i}"} if i % 5 == 0 else {}) for i in range(2 * HELD + 500)]
    told = []
    for share in (5, 1):
        calls, rows = Calls(), []
        own = Sessions(None, names and names * 1_000_000)
        own.init(calls)
        here = events[:: -1 if share == 1 else 1][: len(events) // share]
        own.handleInputRows(("p",), iter([("p", None, e["us"], json.dumps(e)) for e in here]), calls)
        calls.upto = (len(events) - 100) * 1000
        for _ in range(3):  # three timers of one batch
            rows += [r for out in own.handleExpiredTimer(("p",), calls, None) for r in json.loads(out.rows)]
        assert all(len(json.loads(text)) <= HELD for _, text in calls.texts)
        told.append(calls.count - len(calls.wakes))
        assert len(calls.wakes) <= 2 + 7  # an event, the rest, and each name that expires
        due = sorted(e["seq"] for e in here if e["us"] <= calls.upto * 1000)
        assert [r["seq"] for r in rows] == due
        assert all(r["deck_name"] == f"n{r['seq'] - 1}" for r in rows if r["kind"] == "deck")
    assert max(told) <= 8


def test_long_batches_of_a_player_and_one_state_row_each(spark, tmp_path):
    rows = [(p, at + 1, *r) for p, at, *r in history(players=2, steps=HELD + 200)]  # time 0 is behind the first watermark
    end = max(r[1] for r in rows)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    placed = sorted(rows, key=lambda r: (r[1] % 7, r[0]))
    for batch in (placed, [("zz", end + 100_000, 0, "name", *[None] * 7)]):
        table(spark, batch).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(table(spark, []).schema).parquet(source)
        q = (
            stream_sessions(events, delay="10 days").writeStream.format("parquet").option("checkpointLocation", check)
            .option("path", out).trigger(availableNow=True).start()
        )
        assert q.awaitTermination(300)
        assert q.exception() is None
    table(spark, [("zz", end + 10_000_000, 1, "name", *[None] * 7)]).coalesce(1).write.mode("append").parquet(source)
    q = stream_sessions(events, delay="10 days").writeStream.format("parquet").option("checkpointLocation", check)
    q = q.option("path", out).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    got, want = spark.read.parquet(out).filter("player_id <> 'zz'"), sessions(table(spark, rows))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
