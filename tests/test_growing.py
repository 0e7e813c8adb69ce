"""Growing logs as a stream: lines, messages."""

import os

import pytest
from pyspark.sql import functions as F

from cardloom.operators import messages as M
from cardloom.sources import growing
from cardloom.streaming.blocks import PIECE_ROWS, stream_messages

A = "UTC_Log - 03-01-2024 10.00.00.log"
B = "UTC_Log - 03-02-2024 09.30.00.log"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """State is kept per partition; two are enough here."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


class Lines:
    """A query over growing logs that is started anew for every look at the folder."""

    def __init__(self, spark, tmp_path, shape=lambda df: df, **options):
        self.spark, self.shape, self.options = spark, shape, options
        self.root, self.out, self.check = (str(tmp_path / n) for n in ("logs", "out", "check"))
        os.makedirs(self.root)

    def write(self, name, text, player=None, mode="ab"):
        folder = os.path.join(self.root, player) if player else self.root
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), mode) as f:
            f.write(text.encode() if isinstance(text, str) else text)

    def look(self):
        lines = growing.stream_growing_logs(self.spark, self.root, **self.options)
        writer = self.shape(lines).writeStream.format("parquet").option("checkpointLocation", self.check)
        q = writer.option("path", self.out).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None
        return self

    def rows(self, *columns):
        if not os.path.isdir(self.out):
            return []
        return sorted(map(tuple, self.spark.read.parquet(self.out).select(*columns).collect()))


def test_each_line_once_over_growth_truncation_and_rotation(spark, tmp_path):
    log = Lines(spark, tmp_path, startingOffsets="earliest")
    log.write(A, "a1\na2\n\npart")
    log.write(B, "x1\n", player="p2")
    log.look()
    assert log.rows("player_id", "line") == [("local", "a1"), ("local", "a2"), ("p2", "x1")]
    log.write(A, "ial\r\na4 é")
    log.look()
    log.write(A, "\n", mode="ab")
    log.write("other.txt", "no\n")
    log.look()
    log.look()  # nothing new
    want = [("local", "a1"), ("local", "a2"), ("local", "a4 é"), ("local", "partial\r"), ("p2", "x1")]
    assert log.rows("player_id", "line") == want
    log.write(A, "b1\nb2", mode="wb")  # cut and begun anew
    log.look()
    log.write(A, " end")
    log.write(B, "c1\nc2\n")  # rotation: the last line of the old file counts as well
    log.look()
    log.write(B, "c3\n")
    log.look()
    want += [("local", x) for x in ("b1", "b2 end", "c1", "c2", "c3")]
    assert log.rows("player_id", "line") == sorted(want)
    assert {(s, r) for s, _, r in log.rows("source_file", "line", "reset") if r} == {(A, True)}
    assert [x for x, r in log.rows("line", "reset") if r] == ["b1"]


def test_start_at_the_end_and_changed_head(spark, tmp_path):
    log = Lines(spark, tmp_path)
    old = "h" * growing.HEAD_BYTES + "\nold\n"
    log.write(A, old)
    reader = growing.GrowingLogReader({"path": log.root})
    start = reader.initialOffset()
    assert reader.partitions(start, reader.latestOffset()) == []
    log.write(A, "new\n")
    assert [(r.start, r.reset) for r in reader.partitions(start, reader.latestOffset())] == [(len(old), False)]
    log.write(A, "g" * 200 + "\n", mode="wb")
    assert [(r.start, r.end, r.reset) for r in reader.partitions(start, reader.latestOffset())] == [(0, 201, True)]
    assert growing.GrowingLogReader({"path": log.root, "startingOffsets": "earliest"}).initialOffset() == {}
    shards = [growing.GrowingLogReader({"path": log.root, "shard": f"{i}/3"}).latestOffset() for i in range(3)]
    assert sum(map(len, shards)) == 1
    for wrong in ({"shard": "3/3"}, {"startingOffsets": "x"}):
        with pytest.raises(ValueError):
            growing.GrowingLogReader({"path": log.root, **wrong})


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 10_000])
def test_ranges_of_any_size_give_each_line_once(tmp_path, split):
    lines = ["", "a", "bb", "é" * 9, "", "c" * 40, " ", "dd"]
    path = tmp_path / A
    path.write_bytes("\n".join(lines).encode() + b"\n")
    reader = growing.GrowingLogReader({"path": str(tmp_path), "splitBytes": str(split)})
    got = [row for r in reader.partitions({}, reader.latestOffset()) for b in reader.read(r) for row in b.to_pylist()]
    whole = path.read_bytes()
    assert [r["line"] for r in got] == [x for x in lines if x.strip()]
    assert all(whole[r["line_no"] :].decode().startswith(r["line"] + "\n") for r in got)


CUT = [
    "text", '[x]<== T(1) {"k": 1}', '==> T {', '"k": 2,', '<== U {"k": 3}', '"e": "}"', "}", 'say {"k": 4} end', "==> T {bad", 'x {"q":1}', "}",
    '==> V {"k": 5,', '{"z":1}', "},", '{"k": 6}', "==> W {no}", '{"k": 7}', "},", '{"k": 8, "a": "\\"}"}', '==> X {"k": 9',
]


def test_a_block_cut_at_every_place_equals_the_batch(spark, tmp_path):
    """Player i has the first i lines in the first batch and the rest in the second."""
    log = Lines(spark, tmp_path, stream_messages, startingOffsets="earliest")
    for i in range(len(CUT) + 1):
        log.write(A, "".join(x + "\n" for x in CUT[:i]), player=f"p{i:02}")
    log.look()
    for i in range(len(CUT) + 1):
        log.write(A, "".join(x + "\n" for x in CUT[i:]), player=f"p{i:02}")
    log.look()
    places = [sum(len(x) + 1 for x in CUT[:i]) for i in range(len(CUT))]
    df = spark.createDataFrame([(A, p, x) for p, x in zip(places, CUT)], "source_file string, line_no bigint, line string")
    shown = ["line_no", "line", F.to_json("payload").alias("payload")]
    want = sorted(map(tuple, M.extract_messages(df).select(*shown).collect()))
    assert len(want) == 6
    for i in range(len(CUT) + 1):
        got = [r[1:] for r in log.rows("player_id", *shown) if r[0] == f"p{i:02}"]
        assert got == want, i


def test_many_messages_of_a_key_come_whole(spark, tmp_path):
    """More than one table of messages leaves Python; blocks lie over the borders."""
    log = Lines(spark, tmp_path, stream_messages, startingOffsets="earliest")
    n = 2 * PIECE_ROWS + 7
    log.write(A, "".join(f'{{"k": {i}}}\n==> T {{\n"k": {i + 1}}}\n' for i in range(0, n, 2)))
    log.look()
    got = log.rows("line_no", F.expr("try_variant_get(payload, '$.k', 'int')"))
    assert [k for _, k in got] == list(range(n + 1))


def test_places_grow_when_a_file_is_read_anew(spark, tmp_path):
    log = Lines(spark, tmp_path, stream_messages, startingOffsets="earliest")
    log.write(A, '{"k": 1}\n==> T {\n"k":\n')
    log.look()
    log.write(A, "2}\n", mode="wb")  # the block goes on in the new text
    log.look()
    log.write(A, '{"k": 3}\n')
    log.look()
    got = log.rows("line_no", F.expr("try_variant_get(payload, '$.k', 'int')"))
    assert [k for _, k in got] == [1, 2, 3]


@pytest.mark.parametrize("together", [True, False])
def test_one_parser_follows_the_files_of_a_player(spark, tmp_path, together):
    """The block begins in the old file and ends in the new one, in one look or in two."""
    log = Lines(spark, tmp_path, lambda df: stream_messages(df, ("player_id",)), startingOffsets="earliest")
    log.write(A, '{"k": 1}\n==> T {\n"k":')
    if not together:
        log.look()
    log.write(B, '2}\n{"k": 3}\n', player=None)
    log.write(A, '{"k": 9}\n', player="other")
    log.look()
    log.write(B, '{"k": 4}\n')
    log.look()
    got = log.rows("player_id", "line_no", F.expr("try_variant_get(payload, '$.k', 'int')"))
    assert [k for p, _, k in got if p == "local"] == [1, 2, 3, 4]
    assert [k for p, _, k in got if p == "other"] == [9]
