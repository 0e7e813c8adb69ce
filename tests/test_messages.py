"""Message extraction and deck-name tracking against a line-by-line walk."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardloom.operators import messages as M

PIECES = [
    '<== A(1) {"k":%d}', '[x]==> B {', '==> C {"a":{', '"a":%d,', '"n":[1,2]', '}', '},', '{"k":%d}',
    'text {"k":%d} text', '{"k":%d} {"j":1}', 'plain', 'has { only', '==> D {"s":"}{\\"", "k":%d',
    '"e":{"f":"}"}}', '} tail', '  }  ', '==> E {bad} ', '{"a":1}] [x {"b":%d}', '<== F no brace', '{"x":[1,{"y":%d}]}',
]


def parsed(text):
    try:
        return json.loads(text, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return None


def walk(lines):
    """Messages of one file as (line, value): an open block takes lines until it parses."""
    block = None
    for no, line in lines:
        if ("<==" in line or "==>" in line) and "{" in line:
            rest = line[line.index("{"):]
            value = parsed(rest)
            if value is None:
                block = rest
            else:
                yield no, value
        elif block is not None:
            block += "\n" + line
            value = parsed(block)
            if value is not None:
                yield no, value
            if value is not None or line.strip() in ("}", "},"):
                block = None
        elif "{" in line and "}" in line:
            value = parsed(line[line.index("{"): line.rindex("}") + 1])
            if value is not None:
                yield no, value


def random_logs(seed, files=8, size=60):
    rnd = random.Random(seed)
    out = []
    for f in range(files):
        for no in range(size):
            piece = rnd.choice(PIECES)
            out.append((f"f{f}", no * 3, piece % no if "%d" in piece else piece))
    return out


@pytest.mark.parametrize("hot_rows", [2_000_000, 7])
def test_messages_equal_walk(spark, hot_rows):
    rows = random_logs(1) + random_logs(2, files=1, size=200)[:0]
    df = spark.createDataFrame(rows, "source_file string, line_no bigint, line string").repartition(5)
    got = M.extract_messages(df, hot_rows).selectExpr(
        "source_file", "line_no", "to_json(payload) AS j"
    ).collect()
    want = set()
    for f in {r[0] for r in rows}:
        for no, value in walk(sorted((n, t) for x, n, t in rows if x == f)):
            want.add((f, no, json.dumps(value, sort_keys=True)))
    assert {(r.source_file, r.line_no, json.dumps(json.loads(r.j), sort_keys=True)) for r in got} == want
    assert len(got) == len(want)


def test_known_names_stop_repeats_and_direct_names(spark):
    lines = [
        (0, '==> SetDeck {"name":"A","id":"1"}'),
        (1, '==> X {"params":{"deckName":"B"}}'),
        (2, '==> SetDeck {"name":"A"}'),
        (3, '==> SetDeck {"name":"C"}'),
    ]
    df = spark.createDataFrame([("f", n, t) for n, t in lines], "source_file string, line_no bigint, line string")
    m = M.extract_messages(df)
    own = M.deck_name_from_line(m)
    assert [(r.line_no, r.deck_name, r.deck_id) for r in own.orderBy("line_no").collect()] == [
        (0, "A", "1"), (3, "C", ""),
    ]
    names = own.selectExpr("source_file", "line_no", "cast(ord AS double) AS ord", "deck_name")
    assert M.deck_from_request(M.route(m), names).count() == 0
    assert M.deck_from_request(M.route(m)).count() == 1


def test_lines_of_a_stream_batch_are_put_in_order_in_bounded_memory(monkeypatch):
    """With a limit that is always passed the lines are sorted over spilled runs."""
    from cardloom.streaming import blocks

    monkeypatch.setattr(blocks, "SORT_MB", 1)
    names = ["UTC_Log - 03-02-2024 09.30.00.log", "UTC_Log - 12-01-2023 10.00.00.log"]
    lines = [(names[i % 2], (i * 7919) % 30_011, f"line {i} " + "x" * 200, False) for i in range(20_000)]
    got = blocks.in_order(iter(lines))
    assert iter(got) is got and list(got) == sorted(lines, key=lambda r: (blocks.name_order(r[0]), r[1]))


class Held:
    """State of one key, and the handle that gives it."""

    value = None

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_messages_of_a_stream_batch_leave_in_tables_of_bounded_size():
    """Many messages of a key, and few long ones: all come in order, and no table holds them all."""
    from cardloom.streaming import blocks

    many = [f'{{"k": {i}}}' for i in range(2 * blocks.PIECE_ROWS + 5)]
    long = [f'{{"k": "{i}{"x" * (blocks.PIECE_CHARS // 4)}"}}' for i in range(5)]
    for texts, sizes in ((many, [blocks.PIECE_ROWS, blocks.PIECE_ROWS, 5]), (long, [2, 2, 1])):
        held = Held()
        processor = blocks.OpenBlocks(("player_id",))
        processor.init(held)
        rows = [("UTC_Log - 03-02-2024 09.30.00.log", i, x, False) for i, x in enumerate(texts)]
        tables = (pd.DataFrame(rows[i : i + 3000], columns=["source_file", "line_no", "line", "reset"]) for i in range(0, len(rows), 3000))
        found = []
        for table in processor.handleInputRows((None,), tables, None):
            assert list(table.columns) == ["player_id", "line_no", "line", "text"]
            found.append(table)
        assert [len(t) for t in found] == sizes and held.value[4] == len(texts) - 1
        whole = pd.concat(found)
        assert whole["line_no"].tolist() == list(range(len(texts))) and whole["text"].tolist() == texts
        assert whole["player_id"].isna().all()


def test_a_line_of_a_stream_without_a_place_is_an_error():
    from cardloom.streaming import blocks

    table = pd.DataFrame({"source_file": ["f", "f"], "line_no": [1, None], "line": ["{}", "{}"], "reset": [False, None]})
    with pytest.raises((TypeError, ValueError)):
        list(blocks.lines_of(iter([table])))


def test_staged_variants_are_written_whole(spark):
    """A value cut into typed columns would be put together again at every read."""
    import pyarrow.parquet as pq

    from cardloom.plans import staging

    held = spark.conf.get(staging.SHREDDING)
    rows = spark.range(50).selectExpr("id", "parse_json(concat('{\"a\":', id, ',\"b\":{\"c\":\"x\"}}')) AS v")
    back = staging.stage(rows, "whole")
    for file in back.inputFiles():
        assert "typed_value" not in str(pq.ParquetFile(file.removeprefix("file://")).schema)
    assert spark.conf.get(staging.SHREDDING) == held
    assert sorted(r[0] for r in back.selectExpr("variant_get(v, '$.a', 'int')").collect()) == list(range(50))


def test_a_key_counts_with_any_value(spark):
    from cardloom.functions.variants import has

    values = ["{}", "[]", "null", "0", '"x"', '{"b": 1}']
    df = spark.createDataFrame([(f'{{"k": {v}}}',) for v in values] + [('{"j": 1}',), ("[1]",), ("3",)], "j string").selectExpr("parse_json(j) AS v")
    got = [r[0] for r in df.select(has(F.col("v"), "k")).collect()]
    assert got == [True] * len(values) + [False] * 3
