"""Objects of JSON documents found by many tasks equal those of a whole parse."""

import json
import random

import pytest

from cardloom.sources import scan
from cardloom.sources.json_elements import json_elements

NASTY = ["", "}", "{", '"', '\\"}', "\\", "[{", "a\nb", "é}", '{"x": "}"}', "\\\\", '\\\\"{']


def value(r, deep=0):
    kind = r.randrange(5 if deep < 3 else 3)
    if kind < 2:
        return "".join(r.choices(NASTY, k=r.randrange(4)))
    if kind == 2:
        return r.choice([None, 1, 2.5, True, []])
    if kind == 3:
        return [value(r, deep + 1) for _ in range(r.randrange(3))]
    return {r.choice(NASTY) + str(i): value(r, deep + 1) for i in range(r.randrange(3))}


def split_small(spark, size):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    return held


@pytest.mark.parametrize("depth,hot", [(1, 10_000), (1, 40), (2, 10_000), (3, 40)])
def test_elements_of_any_depth(spark, tmp_path, depth, hot):
    r = random.Random(depth)
    docs = [[{"a": value(r), "b": {"c": value(r), "d}": {"e{": value(r)}}} for _ in range(150)], {"z": {"y": {"x": 1}}}]
    (tmp_path / "a.json").write_text(json.dumps(docs[0], ensure_ascii=False, indent=1) + "\n" + json.dumps(docs[1]))

    def objects(v, level, key):
        if isinstance(v, dict):
            if level + 1 == depth:
                yield key, v
            else:
                for k, x in v.items():
                    yield from objects(x, level + 1, k)
        elif isinstance(v, list):
            for x in v:
                yield from objects(x, level, None)

    want = [o for d in docs for o in objects(d, 0, None)]
    held = split_small(spark, 3000)
    try:
        found = json_elements(spark, str(tmp_path), depth, hot)
        got = found.orderBy("input_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [(g.key, json.loads(g.text)) for g in got] == want


def test_cards_equal_the_whole_parse_in_many_tasks(spark, tmp_path):
    r = random.Random(1)
    cards = [
        {"id": f"c{i}", "name": r.choice(NASTY), "prices": {"usd": "1"}, "colors": r.choice([None, [], ["W", "}"]]), "extra": {"q": {"w": "}"}},
         "card_faces": [{"name": r.choice(NASTY), "image_uris": {"normal": "u"}}] * (i % 3)}
        for i in range(800)
    ]
    path = str(tmp_path / "bulk.json")
    for indent in (None, 2):
        with open(path, "w") as f:
            json.dump(cards, f, indent=indent)
        held = split_small(spark, 20_000)
        try:
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 3
            got = scan.read_cards_bulk(spark, path).orderBy("input_pos").drop("input_pos").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        assert got == spark.read.schema(scan.CARD_SCHEMA).json(path, multiLine=True).collect()


def test_empty_and_flat_documents(spark, tmp_path):
    for i, text in enumerate(("", "[]", "[1, \"}\", null]", "{}")):
        (tmp_path / f"{i}.json").write_text(text)
        assert [r.text for r in json_elements(spark, str(tmp_path / f"{i}.json")).collect()] == (["{}"] if text == "{}" else [])
