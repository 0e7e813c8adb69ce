"""The chunked operators must equal a plain single-task scan, hot key or not."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import ordered as O

HOT = [3, 10_000]


def rows(seed=7, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        seq = i if rnd.random() < 0.8 else i + 1000
        out.append((key, seq, rnd.choice([None, 1, 2, 3]), rnd.random() < 0.4, i))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "k string, seq bigint, v int, f boolean, i bigint").repartition(5)


def by_key(keyed=True):
    groups = {}
    for r in sorted(rows(), key=lambda r: (r[1], r[4])):
        groups.setdefault(r[0] if keyed else 0, []).append(r)
    return groups


@pytest.mark.parametrize("hot", HOT)
@pytest.mark.parametrize("keyed", [True, False])
def test_running_last_and_previous(table, hot, keyed):
    keys = ["k"] if keyed else []
    inc = O.running_last(table, keys, ["seq", "i"], {"x": F.col("v")}, True, hot)
    exc = O.running_last(table, keys, ["seq", "i"], {"x": F.col("v")}, False, hot)
    prv = O.previous(table, keys, ["seq", "i"], {"x": F.col("v")}, hot)
    want_inc, want_exc, want_prv = {}, {}, {}
    for g in by_key(keyed).values():
        last, before = None, None
        for r in g:
            want_exc[r[4]], want_prv[r[4]] = last, before
            last = r[2] if r[2] is not None else last
            want_inc[r[4]], before = last, r[2]
    for got, want in ((inc, want_inc), (exc, want_exc), (prv, want_prv)):
        assert {r.i: r.x for r in got.collect()} == want


@pytest.mark.parametrize("hot", HOT)
@pytest.mark.parametrize("keyed", [True, False])
def test_positions_sums_and_rolling(table, hot, keyed):
    keys = ["k"] if keyed else []
    pos = O.row_positions(table, keys, ["seq", "i"], "p", "n", hot)
    tot = O.running_sum(table, keys, ["seq", "i"], {"s": F.col("v")}, hot)
    rol = O.rolling_count(table, keys, ["seq", "i"], F.col("f"), 7, "c", "p", hot)
    want_pos, want_sum, want_rol = {}, {}, {}
    for g in by_key(keyed).values():
        s = 0
        for p, r in enumerate(g):
            s += r[2] or 0
            want_pos[r[4]] = (p + 1, len(g))
            want_sum[r[4]] = s
            want_rol[r[4]] = (sum(x[3] for x in g[max(0, p - 6): p + 1]), p + 1)
    assert {r.i: (r.p, r.n) for r in pos.collect()} == want_pos
    assert {r.i: r.s for r in tot.collect()} == want_sum
    assert {r.i: (r.c, r.p) for r in rol.collect()} == want_rol


def test_timestamp_order(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-03-30 23:00:00' + make_dt_interval(0, id) AS t, id, id % 3 AS v FROM range(60)"
    )
    out = O.previous(df, [], ["t", "id"], {"x": F.col("v")}, 5)
    assert {r.id: r.x for r in out.collect()} == {i: (None if i == 0 else (i - 1) % 3) for i in range(60)}


def sizes(chunked):
    return {(r[0], r[1]): r[2] for r in chunked.df.groupBy("k", "__chunk").count().collect()}


CLUSTERED = {
    "one shared value": lambda i: (5, i),
    "one far-off value": lambda i: (2**60 if i == 7 else i % 3, i),
    "one without a value": lambda i: (None if i == 7 else i, i),
    "mostly without a value": lambda i: (i if i % 9 == 0 else None, i),
    "two far files": lambda i: ((i % 2) * 2**41 + i, 0),
}


@pytest.mark.parametrize("case", CLUSTERED)
def test_chunks_of_clustered_values_are_even(spark, case):
    data = [("hot", *CLUSTERED[case](i), i) for i in range(6000)] + [("cold", i, i, i) for i in range(50)]
    df = spark.createDataFrame(data, "k string, a bigint, b bigint, i bigint").repartition(6)
    c = O.split_hot(df, ["k"], ["a", "b"], 300)
    found = sizes(c)
    assert max(found.values()) <= 600
    assert sum(n for (k, _), n in found.items() if k == "hot") == 6000 and found[("cold", 0)] == 50
    pos = O.row_positions(df, ["k"], ["a", "b"], "p", "n", 300).filter("k = 'hot'").collect()
    order = sorted(data[:6000], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert {r.i: r.p for r in pos} == {r[3]: n for n, r in enumerate(order, 1)}


def test_order_columns_of_other_types(spark):
    data = [("k", f"{i % 11:02}", float(i % 7) if i % 5 else float("nan"), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, s string, d double, i bigint").withColumn("t", F.timestamp_seconds("i"))
    df = df.withColumn("st", F.struct("s", "t")).repartition(4)
    for order in (["s", "d", "i"], ["st", "i"], ["t"]):
        plain, cut = (O.row_positions(df, ["k"], order, "p", None, h).select("i", "p") for h in (10_000, 20))
        assert sorted(plain.collect()) == sorted(cut.collect())


@pytest.mark.parametrize("held", [O.BROADCAST_ROWS, 10])
def test_a_key_of_many_chunks_is_cut_in_levels(spark, monkeypatch, held):
    """Rows are compared with the cuts of their own group only, and tables of many entries are not broadcast."""
    monkeypatch.setattr(O, "BROADCAST_ROWS", held)
    monkeypatch.setattr(O, "FAN", 4)
    n, hot_rows = 3000, 20
    df = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.pmod(F.col("id") * 7919, F.lit(n)).alias("seq"),
        F.col("id").alias("i"),
    ).repartition(3)
    c = O.split_hot(df, ["k"], ["seq"], hot_rows)
    chunks = [r for r in c.df.groupBy("k", "__hot", "__chunk").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect()]
    hot = sorted((r["__chunk"], r.n, r.a, r.b) for r in chunks if r.k == "hot")
    assert all(r["__hot"] == (sum(x.n for x in chunks if x.k == r.k) > hot_rows) for r in chunks)
    assert len(hot) >= 80 and max(x[1] for x in hot) <= 4 * hot_rows
    assert all(left[3] < right[2] for left, right in zip(hot, hot[1:]))
    got = O.row_positions(df, ["k"], ["seq"], "p", "n", hot_rows).collect()
    by_k = {}
    for r in sorted(got, key=lambda r: r.seq):
        by_k[r.k] = by_k.get(r.k, 0) + 1
        assert r.p == by_k[r.k]
    assert all(r.n == by_k[r.k] for r in got)
