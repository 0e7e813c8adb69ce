"""Hard negatives, clustering and the piece codec against plain versions."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.llm import piece_codec as C
from cardloom.llm import pivot_clusters as V
from cardloom.llm import shared_lists as S

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dims=6, copies=0, seed=5):
    r = random.Random(seed)
    rows = [(i, [r.choice((-1, 0, 1)) * round(r.random(), 2) + i % 4 / 4 for _ in range(dims)], r.randrange(4)) for i in range(n)]
    return rows + [(n + i, rows[3][1], rows[3][2] + i % 2) for i in range(copies)]


def odd_vectors(dims=6):
    ok = [0.5] * dims
    return [
        (None, ok, 1), (100, ok, 1), (100, ok, 1), (7, ok, None), (8, None, 1), (9, [None] * dims, 1), (10, [float("nan")] * dims, 2),
        (11, [float("inf")] + ok[1:], 2), (12, [], 2), (13, ok[1:], 2), (14, ok + [9.0], 3), (-100, [-x for x in ok], 1), (15, [0.0] * dims, 0),
    ]


def plain_negatives(rows, scale=256, top=5, many=10):
    kept = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, j, _ in [s for s in scored if s[2] == label][:top]:
            fits = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:many]
            out += [(i, j, rank, k, p, n) for rank, (n, k, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def negatives(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("score", F.lit("x")).withColumn("__key", F.lit(1))
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return S.hard_negatives(df, F.col("vec_id") % 100 == 0, label=label, **more)


@pytest.mark.parametrize("group", [1, 3, 20_000])
def test_hard_negatives_are_those_of_all_scores(spark, group):
    rows = vectors(450, copies=60) + odd_vectors()
    got = negatives(spark, rows, group_anchors=group).collect()
    assert sorted(map(tuple, got), key=str) == plain_negatives(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert negatives(spark, vectors(0)).collect() == []
    assert negatives(spark, vectors(450)[1:99]).collect() == []  # no anchor
    assert negatives(spark, [(0, None, 1), (100, [1.0], None)]).collect() == []
    alone = [(0, [1.0], 1), (1, [0.5], 2)]
    assert negatives(spark, alone).collect() == plain_negatives(alone) == []
    with pytest.raises(Exception, match="64 bits"):
        negatives(spark, [(0, [1e15], 1), (1, [1e15], 2)]).collect()


def test_walks_stop_early_and_lose_nothing():
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 16)) * 100
    v = (np.repeat(centres, 400, axis=0) + r.normal(size=(2400, 16)) * 6).astype(np.int64)
    label = np.repeat(np.arange(6), 400)
    keys = np.arange(2400)
    block = S.Block(v, keys, np.zeros(2400, bool), label, keys)
    pick = np.arange(0, 2400, 40)
    anchors = S.Anchors(S.Block(v[pick], pick, np.zeros(60, bool), label[pick], pick), members=4)
    wanted = S.Wanted(np.arange(60), np.full(60, S._LEAST), np.full(60, S._GREATEST), 5, True)
    found = S.Found(wanted)
    scored = S.walk(anchors, block, wanted, found, step=32)
    assert scored < 60 * 2400 / 3
    product = v[pick] @ v.T
    product[np.arange(60), pick] = -(10**12)
    product[label[pick][:, None] != label[None, :]] = -(10**12)
    assert (found.score == -np.sort(-product, axis=1)[:, :5]).all()


def plain_clusters(rows, dims, k, rounds, scale=1024):
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v, _ in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    code = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for i, v in sorted(kept, key=lambda r: (code(r[0]), r[1]))[:k]]

    def assigned():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assigned()
    own = [sum(d for d, c in near if c == n) for n in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, own[c], sum(own), sha[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


@pytest.mark.parametrize("k,rounds,pivots", [(8, 10, 8), (3, 2, 1), (600, 1, 4)])
def test_clusters_are_those_of_all_distances(spark, k, rounds, pivots):
    rows = vectors(300, copies=50) + odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("cluster", F.lit("x")).withColumn("__v", F.lit(1))
    got = V.cluster(df, dims=6, k=k, rounds=rounds, pivots=pivots).drop("centroid").collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, 6, k, rounds)


def test_clusters_of_odd_tables(spark):
    assert V.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert V.cluster(spark.createDataFrame(odd_vectors(), VECTORS), dims=9).collect() == []
    with pytest.raises(Exception, match="beyond"):
        V.cluster(spark.createDataFrame([(1, [1e9], 1)], VECTORS), dims=1).collect()


def test_pivots_leave_out_centroids():
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (8, 32))
    v = np.repeat(centres, 100, axis=0) + r.integers(-30, 30, (800, 32))
    pivots = V.choose_pivots(v, 8)
    cluster, dist, exact = V.assign(v, V.roots(v, pivots), centres, pivots)
    full = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert exact < 800 * 8 / 4


@pytest.fixture(scope="module")
def own():
    return C.Codec(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


def library_ids(own, text):
    return own.library.encode(text, add_bos=True, add_eos=True)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


PARTS = ["<s>", "</s>", "<unk>", "<0x41>", "é", "é", "12345", " ", "  ", " ", "\n\t", "中文", "🙂", "ß", "...", "ab" * 40, "\x00", "▁", "the", "ation", "t", "he", "༺"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=12), max_size=30).map("".join))
def test_ids_are_the_library_s(own, text):
    text = text.encode("utf-8", "ignore").decode()
    want = library_ids(own, text)
    assert own.by_words
    try:
        assert ids(own.encode(text)) == want
        own.by_words = False  # the search over the whole text
        assert ids(own.encode(text)) == want
    finally:
        own.by_words = True
    assert own.decode(own.encode(text)) == own.library.decode(want)


def test_ids_of_long_texts(own):
    for text in ("a" * 300_000, "abcdefgh" * 20_000, " " * 50_000, "word " * 100_000, "中🙂" * 30_000):
        assert ids(own.encode(text)) == library_ids(own, text)


def test_failed_places_are_left(own):
    """Texts whose longest pieces must be taken back."""
    r = random.Random(4)
    taken_back = 0
    for _ in range(300):
        word = "".join(r.choices("etaoinshr", k=30))
        path, at = [], 0
        longest = {}
        for end, i in own.automaton.iter(word):
            longest[end + 1 - own.size[i]] = i
        while at < len(word):
            path.append(longest[at])
            at += own.size[path[-1]]
        got = own.search(word)
        taken_back += got != path
        assert [own.piece[i] for i in got] == own.merged(word)
    assert taken_back > 30


def test_codec_rows(spark, own):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    rows = [(1, None), (2, ""), (2, "two words"), (None, "x " * 3000), (2, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("__text", F.lit(1))
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], ids(r["ids"]), r["decoded"]) for r in C.encode(df, path).collect()))
    want = sorted((i or -1, len(library_ids(own, t or "")), library_ids(own, t or ""), own.library.decode(library_ids(own, t or ""))) for i, t in rows)
    assert got == want
    assert C.encode(df.limit(0), path).collect() == []
    assert C.encode(df, path, decoded=False).columns == ["doc_id", "n_tokens", "ids"]
