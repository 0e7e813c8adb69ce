"""Near duplicates, decontamination and mixing against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm import bag_minhash as B
from cardloom.llm import cgk_decontam as C
from cardloom.llm import source_mix as M
from cardloom.llm.shared import word_batches

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def multiset(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum(min(n, b[k]) for k, n in a.items())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def corpus(seed):
    """Unrelated texts, exact copies, and chains of ever more edited copies."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(3, 150))) for _ in range(60)]
    for base in texts[:12]:
        texts += [base] * r.randint(0, 3)
        now = base.split()
        for _ in range(r.randint(0, 8)):
            now = list(now)
            now[r.randrange(len(now))] = r.choice(vocabulary)
            texts.append(" ".join(now))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_all_pairs(spark, seed):
    texts = corpus(seed)
    got = {r["id"]: r["class_id"] for r in B.near_duplicates(docs_of(spark, texts)).collect()}
    sets = [multiset(t) for t in texts]
    want = list(range(len(texts)))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                want[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}


def test_signatures_estimate_the_weighted_overlap():
    r = random.Random(3)
    a = [r.choice("abcdefgh") for _ in range(300)]
    b = a[:200] + [r.choice("stuvwxyz") for _ in range(60)]
    texts = [" ".join(a), " ".join(b)]
    _, hashes, counts = next(word_batches(texts))
    out, owner, weight = B.counted(*B.shingles(hashes, counts, 1))
    assert weight.max() > 10
    sig = B.signatures(out, owner, weight, 2, 8192)
    want = jaccard(Counter(a), Counter(b))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.02


def test_near_duplicates_edge_cases(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!!", "en", "a", 3), (4, "one two", "en", "a", 7),
        (4, "one two", "en", "a", 7), (None, "one two", "en", "a", 7), (5, "one", "en", "a", 3), (None, "x y z", "en", "a", 5),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")).withColumn("id", F.lit(9))
    got = B.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["class_digest"]].add((r["id"], r["class_id"]))
    assert sorted(map(sorted, (((x[0] or -1, x[1] or -1) for x in v) for v in by.values()))) == [
        [(-1, -1)], [(-1, 4), (4, 4)], [(1, 1), (2, 1)], [(3, 3)], [(5, 5)],
    ]
    stays = B.one_of_each(df)
    assert stays.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in stays.collect()) == [(-1, "x y z"), (1, ""), (3, "!!!"), (4, "one two"), (5, "one")]
    assert B.near_duplicates(df.limit(0)).collect() == []


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        i = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[i] = "zz" + str(r.random())[2:]
        elif kind == 1:
            w.insert(i, "zz" + str(r.random())[2:])
        elif len(w) > 1:
            del w[i]
    return w


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(1, 5))) for _ in range(150)]
    items = [" ".join(r.choices(vocabulary, k=n)) for n in (3, 6, 10, 18, 25, 40, 60, 25)]
    texts = []
    for i in range(80):
        w = r.choices(vocabulary, k=r.randint(0, 120))
        if i % 2:
            item = items[r.randrange(len(items))].split()
            at = r.randint(0, len(w))
            w[at:at] = edited(r, item, r.randint(0, int(0.25 * len(item))))
        texts.append(" ".join(w).upper() if i % 5 == 0 else " ".join(w) + ".")
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x["id"], x["item_id"]): x["edits"] for x in C.contaminated(docs_of(spark, texts), benchmark, block_items=5).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            d = brute_edits(words(item), words(t))
            if d <= (int(0.2 * len(words(item))) if len(words(item)) >= C.MIN_WORDS else 0):
                want[i, k] = d
    assert len(want) > 20
    assert got.keys() <= want.keys()
    assert len(want.keys() - got.keys()) <= 0.05 * len(want)
    assert all(got[k] == want[k] for k in got)


def test_decontamination_edge_cases(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h i j"), (None, "q r s t u v w x")], "item_id long, text string")
    rows = [(None, "A b c, d e f g h i j", None, None, 1), (None, None, None, None, None), (1, "", "x", "y", 0), (2, "a b c d e f g h", "x", "y", 1), (2, "a b c d e f g h", "x", "y", 1), (7, "b c d", "x", "y", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("clash"))
    got = C.contaminated(df, benchmark).collect()
    assert sorted((x["id"] or -1, x["item_id"]) for x in got) == [(-1, 3), (2, 3), (2, 3)]
    assert C.without_contaminated(df, benchmark).columns == df.columns
    assert C.contaminated(df, benchmark.limit(0)).collect() == []
    assert C.contaminated(df.limit(0), benchmark).collect() == []


def test_rows_are_rejected_by_their_own_text(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "q r s t u v w x")], "item_id long, text string")
    dirty, other, clean = "x A b c d e f g h i j y", "q r s t u v w x", "nothing of it in here at all"
    rows = [(i, t, "en", "s", n) for n, (i, t) in enumerate([(None, clean), (None, dirty), (None, None), (5, clean), (5, other), (5, clean), (6, dirty), (7, "")])]
    df = spark.createDataFrame(rows, DOCS)
    for items in (1, 5000):
        got = C.without_contaminated(df, benchmark, block_items=items).collect()
        assert sorted(x["n_chars"] for x in got) == [0, 2, 3, 5, 7]
        assert all(tuple(x) == rows[x["n_chars"]] for x in got)


def test_edit_distance_vector_form():
    r = random.Random(5)
    for _ in range(50):
        a, b = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2)]
        got, _ = C.edit_distance_within(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == brute_edits(a, b)


def sainte_lague_by_steps(claims, seats, most):
    out = [0] * len(claims)
    for _ in range(seats):
        open_ = [(-(c / (2 * out[i] + 1)), i) for i, c in enumerate(claims) if out[i] < most[i] and c > 0]
        if not open_:
            break
        out[min(open_)[1]] += 1
    return out


def test_sainte_lague_by_bisection_is_that_by_steps():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 8)
        claims = [r.choice([0, 1, 5, 5, r.random() * 100]) for _ in range(n)]
        most = [r.choice([0, 1, 3, 1000]) for _ in range(n)]
        seats = r.randint(0, 60)
        assert M.sainte_lague(np.array(claims), seats, np.array(most)).tolist() == sainte_lague_by_steps(claims, seats, most)


def test_mix_meets_its_contract(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 400))), "en", r.choice(["b", "a", "ä", "Z", None, "b", "b"]), 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = M.mix(df, shard_words=5000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix(df.repartition(7), shard_words=5000).collect()), key=str)
    assert len(got) == len(rows)
    size = {i: len(t.split()) for i, t, *_ in rows}
    by_source = defaultdict(int)
    for i, _, _, s, _ in rows:
        by_source[s] += size[i]
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    assert names == ["Z", "a", "b", "ä", None]
    target = plain_targets([by_source[s] for s in names])
    taken = defaultdict(int)
    for x in got:
        s = x["source"]
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == by_source[s]
        assert x["target"] == pytest.approx(target[names.index(s)])
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    for s, t in zip(names, target, strict=True):
        assert abs(taken[s] - t) <= 0.01 * t + 4 * M.BLOCK_WORDS


def test_mixed_texts_are_the_blocks_of_the_shards(spark):
    r = random.Random(9)
    rows = [(i if i % 9 else None, " \n".join(f"w{i}.{k}" for k in range(r.randint(0, 300))) + " ", "en", r.choice(["a", "b", "b", "b", "c"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    planned = M.spans(df, shard_words=5000, keep=("text", "n_chars"))
    got = planned.collect()
    digest = M.mix(df, shard_words=5000, keep=("n_chars",)).collect()
    taken = {x["n_chars"]: x["taken"] for x in digest}
    assert len(got) == len(rows) and sum(taken.values()) > 0
    assert all(sum(t["last"] - t["first"] + 1 for t in x["takes"]) == x["taken"] == taken[x["n_chars"]] for x in got)
    pieces = defaultdict(list)
    for x in M.mixed_texts(planned).collect():
        pieces[x["source_number"], x["shard"]].append(x)
    lines = defaultdict(list)
    for x in sorted((x for x in got if x["size"]), key=lambda x: x["begin"]):
        assert len(lines[x["source_number"], x["shard"]]) == x["begin"]
        lines[x["source_number"], x["shard"]] += x["text"].split()
    assert any(len(x["takes"]) > 1 for x in got) and len(lines) > 3
    times = set()
    for shard, line in lines.items():
        count = [0] * len(line)
        for p in pieces[shard]:
            assert p["text"].split() == line[p["first"] : p["last"] + 1]
            for k in range(p["first"], p["last"] + 1):
                count[k] += 1
        # a block is taken as a whole, and its times differ by one at most from the others'
        for k in range(0, len(line), M.BLOCK_WORDS):
            assert len(set(count[k : k + M.BLOCK_WORDS])) == 1
        assert max(count) - min(count) <= 1
        times |= set(count)
    assert len(times) > 1


def plain_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
        whole = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [2 * sizes[i] if i in capped else left * weights[i] / whole for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in capped and target[i] > 2 * sizes[i]}
        if not above:
            return target
        capped |= above


def test_mix_edge_cases(spark):
    rows = [(1, None, None, None, None), (1, "a b", None, None, 2), (None, "c d e", None, "s", 3), (None, "c d e", None, "s", 3), (2, "", "x", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    got = M.mix(df, keep=tuple(df.columns)).collect()
    assert len(got) == 5 and all(x["taken"] <= 2 * x["size"] for x in got)
    assert {x["size"] for x in got} == {0, 2, 3}
    assert M.mix(df.limit(0)).collect() == []
    assert M.mix(df.filter("text is null")).collect()[0]["taken"] == 0


def test_classes_of_a_family_just_below_the_limit(spark, monkeypatch):
    """A thousand copies with edits of their own, most pairs at 0.6 to 0.9, with tokens dealt to several tasks."""
    monkeypatch.setattr(B, "HOT_TOKEN", 20)
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(1000):
        now = list(base if k % 5 else texts[r.randrange(len(texts))].split())
        for _ in range(r.randint(1, 7)):
            i = r.randrange(len(now))
            now[i : i + 1] = r.choice([[], [f"w{r.randrange(300)}"], [now[i], f"v{r.randrange(10)}"]])
        texts.append(" ".join(now))
    index: dict = {}
    has = np.zeros((len(texts), 40_000), np.float32)
    for i, t in enumerate(texts):
        for gram, n in multiset(t).items():
            for k in range(n):
                has[i, index.setdefault((gram, k), len(index))] = 1
    size = has.sum(axis=1)
    both = has @ has.T
    close = both / (size[:, None] + size - both) >= np.float32(0.8)
    want = np.arange(len(texts))
    while True:
        new = np.where(close, want, len(texts)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert 20 < len(set(want)) < 900
    got = {row["id"]: row["class_id"] for row in B.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_differences_from_a_hub_tell_the_distance_of_two_texts():
    r = random.Random(5)
    for _ in range(300):
        sets = []
        for _ in range(3):
            bag = Counter(r.choices(range(30), k=r.randint(0, 60)))
            keys = sorted(bag)
            sets.append((np.array(keys, np.uint64), np.array([bag[k] for k in keys], np.int64)))
        x, y, hub = sets
        dx, dy = (set(B.difference(z, hub).tolist()) for z in (x, y))
        cx, cy, ch = (dict(zip(h.tolist(), c.tolist(), strict=True)) for h, c in sets)
        apart = lambda a, b: sum(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys())
        assert len(dx) == apart(cx, ch) and len(dx ^ dy) == apart(cx, cy)
