"""Token counts, fingerprints, language, quality, URLs, HTML and WARC against plain versions."""

import hashlib
import html
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm import langid_ftrl as G
from cardloom.llm import line_blocks as H
from cardloom.llm import order_minhash as O
from cardloom.llm import ordinal_quality as Q
from cardloom.llm import token_count as K
from cardloom.llm import url_rules as U
from cardloom.llm import warc_index as W

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def plain_count(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def odd_texts():
    r = random.Random(1)
    parts = ["don't", "<|endoftext|>", "<|startoftext|>x", "é", "e\u0301", " \u0301", "12345", "a1b2", "\u00a0", "\u2003", "  ", "\n\t", "中文字", "🙂🙂", "İ", "ß", "...", "'s", "ab" * 40, "\x1c", "\x85"]
    return ["", " ", *("".join(r.choices(parts, k=n)) for n in (1, 5, 50, 400)), *(" ".join(r.choices(parts, k=n)) for n in (5, 50, 400))]


def test_token_counts_are_the_library_s():
    texts = odd_texts()
    counter = K.Counter(vocabulary())
    assert counter.batch(texts) == plain_count(texts)


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (100, 16), (37, 1)])
def test_overlapping_chunks_give_the_count_of_the_whole(chunk, overlap):
    texts = [*odd_texts(), "a" * 500, "no" * 300 + " " + "x1" * 200]
    counter = K.Counter(vocabulary(), chunk, overlap)
    assert [counter.huge(t) for t in texts] == plain_count(texts)


def test_token_count_rows(spark):
    rows = [(1, None), (2, ""), (2, "two words"), (None, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in K.count_tokens(df, vocabulary()).collect())
    assert got == [(-1, 6000, 3000, True), (1, 0, 0, False), (2, 0, 0, False), (2, 9, 2, False)]
    assert K.count_tokens(df.limit(0), vocabulary()).collect() == []


def plain_edit(docs):
    """{doc_id: edited text} by the wording of the task."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (k, t) in enumerate(order):
        n = len(t or "") // 3
        after = order[(i + 1) % len(order)][1] or ""
        out[k] = (t or "")[: len(t or "") - n] + after[:n]
    return out


def test_fingerprints_and_edits(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-5, None), (-6, ""), (-7, "🙂 é ab"), (-8, "🙂 é ab"), (-9, "x" * 3000), (10**12, "word " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = {r["doc_id"]: r for r in O.fingerprint_edits(df).collect()}
    want = plain_edit(docs)
    assert len(got) == len(docs)
    for k, t in docs:
        assert got[k]["n_chars"] == len(t or "")
        assert got[k]["edited_sha256"] == hashlib.sha256(want[k].encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    assert got[-7]["fingerprint"] == got[-8]["fingerprint"] != ""
    assert got[-5]["fingerprint"] == got[-6]["fingerprint"] == ""
    long = [r for k, r in got.items() if r["n_chars"] > 1000 and k >= 0]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.35
    assert sum(r["near_next"] for r in long) / len(long) < 0.1


def test_fingerprint_is_the_plain_one(spark):
    """Elements, orders and tuples by a plain walk, with Spark's hash of each part."""
    texts = ["a b c a b c a b c d", "one", "x y", "the cat sat on the mat and the cat sat on the hat again", "w " * 70]
    assert not set("jkqvxz") & set("".join(texts)) - {"x"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["f"] for r in O.with_fingerprint(df, "text", "f").collect()}

    def xx(*args):
        return spark.range(1).select(F.xxhash64(*[F.lit(a) for a in args]).alias("h")).first()["h"]

    def ring(h):
        return (h % (1 << 64)) >> (64 - O.HASH_BITS)

    for t in texts:
        w = re.findall("[a-fh-z]+g?", t)
        seen, elements = {}, []
        for i in range(max(1, len(w) - O.K + 1)):
            gram = [w[i + j] if i + j < len(w) else None for j in range(O.K)]
            key = tuple(gram)
            cols = [F.lit(g).cast("string") for g in gram]
            h = ring(spark.range(1).select(F.xxhash64(*cols).alias("h")).first()["h"])
            n = seen.get(key, 0)
            seen[key] = n + 1
            elements.append(((ring(xx_long(spark, h, n)) << O.PLACE_BITS) | i))
        elements.sort()
        sketches = []
        for j in range(O.SKETCHES):
            start = (j * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - O.HASH_BITS)) << O.PLACE_BITS
            first = sum(e < start for e in elements)
            picked = [elements[(first + k) % len(elements)] for k in range(O.L)]
            picked.sort(key=lambda e: (e & O._PLACE, e >> O.PLACE_BITS))
            sketches.append(array_hash(spark, [e >> O.PLACE_BITS for e in picked]))
        assert got[t] == "".join(sketches), t


def test_one_insertion_in_unspaced_text_keeps_the_likeness(spark):
    r = random.Random(2)
    rows = []
    for n, alphabet in ((72, range(0x4E00, 0x4F00)), (3000, range(0x4E00, 0x4F00)), (3000, range(0x61, 0x7B)), (500, range(0x1F600, 0x1F640))):
        text = "".join(chr(r.choice(alphabet)) for _ in range(n))
        rows += [(n, text, text[:9] + "x" + text[9:]), (-n, text, "".join(r.sample(text, n)))]
    rows.append((24, "ab " + "y" * 24 + " c", "ab " + "y" * 24 + " c"))
    sentences = ["".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(20)) + "\u3002" for _ in range(4)]
    rows.append((4, " ".join(sentences), " ".join(x[:10] + "\u4e00" + x[11:] for x in sentences)))
    df = O.with_fingerprint(O.with_fingerprint(spark.createDataFrame(rows, "n long, a string, b string"), "a", "fa"), "b", "fb")
    got = df.select("n", O.likeness("fa", "fb").alias("near")).collect()
    assert len(got) == len(rows)
    assert all(x["near"] > 0.8 if x["n"] >= 500 or x["n"] == 24 else x["near"] > 0.5 if x["n"] > 0 else x["near"] < 0.3 for x in got), got
    text = "ab " + "abcdefgh" * 3 + " zzab c, caf\u00e9 10205x \u4e00\u4e01b\u00a0"
    words = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(O.WORDS), F.lit(1)).alias("w")).first()["w"]
    assert words == ["ab", "abcdefg", "habcdefg", "habcdefg", "h", "z", "z", "ab", "c", ",", "caf\u00e9", "10", "20", "5", "x", "\u4e00", "\u4e01", "b", "\u00a0"]
    assert "".join(words) == "".join(text.split(" "))


def xx_long(spark, h, n):
    return spark.range(1).select(F.xxhash64(F.lit(h).cast("bigint"), F.lit(n).cast("int")).alias("h")).first()["h"]


def array_hash(spark, values):
    h = spark.range(1).select(F.xxhash64(F.array(*[F.lit(v).cast("bigint") for v in values])).alias("h")).first()["h"]
    return f"{h % (1 << 64):016X}"[-8:]


def test_successors_over_blocks(spark):
    ids = [5, 1, 9, 7, 7, 3, None, 100, -4]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, t string")
    for blocks in (1, 2, 5, 40):
        got = sorted((r["t"], r["next_t"]) for r in O.with_next(df, "doc_id", ("t",), blocks).collect())
        order = [t for _, t in sorted(((i is None, -(i or 0)), f"t{n}") for n, i in enumerate(ids))]
        assert got == sorted(zip(order, order[1:] + order[:1], strict=True))
    assert O.with_next(df.limit(0), "doc_id", ("t",), 3).collect() == []
    only_null = df.filter("doc_id is null")
    assert [(r["t"], r["next_t"]) for r in O.with_next(only_null, "doc_id", ("t",), 3).collect()] == [("t6", "t6")]


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = G.train(docs.filter(G.may_learn(docs)))
    rows = G.predict(docs.select("doc_id", "text", "lang"), model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert 200 < len(held) < 500
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    # scores are calibrated: their mean is near the share of right answers
    right = sum(r["lang"] == r["lang_pred"] for r in held) / len(held)
    assert abs(sum(r["score"] for r in held) / len(held) - right) < 0.05


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (None, "the and of", "en"), (4, "the and of", "en"), (4, "der die und", "de"), (5, "der und das", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = G.train(df)
    got = G.predict(df, model).collect()
    assert [r["lang_pred"] for r in got][:3] == ["und"] * 3
    assert {r["lang_pred"] for r in got[3:]} <= {"en", "de"}
    assert all(0 <= r["score"] <= 1 for r in got)
    none = G.train(df.limit(0))
    assert {r["lang_pred"] for r in G.predict(df, none).collect()} == {"und"}
    assert G.predict(df.limit(0), model).collect() == []


def test_quality_catches_toxic_words_and_keeps_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.train(docs, labels)
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    rated = Q.score(docs, model).join(labels, "doc_id", "left").collect()
    good = [r for r in rated if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r for r in rated if r["quality"] is not None and (r["quality"] == 0 or r["toxic"] == 1)]
    assert sum(r["tail_prob"] >= Q.KEEP_TAIL for r in good) / len(good) > 0.95
    assert sum(r["tail_prob"] < Q.KEEP_TAIL for r in bad) / len(bad) > 0.6
    assert all(0 <= r["tail_prob"] <= r["expected_grade"] <= 2 for r in rated)


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (2, "a")], "doc_id long, text string").withColumn("tail_prob", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(Q.score(df, Q.train(df, labels)).collect()) == 4
    none = Q.train(df, labels.limit(0))
    assert all(r["tail_prob"] > 0.99 for r in Q.score(df, none).collect())
    assert Q.score(df.limit(0), none).collect() == []


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return host.translate(str.maketrans(U.UPPER, U.LOWER)), rest[:cut]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://a.net/x", "HTTP://EXAMPLE.NET/en/1?q=1", "http://x.example.net/en", "http://example.net?x=/en/", "http://ÄB.Org/fr/a#b/c",
    "http://notexample.com/de/", "http://www.example.com/de/1", "http://net/", "http://a://b/c", "x://", "http://example.com#/de/", "http://b.org/fr/", "http://b\norg/fr",
]


def test_url_parts_and_fixed_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in U.judge(df.withColumn("html", F.lit("")), U.Rules([], {})).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        rule, verdict = plain_rule(host, path)
        assert tuple(got[i])[1:5] == (host, path, rule, verdict or "allow"), url


def test_learned_rules_are_those_of_all_combinations(spark):
    from itertools import combinations

    r = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        host, word = r.choice(["good", "spam", "mixed"]), r.choice(["a", "pills", "b"])
        rows.append((i, f"http://{host}.org/{word}/{i}", None))
        odds = {"spam": 0.95, "good": 0.02, "mixed": 0.9 if word == "pills" else 0.05}[host]
        if i % 4:
            labels.append((i, int(r.random() > odds), 0))
    pages = spark.createDataFrame(rows, PAGES)
    rules = U.mine(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 0.05, 0.7)
    have = {x["page_id"]: frozenset(x["t"]) for x in pages.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    bad = {i: q == 0 for i, q, _ in labels}
    found = {}
    for k in range(1, 7):
        for combo in {c for i in bad for c in combinations(sorted(have[i]), k)}:
            of = [bad[i] for i in bad if have[i].issuperset(combo)]
            if sum(of) >= 0.05 * len(bad) and sum(of) / len(of) >= 0.7:
                found[frozenset(combo)] = 1
    for i, t in have.items():
        assert rules.blocks(set(t)) == any(c <= t for c in found), rows[i]
    assert any(rules.blocks(set(t)) for t in have.values())
    assert U.mine(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).rules == []
    assert U.judge(pages.limit(0), rules).collect() == []


def test_labels_go_to_pages_by_the_number_in_the_url(spark):
    urls = {"http://a.org/en/12": 12, "http://a.org/en/12/": 12, "http://a.org/en/12.html?page=7": 12, "http://a.org/x7/9#3": 9, "http://a.org/12/en": None, "http://a.org": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["n"] for r in df.select("url", U.document_number(F.col("url")).alias("n")).collect()} == urls
    # page ids run against the document numbers, so labels joined by page_id would block the good host
    rows = [(199 - i, f"http://{'spam' if i < 100 else 'good'}.org/{i}", None) for i in range(200)]
    pages = spark.createDataFrame(rows, PAGES)
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rules = U.mine(pages, labels)
    blocked = {r["page_id"] for r in U.judge(pages, rules, ()).collect() if r["verdict"] == "block"}
    assert blocked == {199 - i for i in range(100)}


def test_a_long_path_that_pages_share_is_one_item(spark):
    shared = "/".join(f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(40))
    rows = [(i, f"http://spam.org/{shared}/{i}", None) for i in range(60)] + [(i, f"http://good.org/{'abc'[i % 3]}/{i}", None) for i in range(60, 300)]
    labels = [(i, int(i < 3), 0) for i in range(30)] + [(i, 1, 0) for i in range(60, 200)]
    rules = U.mine(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = U.judge(spark.createDataFrame(rows, PAGES), rules)
    assert {r["page_id"] for r in got.filter("learned = 'block'").collect()} == set(range(60))
    assert len(rules.rules) == 1


def test_ngrams_of_long_texts_do_not_depend_on_slices(monkeypatch):
    r = random.Random(5)
    for text in ("".join(r.choice("abc é!!  7日") for _ in range(997)), "--" * 300, "a" * 500, "x" + "." * 400 + "y"):
        (want, n), = G.ngram_counts([text])
        for size in (1, 2, 3, 50, 499):
            monkeypatch.setattr(G, "SLICE_CHARS", size)
            (got, m), = G.ngram_counts([text])
            assert (got == want).all() and m == n, (text, size)
        monkeypatch.undo()


def test_samples_keep_their_bound_with_hot_ids_and_copies(spark):
    rows = [(7, f"text {i}", "en") for i in range(2000)] + [(9, "the same", "en")] * 2000 + [(100 + i, f"other {i}", "en") for i in range(2000)]
    rows += [(None, f"none {i}", "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    got = G.drawn(docs.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit(""))), {"en": len(rows)}, 400)
    assert 200 < got.count() < 500
    rated = spark.createDataFrame([(i, 1) for i in [7, 9, *range(100, 2100)]], "_id long, grade int")
    assert 200 < Q.drawn(docs.withColumnRenamed("id", "_id"), rated, 2002).count() < 2500
    assert Q.drawn(docs.withColumnRenamed("id", "_id"), rated, 4002).filter("text = 'the same'").count() <= 1


def test_coincidences_are_no_rules(spark):
    r = random.Random(8)
    rows = [(i, f"http://h{r.randrange(40)}.org/{'abc'[i % 3]}{r.choice('xyz')}/{r.choice('uvw')}/{i}", None) for i in range(900)]
    labels = [(i, int(r.random() > 0.25), 0) for i in range(900)]
    pages = spark.createDataFrame(rows, PAGES)
    assert U.mine(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).rules == []
    few = spark.createDataFrame([(1, 0, 0), (2, 0, 0), *((i, 1, 0) for i in range(3, 80))], "doc_id long, quality int, toxic int")
    assert U.mine(pages, few).rules == []


def test_links_and_short_lines_of_an_article_stay():
    body = f"<article><p>{LONG * 2}</p><ul><li><a href=x>a link</a></li></ul><p>end words.</p></article>"
    assert H.main_text(page(body)) == f"{LONG * 2}a link end words."
    ad = f"<article><p>{LONG * 2}</p><div class=ad>Buy now</div><p>The end.</p></article><p>{LONG}</p>"
    assert H.main_text(page(ad)) == f"{LONG * 2}The end."
    assert H.main_text(page(f"<article><h1>Short</h1><p>Hi.</p></article><div>{LONG * 10}</div>")) == "Short Hi."


def test_work_grows_with_the_length_of_a_page():
    import time

    for part in ("<div>", "</span><div>", "<nav>x", "<b><table><div>x</b>", "<b><dt>x</dt>"):
        start = time.process_time()
        H.main_text(part * 40_000)
        assert time.process_time() - start < 20, part
    assert H.main_text("<div>" * 30_000 + "</span>" * 30_000 + "x") == "x"


def test_main_text_of_no_pages(spark):
    assert H.extract(spark.createDataFrame([], PAGES)).collect() == []


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


LONG = "Some sentence of the article that goes on for quite a while so that it counts as text. "


def test_main_text_of_the_pages_is_their_article(spark):
    import re

    got = {r["page_id"]: r for r in H.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = " ".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""), ("", ""), ("plain text only", "plain text only"), (page("<p>a &amp; b &#233;\n c<p>d"), "a & b é c d"),
        (page(f"<div id=menu><a href=x>Home</a></div><div class='content'><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div>"), f"{LONG}Short. {LONG}".strip()),
        (page(f"<header><h1>Site</h1></header><main><h1>Head</h1><p>{LONG}<form><input><p>{LONG}</form></main><aside>{LONG}</aside>"), f"Head {LONG}".strip()),
        (page(f"<script>if (a < b) x = '<p>no</p>';</script><article><p>x<!-- <p>no</p> -->y</p><p>{LONG}"), f"xy {LONG}".strip()),
        (page(f"<article><p>1 &lt; 2 and 3 < 4</p><div class='cookie-notice'>{LONG}</div><ul><li>one<li>two</ul></article>"), "1 < 2 and 3 < 4 one two"),
    ],
)
def test_main_text_cases(source, want):
    assert H.main_text(source) == want


def test_region_follows_surge_and_dive():
    lines = [("Home", 1.0, False), ("About", 1.0, False), ("x" * 90, 0.0, False), ("short", 0.0, False), ("y" * 200, 0.0, False), ("Imprint", 1.0, False), ("Terms", 1.0, False)]
    assert H.region(lines) == ["x" * 90, "short", "y" * 200]


def test_main_text_is_found_without_article_tags(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    assert len(rows) > 20
    for r in rows:
        want = H.main_text(r["html"])
        for tag in ("", "div"):
            bare = r["html"].replace("<article>", f"<{tag}>" if tag else "").replace("</article>", f"</{tag}>" if tag else "")
            assert H.main_text(bare) == want, r["page_id"]


def test_lines_outside_the_content_can_surge():
    far = LONG * 5
    assert H.main_text(page(f"<article><p>{LONG}</p></article><p><a href=x>Next</a></p><p>{far}</p>")) == f"{LONG}{far}".strip()
    assert H.main_text(page(f"<p>By line</p><article><p>{LONG}</p><p>End.</p><p>Fin.</p></article><p>Imprint</p>")) == f"{LONG}End. Fin."
    # short lines between two regions stay, link lines and what lies behind them do not
    between = "".join(f"<p>Item {i}</p>" for i in range(9))
    got = H.main_text(page(f"<p>Log in</p><p><a href=x>Home</a></p><p>Title</p><p>{LONG}</p>{between}<p><a href=x>More</a></p><p>{LONG}</p><p><a href=x>Next</a></p><p>Imprint</p>"))
    assert got == f"Title {LONG}" + "".join(f"Item {i} " for i in range(9)) + LONG.strip()


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='has-sidebar'>", "<div class='layout-with-sidebar'>", "<div class='content no-header'>", "<div id='main-form'>", "<form method=post>", "<div class='page'><form><div class='has-sidebar'>"],
)
def test_wrappers_of_the_text_are_not_dropped(wrapper):
    text, want = f"<h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"Head {LONG}Short. {LONG}".strip()
    side = "<div class='sidebar'><p>A few words of the side.</p></div>"
    ends = "</div></form></div>"
    around = lambda x: page(f"<nav><a href=x>Home</a></nav>{wrapper}{x}{side}{ends}<footer>Some words of the footer.</footer>")
    assert H.main_text(around(text)) == want
    assert H.main_text(around(f"<article>{text}</article>")) == want
    assert H.main_text(around(f"<main>{wrapper}{text}{ends}</main>")) == want


def test_marks_hold_on_elements_beside_the_text():
    assert H.main_text(page(f"<p>{LONG}</p><div class='comments-area'>{'<p>' + LONG + '</p>'}{'<p>' + LONG + '</p>'}</div>")) == LONG.strip()
    assert H.main_text(page(f"<article><p>Tiny.</p></article><footer>{LONG}</footer>")) == "Tiny."
    assert H.main_text(page(f"<article></article><div class='ad'>Some advert.</div><footer>{LONG}</footer>")) == ""


def test_archives_round_trip(spark):
    big = "<p>" + "päyload " * 40 + "</p>"
    rows = [
        (5, "http://www.Example.com/a?b=1#c", big), (3, "http://www.example.com/a?b=1", big), (9, None, big), (1, "http://b.org/", "small"), (2, "http://b.org/", "small"),
        (4, "no url", None), (6, "http://a.b/\tx y\n", ""), (7, "http://a.b/\\t", "🙂" * 100), (7, "http://a.b/\\t", "🙂" * 100),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("key", F.lit("clash"))
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in W.round_trip(df).collect())
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h, i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h] != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else -1))
    assert got == sorted(want)
    assert W.round_trip(df.limit(0)).collect() == []


def test_look_up_finds_captures_of_single_keys(spark, tmp_path):
    old = W.BLOCK_LINES
    W.BLOCK_LINES = 3
    try:
        rows = [(i, f"http://h{i % 5}.org/{i % 7}", f"body {i}") for i in range(60)] + [(100 + i, "http://same.org/", "x") for i in range(10)]
        pages = spark.createDataFrame(rows, PAGES).repartition(1)
        archives, index = f"file://{tmp_path}/warc", f"file://{tmp_path}/cdx"
        for d in ("warc", "cdx"):
            (tmp_path / d).mkdir()
        captures = W.write_archives(pages, archives)
        directory = W.build_index(captures, index)
        for url in ("http://h3.org/2", "http://same.org/", "http://none.org/", "http://h0.org/0"):
            keys = spark.createDataFrame([(W.reversed_host(url),)], "key string")
            got = sorted((r["page_id"], bytes(r["payload"]).decode()) for r in W.look_up(keys, directory, archives, index).collect())
            assert got == sorted((i, b) for i, u, b in rows if u == url)
    finally:
        W.BLOCK_LINES = old


def test_pieces_of_any_script_and_length(spark):
    """The pieces are those of the plain classes, and no run of letters or digits takes the stack."""
    letter = rf"[\p{{L}}\p{{M}}&&[^{O.CUT_LETTERS}{O.SINGLE}]]"
    plain = rf"([{O.SINGLE}]|{letter}+[{O.CUT_LETTERS}]?|[{O.CUT_LETTERS}]|[\p{{N}}&&[^0{O.SINGLE}]]+0?|0|[^\s\p{{L}}\p{{M}}\p{{N}}])"
    r = random.Random(8)
    odd = ["a", "g", "é", "з", "漢", "〇", "ก", "๑", "0", "10", "7٣", "½", "́", "😀", ".", " ", "\n\t ", " ", " " * 20, "xyz"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["aз" * 200_000, "з" * 200_000, "7٣" * 100_000, " " * 50_000 + "a" + " " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cut = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(1))
    assert df.filter(cut(plain) != cut(O.WORDS)).count() == 0
    # entries that can't be null are sorted without boxing
    assert spark.range(1).select(F.array().cast(O._LONGS).alias("x")).schema["x"].dataType == T.ArrayType(T.LongType(), False)


def test_batches_for_python_are_small(spark):
    """A stage that carries whole rows through Python holds few of them at once, and each text once."""
    from cardloom.llm import shared

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for value, small in (("64MB", False), ("5m", False), ("100k", True)):
            spark.conf.set(name, value)
            shared.small_batches(spark)
            assert spark.conf.get(name) == (value if small else str(shared.BATCH_BYTES))
        spark.conf.set(name, "64MB")
        rows = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) AS text", "'en' AS lang")
        told = G.predict(rows, G.train(rows.limit(0)))

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

        assert told.count() == 8000
        assert max(x.n for x in rows.mapInArrow(sizes, "n long").collect()) < 3000
        whole, at = shared.with_text(rows, rows.select("doc_id", "text"), "text")
        assert (whole.columns, at) == (["doc_id", "text"], 1)
        nested, at = shared.with_text(rows.selectExpr("struct(*) AS row"), rows.selectExpr("struct(*) AS row").select("row"), "row.text")
        assert (len(nested.columns), at) == (2, 1)
    finally:
        spark.conf.set(name, before)
