"""The pipeline's stages on a small corpus with planted cases, against their brute-force meaning."""

import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline as P

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """About 1,600 labelled documents: with some 300 the classifier finds only 7 of 10 toxic texts."""
    folder = str(tmp_path_factory.mktemp("planted"))
    base = spark.read.schema(DOCS).parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    item = benchmark.filter("item_id = 5").first()["text"]
    r = random.Random(6)
    clean = [x["text"] for x in base.join(labels.filter("quality = 1 and toxic = 0"), "doc_id").filter("length(text) between 900 and 3000").orderBy("doc_id").limit(6).collect()]
    words = clean[0].split()
    near = list(words)
    near[len(near) // 2] = "changed"
    fresh = [" ".join(r.sample(words, len(words))) for _ in range(3)]
    rows = [
        (100_001, clean[0]), (100_002, " ".join(near)), (100_003, fresh[0]), (100_004, fresh[1] + "\n" + item.upper() + " " + fresh[1]),
        (100_005, fresh[2].replace(" ", " idiot ", 3).replace("idiot", "moron", 1)), (100_006, None), (100_007, "123 456 !!"), (100_008, "X!! " * 300),
        (100_009, "Such a moron, idiot, pathetic loser and clown: stupid, worthless scum, disgusting trash.\n" + r.choice(clean[1:])),
    ]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)
    base.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_catch_planted_cases_and_keep_clean_documents(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, planted)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not {100_006, 100_007} & kept["language"].keys()
    assert {100_001, 100_003, 100_004, 100_005} <= kept["language"].keys()
    assert not {100_008, 100_009} & kept["quality"].keys()
    assert {100_001, 100_002, 100_003, 100_004} <= kept["quality"].keys()
    assert not {100_001, 100_002} <= kept["near_duplicates"].keys()
    assert {100_003, 100_004} <= kept["near_duplicates"].keys()
    assert 100_004 not in kept["decontaminate"] and 100_003 in kept["decontaminate"]
    mixed = kept["mix_sources"]
    assert mixed.keys() == kept["decontaminate"].keys()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed.values())


def test_columns_named_like_those_of_an_operator_are_unchanged(spark, planted):
    names = ("score", "lang_pred", "tail_prob", "expected_grade", "_text", "_digest", "_keep_id")
    docs = spark.read.parquet(f"{planted}/documents.parquet").filter("doc_id < 60 or doc_id > 100000")
    docs = spark.createDataFrame(docs.collect(), DOCS).selectExpr("*", *[f"'mine' AS {c}" for c in names])
    for _, stage in P.STAGES[:2]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in names)
    out = P.near_duplicates(spark, docs.limit(20), planted)
    assert out.columns == docs.columns and all(r[c] == "mine" for r in out.collect() for c in names)


@pytest.mark.xfail(reason="two toxic words among many clean ones leave the tail probability above the limit")
def test_quality_rejects_a_text_with_two_toxic_words(spark, planted):
    kept = P.quality(spark, spark.read.parquet(f"{planted}/documents.parquet"), planted)
    assert kept.filter("doc_id = 100005").count() == 0


def test_run_on_an_empty_table(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
