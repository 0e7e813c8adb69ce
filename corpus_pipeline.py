"""Corpus pipeline: language, quality, near duplicates, benchmark passages, source mix.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
a DataFrame that is written as parquet and read again. All stages but the last return the columns
of documents unchanged; the last adds the pieces (pass, first and last word) that the
mix takes of each document, and their shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import bag_minhash, cgk_decontam, langid_ftrl, ordinal_quality, source_mix
from cardloom.llm.shared import new_path

MIN_LANGUAGE_SCORE = 0.3  # below it no language stands out


def carried(docs: DataFrame) -> DataFrame:
    """(row): each row whole, so that no column of it meets one of an operator's; the text is ``row.text``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of which no language can be told."""
    learn = langid_ftrl.may_learn(docs)
    model = langid_ftrl.train(docs.filter(learn))
    told = langid_ftrl.predict(carried(docs), model, "row.text")
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that probably miss the best grade (toxic, or of low quality)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal_quality.train(docs, labels)
    scored = ordinal_quality.score(carried(docs), model, "row.text")
    return scored.filter(F.col("tail_prob") >= ordinal_quality.KEEP_TAIL).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return bag_minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return cgk_decontam.without_contaminated(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size, their source's size and target, and the pieces that the mix takes.

    ``source_mix.mixed_texts`` of the result is the text of the mix.
    """
    return source_mix.spans(docs, keep=tuple(docs.columns))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

# learned models and hashed signatures have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
