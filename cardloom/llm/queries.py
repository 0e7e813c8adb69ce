"""The corpus operators bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import (
    bag_minhash,
    cgk_decontam,
    langid_ftrl,
    line_blocks,
    order_minhash,
    ordinal_quality,
    piece_codec,
    pivot_clusters,
    shared_lists,
    source_mix,
    token_count,
    url_rules,
    warc_index,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the tokenizer file of the token counts; its folder holds public vocabularies on every machine
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"  # the model of the piece codec


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    return warc_index.round_trip(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_index"] = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= {warc_index.REVISIT_BYTES}
             THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM r"""


@query
def op2_bag_minhash(spark: SparkSession, sf: str) -> DataFrame:
    classes = bag_minhash.near_duplicates(table(spark, sf, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size")


@query
def op3_ordinal_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = ordinal_quality.train(docs, table(spark, sf, "labels"))
    scored = ordinal_quality.score(docs.select("doc_id", "text"), model)
    kept = (F.col("tail_prob") >= ordinal_quality.KEEP_TAIL).alias("kept")
    return scored.select("doc_id", "expected_grade", "tail_prob", kept)


@query
def op4_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return source_mix.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf, "documents"), vocabulary_path())


@query
def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    rules = url_rules.mine(pages, table(spark, sf, "labels"))
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf, "pages"))


@query
def op8_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.fingerprint_edits(table(spark, sf, "documents"))


@query
def op9_cgk_decontam(spark: SparkSession, sf: str) -> DataFrame:
    hits = cgk_decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.withColumnRenamed("id", "doc_id")


@query
def op10_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    learn = langid_ftrl.may_learn(docs)
    model = langid_ftrl.train(docs.filter(learn))
    rows = docs.select("doc_id", (~learn).alias("held_out"), "text")
    return langid_ftrl.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_shared_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return shared_lists.hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


ORACLES["op11_shared_lists"] = f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({shared_lists.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id AS id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM r a CROSS JOIN r b WHERE a.vec_id % 100 = 0 AND a.k <> b.k),
p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS place
  FROM s WHERE same QUALIFY place <= {shared_lists.POSITIVES}),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same
   AND {shared_lists.LOW_PCT} * p.score <= 100 * s.score AND 100 * s.score <= {shared_lists.HIGH_PCT} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {shared_lists.NEGATIVES}"""


@query
def op12_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf, "documents"), vocabulary_path(PIECES))
    decoded = F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), decoded)


@query
def op13_pivot_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_clusters.cluster(table(spark, sf, "embeddings")).drop("centroid")


def _cluster_sql() -> str:
    """Rounds of assignment and floor means, one pair of tables each."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.k, m.c, CAST(list_sum(list_transform(list_zip(v.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v CROSS JOIN m{r} m)
  GROUP BY k)"""
    means = """
m{next} AS MATERIALIZED (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM m{r} m LEFT JOIN (
    SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (
        SELECT a.c, unnest(v.v) AS x, unnest(range(len(v.v))) AS i FROM a{r} a JOIN v ON v.k = a.k)
      GROUP BY c, i)
    GROUP BY c) n ON n.c = m.c)"""
    rounds = range(pivot_clusters.ROUNDS)
    tables = [step.format(r=r, next=r + 1) for r in rounds for step in (nearest, means)]
    last = pivot_clusters.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id,
         list_transform(embedding, lambda x: CAST(floor({pivot_clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {pivot_clusters.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v
  FROM v QUALIFY c < {pivot_clusters.CLUSTERS}),
{",".join(tables)},
{nearest.format(r=last)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{last} a JOIN v ON v.k = a.k JOIN m{last} m ON m.c = a.c"""


ORACLES["op13_pivot_clusters"] = _cluster_sql()


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
