"""Registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowdata.llm import decontaminate as dc
from lowdata.llm import conversations, hostgraph, langid, licenses, packing, pii, ppm, runs, sharding, simhash, toxicity, vectors
from lowdata.llm.common import crc_fold, table
from lowdata.llm.twins import SQL_OP11, SQL_OP12

LLM_QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = (fn, sql)
        return fn
    return deco


SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = rf"regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_OP1 = f"""
WITH iw AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n,
               array_to_string(w[s + 1:s + least(len(w), 10)], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS s FROM iw WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents),
dg AS (SELECT r, s, n, array_to_string(w[s + 1:s + n], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n) x),
m AS (SELECT r, s, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m) y) z GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""


@register("op1_decontamination", SQL_OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in every document through the positional index."""
    out = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort("item_ids")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document; rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold("doc_id", 5)
    model = toxicity.train(docs.where(fold != 0), table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(crc_fold("id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@register("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 512 to 4096 words."""
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base patterns and what the skip-chain field adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs)).select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@register("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes (and tokens and rows)."""
    return sharding.shard(table(spark, sf_dir, "documents"), 24).select(
        F.col("id").alias("doc_id"), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the longest rule, else by its host's propagated trust and distrust."""
    return hostgraph.judge(table(spark, sf_dir, "pages"), whole_chain=True).withColumnRenamed("id", "page_id")


SQL_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)"""


@register("op7_vector_dedup", SQL_OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95, components and representatives of all embeddings."""
    out = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@register("op8_lm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram scores of all documents, learned from those with crc32(doc_id) mod 7 other than 2."""
    docs = table(spark, sf_dir, "documents")
    model = ppm.train(docs.where(crc_fold("doc_id", 7) != 2))
    out = ppm.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc_fold("id", 7) == 2, F.lit(False)).alias("held_out"),
                      "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that each document's paragraphs declare."""
    docs = table(spark, sf_dir, "documents")
    return licenses.documents(licenses.scan(docs, licenses.train(docs))).withColumnRenamed("id", "doc_id")


@register("op11_runs", SQL_OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, after repetitions planted by its id."""
    return runs.digest(table(spark, sf_dir, "documents"), words_of=runs.planted).withColumnRenamed("id", "doc_id")


@register("op12_conversations", SQL_OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired at least cost after faults chosen by crc32('conv_id:turn')."""
    return conversations.digest(conversations.damage(table(spark, sf_dir, "conversations")))


@register("op13_language")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_fold("doc_id", 4) != 2))
    return langid.identify(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(crc_fold("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
