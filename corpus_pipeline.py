"""Corpus pipeline: toxicity, SimHash near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  ``run`` writes each stage's result as Parquet under the shared checkpoint folder
and reads it again as the next stage's input, so a lost executor repeats tasks of
one stage only.

Edge cases are those of the operators: null and empty texts pass the filters (they
form one near-duplicate group) and are packed as an end mark; repeated rows fall into
one near-duplicate group; empty tables give empty results; further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowdata.llm import decontaminate, packing, pii, simhash, toxicity
from lowdata.llm.common import store, table
from lowdata.session import configure

ORACLE_SQL = None  # trained models and hashes that DuckDB lacks: tests/llm/test_pipeline.py compares with brute force


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is below one half."""
    configure(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return docs.where(toxicity.score_column(model) < 0.5)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    configure(spark)
    return simhash.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    configure(spark)
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = decontaminate.decontaminate(docs.select(key.alias("doc_key"), "text"), table(spark, sf_dir, "benchmark"), id_col="doc_key")
    hit = found.where("n_hit > 0").select(F.col("id").alias("__hit")).distinct()
    return docs.join(hit, key.eqNullSafe(F.col("__hit")), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    configure(spark)
    clean = docs.withColumn("text", pii.redacted_column(pii.train(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    configure(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", remove_toxic), ("near_duplicates", remove_near_duplicates), ("decontamination", remove_contaminated),
          ("personal_data", redact_personal_data), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
