"""Bindings of the driver tables to the engine's sample schema.

The sample schema is ``row_id BIGINT, y INT, ts TIMESTAMP, family STRING,
sha STRING[, features ARRAY<DOUBLE>]``.  Bindings (see FIXTURES.md):

* temporal: ``events`` (y = event_type 'error', family = event_type) and
  ``orders`` (y = status 'F', family = priority);
* family: ``documents`` join ``labels`` (y = 1 - quality, sha = md5(text),
  family = source when y = 1 else 'Benign');
* vectors: ``embeddings`` (y = label 0, family = label, features = embedding).

Each binding has a SQL twin over the views of the same names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENIGN = "Benign"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("family"),
        F.col("event_id").cast("string").alias("sha"),
        F.array(F.col("value"), F.col("user_id").cast("double")).alias("features"),
    )


SQL_EVENTS = """(SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y, ts,
 event_type AS family, CAST(event_id AS VARCHAR) AS sha FROM events)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderpriority").alias("family"),
        F.col("o_orderkey").cast("string").alias("sha"),
        F.array(F.col("o_totalprice")).alias("features"),
    )


SQL_ORDERS = """(SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
 o_orderdate AS ts, o_orderpriority AS family, CAST(o_orderkey AS VARCHAR) AS sha FROM orders)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, on="doc_id", how="inner")
    y = (F.lit(1) - F.col("quality")).cast("int")
    return j.select(
        F.col("doc_id").alias("row_id"),
        y.alias("y"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.when(y == 1, F.col("source")).otherwise(F.lit(BENIGN)).alias("family"),
        F.md5(F.col("text")).alias("sha"),
    )


SQL_DOCUMENTS = """(SELECT d.doc_id AS row_id, CAST(1 - l.quality AS INTEGER) AS y,
 CASE WHEN 1 - l.quality = 1 THEN d.source ELSE 'Benign' END AS family, md5(d.text) AS sha
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") == 0).cast("int").alias("y"),
        F.col("label").cast("string").alias("family"),
        F.col("vec_id").cast("string").alias("sha"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


SQL_EMBEDDINGS = """(SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS y,
 CAST(label AS VARCHAR) AS family, CAST(vec_id AS VARCHAR) AS sha,
 CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"""
