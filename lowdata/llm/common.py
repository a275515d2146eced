"""Helpers shared by the training-data operators: stored tables, ordinals, components.

Nothing here holds documents on the driver.  Tables that feed several branches
are written under the shared ``spark.checkpoint.dir``, so a lost executor
costs a task retry and never a recomputation of the whole plan; the files go
when the application ends.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lowdata.session import cut_lineage, scratch_path

TO_ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (files go with the application).

    ``few``: for tables that grow with a query set and not with the documents; no more files than cores.
    """
    spark = df.sparkSession
    df = df.coalesce(spark.sparkContext.defaultParallelism) if few else df
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(col, n: int) -> F.Column:
    """crc32 of the value written as text, modulo ``n`` (null stays null)."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int = 64) -> DataFrame:
    """Gapless 0-based position of each row within ``keys``, without one task per key.

    Rows are numbered inside (keys, salt) and shifted by the number of rows in
    earlier salts of the same key; the shift table has ``salts`` rows per key.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(*keys, "__salt").count()
    w = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__s"),
                         F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__shift"))
    local = salted.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__salt") == F.col("__s")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return local.join(shift, cond).withColumn(out, (F.col(out) + F.col("__shift")).cast("long")).select(*df.columns, out)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component = the least node reachable.

    Alternating large-star / small-star rounds: each round is a map-side combined
    minimum per node and a join on the node, so a hub with a third of all edges is
    pre-aggregated and its join partition can be split.  Lineage is cut each round.
    """
    def directed(df):
        return (df.where(F.col("u") != F.col("v"))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    e = cut_lineage(directed(edges.select("u", "v")))
    for _ in range(max_rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        large = (sym.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("n"))
                 .select(F.col("v").alias("u"), F.least("m", "n").alias("v")).distinct())
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = (large.join(low, F.col("u") == F.col("n"))
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*"))
        e = cut_lineage(directed(small))
        # done when every node points at one root and no root points further
        twice = e.groupBy("u").count().where("count > 1").select("u")
        chained = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if twice.unionByName(chained).isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


TEXT_ROWS = 500


def texts_of(batches, rows: int = TEXT_ROWS):
    """Arrow batches cut to a few rows: texts become Python objects a slice at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_text(fn, text_col: str, names: list[str], types: list[pa.DataType], keep: list[str]):
    """A ``mapInArrow`` function: ``fn(list of str-or-None) -> list of columns`` next to the kept columns."""
    def run(batches):
        for b in texts_of(batches):
            cols = fn(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(c, t) for c, t in zip(cols, types)],
                                             names=keep + names)
    return run
