"""Exact hash ranks and exact-size selection equal the plain single-window rule."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lowdata.functions.hashing import uniform
from lowdata.operators import ranking as rk


def _data(spark, n=3000):
    d = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    return d.withColumn("u", uniform(F.lit(7), F.lit("t"), F.col("row_id")))


def test_hash_rank_equals_row_number_many_buckets(spark):
    d = _data(spark)
    got = rk.hash_rank(d, "g", "u", "row_id", out="r", buckets=64).select("row_id", "r")
    w = Window.partitionBy("g").orderBy("u", "row_id")
    exp = d.select("row_id", F.row_number().over(w).alias("r"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_take_first_per_group_quota_table(spark):
    d = _data(spark)
    q = spark.createDataFrame([(0, 5), (1, 700), (2, 5000)], "g long, quota long")
    got = {r.row_id for r in rk.take_first(d, "g", q, "u", "row_id", buckets=32).collect()}
    w = Window.partitionBy("g").orderBy("u", "row_id")
    exp = d.withColumn("rn", F.row_number().over(w)).join(q, "g").filter("rn <= quota")
    assert got == {r.row_id for r in exp.collect()}


def test_take_first_global_and_zero_quota(spark):
    d = _data(spark, 500)
    assert rk.take_first(d, None, 17, "u", "row_id", buckets=8).count() == 17
    assert rk.take_first(d, None, 0, "u", "row_id").count() == 0
    assert rk.take_first(d, None, 10_000, "u", "row_id").count() == 500
