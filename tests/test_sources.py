"""Readers, writers and schema helpers."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lowdata.functions import columns as C
from lowdata.sources import io


def test_require_and_ensure_columns(spark):
    df = spark.createDataFrame([(1, "a")], ["  SHA ", "Family"])
    with pytest.raises(ValueError):
        C.require_columns(C.norm_headers(df), ["sha", "timestamp", "family"])
    d = C.ensure_column(C.norm_headers(df), "seed", 0)
    assert d.columns == ["sha", "family", "seed"] and d.first().seed == 0
    assert C.present(d, ["test_start", "seed"]) == ["seed"]
    assert C.results_mode(spark.createDataFrame([(0.1,)], "auc_real_mean double")) == "paired_cv"
    assert C.results_mode(d) == "raw"


def test_index_json_precedence(spark):
    tmp = tempfile.mkdtemp(prefix="lowdata-idx-")
    for name, obj in {"a": {"train_only": [1, 2], "train": [9]}, "b": {"indices": [3]}, "c": {"train": [4], "test": [5]}}.items():
        with open(os.path.join(tmp, f"{name}.json"), "w") as fh:
            json.dump(obj, fh)
    got = sorted(r.row_id for r in io.read_index_json(spark, tmp).collect())
    assert got == [1, 2, 3, 4]


def test_read_preds_sniffing_and_clipping(spark):
    d = spark.createDataFrame([(1, 7, 0.2, 1.0000001), (0, 8, 0.9, -0.0000001)],
                              "target int, other int, junk double, prob double")
    out = io.read_preds(d).select("y_true_sniffed", "proba_sniffed").collect()
    assert [(r.y_true_sniffed, r.proba_sniffed) for r in out] == [(1, 1.0), (0, 0.0)]
    arr = spark.createDataFrame([(1, [0.3, 0.7])], "y int, probs array<double>")
    assert io.read_preds(arr).first().proba_sniffed == 0.7


def test_tag_parsing_and_variant(spark):
    stems = spark.createDataFrame([("_fam_a_msmw_full_w0.00050_s42_r20000_smote_",), ("other_thing",)], "stem string")
    r = io.collect_runs_by_tag(stems).collect()
    assert len(r) == 1 and r[0].family == "fam_a" and r[0].frac == 0.0005 and r[0].variant == "smote"
    t = spark.createDataFrame([("c_w00_s1_r0005_os2000",), ("c_real0005",), ("c_r001_gan20000",)], "tag string")
    assert [x.v for x in t.select(C.variant_from_tag("tag").alias("v")).collect()] == ["oversample", "real", "gan"]
    tag = spark.range(1).select(C.run_tag(F.lit("cut2019_10"), F.lit(3), F.lit(42), F.lit("smote"), F.lit(0.0005),
                                          F.lit(20000)).alias("t")).first().t
    assert tag == "cut2019_10_w03_s42_r00005_sm20000"


def test_index_json_trainer_order(spark):
    tmp = tempfile.mkdtemp(prefix="lowdata-idx-")
    shapes = {"a": {"train_only": [1], "indices": [9]}, "b": {"train": [2], "indices": [9]}, "c": {"train": [9], "test": [8], "indices": [3]},
              "d": {"train": [4], "test": [9]}}
    for name, obj in shapes.items():
        with open(os.path.join(tmp, f"{name}.json"), "w") as fh:
            json.dump(obj, fh)
    assert sorted(r.row_id for r in io.read_index_json(spark, tmp, "trainer").collect()) == [1, 2, 3, 4]


def test_collected_runs_carry_measures(spark):
    df = spark.createDataFrame([("_x_msmw_full_w0.01000_s42_r20000_gan", 0.5, 7), ("junk", 0.1, 1)], "stem string, auc double, other int")
    got = io.collect_runs_by_tag(df).collect()
    assert len(got) == 1 and got[0].family == "x" and got[0].auc == 0.5 and "other" not in got[0].asDict()


def test_shared_rows_belong_to_every_split(spark):
    tmp = tempfile.mkdtemp(prefix="lowdata-split-")
    io.write_split(spark.createDataFrame([("a", 1, "test"), ("b", 2, "test"), (io.SHARED, 3, "test")], "split_id string, row_id long, part string"), tmp)
    assert sorted(r.row_id for r in io.read_split(spark, tmp, "a").collect()) == [1, 3]


def test_empty_positive_class_is_an_error(spark):
    df = spark.createDataFrame([(1, 0)], "row_id long, y int")
    with pytest.raises(ValueError):
        C.positives(df, required=True)
    assert C.positives(df).count() == 0
