"""Results that once were wrong: appended raw tables, order of family outputs, kNN far from the origin,
std of single runs, negative best scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowdata.operators import knn as kn
from lowdata.operators import pairing as pa
from lowdata.operators import splits as sp
from lowdata.operators import thresholds as th
from lowdata.sources import io


def test_appends_with_different_columns_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "raw")
    io.append_raw(spark.createDataFrame([("p", "real", 0.5, 0.7, "t1")], "prefix string, variant string, auc double, f1 double, tag string"), path)
    io.append_raw(spark.createDataFrame([("p", 0.8, "t2")], "prefix string, auc double, tag string"), path)
    got = {r["tag"]: (r["variant"], r["auc"], r["f1"], r["seed"]) for r in io.read_raw(spark, path).collect()}
    assert got == {"t1": ("real", 0.5, 0.7, 0), "t2": (None, 0.8, None, 0)}
    order = [r["tag"] for r in io.read_raw(spark, path).orderBy("run_idx").collect()]
    assert order == ["t1", "t2"]


@pytest.mark.parametrize("shift,spread", [(0.0, 1.0), (1e6, 0.1), (1e7, 1.0)])
def test_knn_is_exact_far_from_the_origin_and_over_many_blocks(spark, shift, spread):
    rng = np.random.default_rng(4)
    ref, query = shift + spread * rng.standard_normal((600, 16)), shift + spread * rng.standard_normal((40, 16))
    frame = lambda m: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(m)], "row_id bigint, features array<double>")
    want = {i: sorted(range(600), key=lambda j: (np.sqrt(((ref[j] - q) ** 2).sum()), j))[:3] for i, q in enumerate(query)}
    for block in (1 << 23, 1 << 10):
        rows = kn.knn(frame(query), frame(ref), 3, block_bytes=block).orderBy("q_id", "nbr_rank").collect()
        got = {i: [r["nbr_id"] for r in rows if r["q_id"] == i] for i in want}
        assert got == want
    assert kn.knn(frame(query).limit(0), frame(ref), 3).count() == 0 and kn.knn(frame(query), frame(ref).limit(0), 3).count() == 0


def test_std_of_one_run_stays_unknown(spark):
    d = spark.createDataFrame([("p", 0.4, None), ("q", 0.4, 0.1), ("q", 0.6, 0.1)], "prefix string, m double, s double")
    got = {r["prefix"]: r["s"] for r in pa.collapse_means(d, ["prefix"], [("m", "s")]).collect()}
    assert got["p"] is None and got["q"] == pytest.approx((0.01 + 0.02) ** 0.5)


def test_negative_best_mcc_is_reported_as_null(spark):
    d = spark.createDataFrame([("p", 1, 0.1), ("p", 1, 0.2), ("p", 0, 0.8), ("p", 0, 0.9), ("p", 0, 0.5)], "prefix string, y_true int, proba double")
    r = th.pick_threshold_quantile(d, ["prefix"], "mcc", 16).first()
    assert r["best_score"] is None and 0.1 < r["threshold"] < 0.9


def test_family_guards(spark):
    d = spark.createDataFrame([("Benign", "a", 0), ("F", "b", 1)], "family string, sha string, y int")
    with pytest.raises(ValueError):
        sp.family_holdout(d, [" benign "])
    with pytest.raises(ValueError):
        sp.family_holdout(d.where(F.col("y") == 1), ["F"])


def test_a_cluster_without_shared_checkpoint_folder_is_refused(monkeypatch):
    from lowdata import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
