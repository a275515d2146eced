"""Draws in place, the mixture sampler, stored generator weights and the pivot index at awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowdata.operators import augment as au
from lowdata.operators import knn as kn
from lowdata.plans import q_augment as qa
from lowdata.plans.evaluate import RunSpec, synthetic_candidates

VEC = "row_id long, y int, features array<double>"


def frame(spark, x, y=None, first=0):
    return spark.createDataFrame([(first + i, 1 if y is None else int(y[i]), [float(v) for v in r]) for i, r in enumerate(x)], VEC)


def test_one_positive_and_very_many_draws(spark):
    tr = frame(spark, [[1, 2], [3, 4], [5, 6]], [1, 0, 0])
    big = au.oversample_to_const(tr, 10_000_003).where("is_synth")
    assert big.select("features", "uid").where("features = array(1D, 2D)").count() == 10_000_000


def test_draws_are_dealt_evenly_and_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(au, "DRAWS_AT_ONCE", 3)
    tr = frame(spark, np.arange(14).reshape(7, 2), [1] * 6 + [0])
    syn = au.oversample_to_const(tr, 7 + 40, seed=3).where("is_synth")
    assert sorted(int(r["uid"][3:]) for r in syn.collect()) == list(range(40))
    per = [r["count"] for r in syn.groupBy("src_row_id").count().collect()]
    assert sum(per) == 40 and len(per) == 6 and max(per) - min(per) <= 1
    few = au.oversample_to_const(tr, 9, seed=3).where("is_synth")
    assert few.count() == 2 and few.select("src_row_id").distinct().count() == 2
    assert au.oversample_to_const(tr, 7).count() == 7 and au.oversample_to_const(tr.where("y = 0"), 50).count() == 1


@pytest.mark.parametrize("k", [1, 5])
def test_smote_points_lie_between_two_positives(spark, k):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 3))
    tr = frame(spark, np.concatenate([x, rng.normal(size=(5, 3))]), [1] * 12 + [0] * 5)
    rows = au.smote_to_const(tr, 17 + 100, seed=5, k=k).where("is_synth").collect()
    assert len(rows) == 100 and {r["src_row_id"] for r in rows} == set(range(12))
    for r in rows:
        a, b = x[r["src_row_id"]], x[r["_nbr"]]
        assert r["_nbr"] != r["src_row_id"] and np.allclose(r["features"], a + r["_t"] * (b - a))
        if k > 1:
            assert (np.linalg.norm(x - a, axis=1) < np.linalg.norm(b - a)).sum() <= k - 1
    one = au.smote_to_const(frame(spark, [[1, 2]]), 4)
    assert one.where("is_synth").count() == 3


def test_mixture_sampler_keeps_a_mean_far_from_the_components(spark):
    rng = np.random.default_rng(2)
    x = 10 + rng.normal(size=(600, 12)) * np.array([5, 4, 3] + [0.3] * 9)
    p = au.fit_sampler(frame(spark, x), "gmm", k=2, dims=3, seed=1)
    g = np.array([r["features"] for r in au.sample_gmm(spark, p, 4000, 7).collect()])
    assert np.abs(g.mean(0) - x.mean(0)).max() < 0.35 and np.allclose(g.std(0), x.std(0), rtol=0.1)
    again = np.array([r["features"] for r in au.sample_gmm(spark, p, 50, 7).orderBy("gen_id").collect()])
    first = {tuple(r) for r in g.round(9).tolist()}
    assert all(tuple(r) in first for r in again.round(9).tolist())


def test_parameter_table_round_trip_and_checks(spark, tmp_path):
    layers = qa.mlp_layers(5)
    t = au.layers_table(spark, layers)
    back = au.read_layers(t.repartition(7))
    assert all(np.array_equal(a, c) and np.array_equal(b, d) for (a, b), (c, d) in zip(layers, back))
    bad = {"empty": t.where("layer > 9"), "bytes": t, "gapless": t.where("NOT (layer = 1 AND row = 3)"), "bias": t.where("NOT (layer = 0 AND row = -1)"),
           "takes": t.where("NOT (layer = 1 AND row >= 20)"), "layer 1": t.where("layer <> 1"),
           "non-finite": t.withColumn("values", F.when(F.col("row") == 2, F.array(F.lit(float("nan")))).otherwise(F.col("values")))}
    for word, table in bad.items():
        with pytest.raises(ValueError, match=word):
            au.read_layers(table, 100 if word == "bytes" else au.PARAM_BYTES)
    path = str(tmp_path / "layers")
    t.write.parquet(path)
    pos = frame(spark, np.random.default_rng(0).normal(size=(20, 5)))
    stored = synthetic_candidates(pos, pos, RunSpec(1, 0.1, "gan", gan_sampler="mlp", gan_params=path), 6).orderBy("gen_id").collect()
    given = synthetic_candidates(pos, pos, RunSpec(1, 0.1, "gan", gan_sampler="mlp", gan_layers=layers), 6).orderBy("gen_id").collect()
    assert stored == given and len(given) == 6


def brute(q, r, k):
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))
    order = np.lexsort((np.broadcast_to(np.arange(len(r)), d.shape), d), axis=-1)[:, :k]
    return {(i, j + 1): int(order[i, j]) for i in range(len(q)) for j in range(min(k, len(r)))}


@pytest.mark.parametrize("block", [512, 1 << 20])
def test_pivot_index_is_exact_and_rules_out_cells(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 4)) * 60
    q, r = (np.concatenate([c + rng.normal(size=(n, 4)) for c in centres]) for n in (20, 40))
    r = np.concatenate([r, np.repeat(r[:1], 90, axis=0)])  # one point with many copies
    got = {(x["q_id"], x["nbr_rank"]): x["nbr_id"] for x in kn.knn(frame(spark, q), frame(spark, r), 3, block_bytes=block).collect()}
    assert got == brute(q, r, 3)
    if block == 512:
        met = kn.pairs_met(frame(spark, q), frame(spark, r), 3, block_bytes=block)
        assert met["share"] < 0.35 and met["copies"] < 0.35 * met["all_copies"]


def test_pivot_index_odd_rows(spark):
    q = frame(spark, [[0, 0], [float("nan"), 1], [5, 5]])
    r = frame(spark, [[0, 1], [float("inf"), 0], [5, 6], [0, 1]])
    got = {(x["q_id"], x["nbr_rank"]): (x["nbr_id"], x["dist"]) for x in kn.knn(q, r, 2, pivots=2).collect()}
    assert got[0, 1] == (0, 1.0) and got[0, 2] == (3, 1.0) and got[2, 1] == (2, 1.0)
    assert kn.knn(q, r, 9).where("q_id = 0").count() == 4


def test_random_draws_are_independent_and_with_replacement(spark):
    tr = frame(spark, np.arange(82).reshape(41, 2), [1] * 40 + [0])
    syn = au.oversample_to_const(tr, 41 + 400, seed=3, draws="random").where("is_synth")
    assert sorted(int(r["uid"][3:]) for r in syn.collect()) == list(range(400))
    per = [r["count"] for r in syn.groupBy("src_row_id").count().collect()]
    assert sum(per) == 400 and max(per) - min(per) > 5  # dealt evenly, all would be 10
    one = au.oversample_to_const(tr.where("row_id IN (0, 40)"), 1002, draws="random").where("is_synth")
    assert one.where("features = array(0D, 1D) AND src_row_id = 0").count() == 1000


def test_grown_oversampling_draws_with_replacement(spark):
    rows = qa.q_oversample_grown(spark, "/root/testdata/sf0.01").groupBy("src_row_id").count().collect()
    per = [r["count"] for r in rows]
    assert max(per) - min(per) > 1
