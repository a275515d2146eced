"""Invariants and edge cases of the operators (reference semantics)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lowdata.functions.hashing import uniform
from lowdata.operators import augment as au
from lowdata.operators import evaluation as ev
from lowdata.operators import pairing as pa
from lowdata.operators import sampling as sa
from lowdata.operators import splits as sp
from lowdata.operators import thresholds as th
from lowdata.sources import fixtures as fx
from tests.conftest import MEDIUM, SMALL


def test_temporal_holdout_null_ts_is_train_and_scan_puts_it_in_test(spark):
    rows = [(1, 1, dt.datetime(2020, 1, 5)), (2, 0, None), (3, 1, dt.datetime(2020, 3, 1)), (4, 0, dt.datetime(2020, 2, 1))]
    df = spark.createDataFrame(rows, "row_id long, y int, ts timestamp")
    parts = {r.row_id: r.part for r in sp.temporal_holdout(df, "2020-02-01").collect()}
    assert parts == {1: "train", 2: "train", 3: "test", 4: "train"}
    scan = {r.cutoff.month: r for r in sp.scan_cutoffs(df, "2020-01-01", "2020-03-01").collect()}
    assert scan[2].train_n == 2 and scan[2].test_n == 2  # null ts counted on the test side
    assert scan[3].train_n == 3 and scan[3].test_pos == 0


def test_splits_disjoint_and_cover(spark):
    e = fx.events(spark, MEDIUM)
    s = sa.stratified_split(e, "y", 0.25, 42)
    c = s.groupBy("part").count().collect()
    assert sum(r["count"] for r in c) == e.count()
    n = e.count()
    assert {r.part: r["count"] for r in c}["test"] == -(-n // 4)
    assert s.select("row_id").distinct().count() == n


def test_scarce_quota_formula_and_floors(spark):
    d = fx.documents(spark, MEDIUM)
    p, q = d.filter("y = 1").count(), d.filter("y = 0").count()
    s = sa.scarce_sample(d, 0.01, 1, 5, 5)
    got = {r.y: r["count"] for r in s.groupBy("y").count().collect()}
    n_total = max(1, round(0.01 * (p + q)))
    n_pos = min(p, max(5, round(n_total * p / (p + q))))
    n_neg = min(q, max(5, n_total - n_pos))
    assert got == {1: n_pos, 0: n_neg}


def test_family_holdout_rejects_benign_and_family_verification(spark):
    d = fx.documents(spark, SMALL)
    with pytest.raises(ValueError):
        sp.family_holdout(d, ["benign"])
    v = sp.verify_family(sp.family_holdout(d, ["src3"])).first()
    assert v.ok and list(v.overlap) == []


def _train(spark, n_pos, n_neg, dim=3):
    rows = [(i, 1, [float(i), float(i % 3), 1.0][:dim]) for i in range(n_pos)]
    rows += [(1000 + i, 0, [float(-i), 0.5, 2.0][:dim]) for i in range(n_neg)]
    return spark.createDataFrame(rows, "row_id long, y int, features array<double>")


@pytest.mark.parametrize("n_pos", [0, 1, 2, 7])
def test_augmenters_reach_target(spark, n_pos):
    t = _train(spark, n_pos, 10)
    target = 40
    os_ = au.oversample_to_const(t, target, 3)
    assert os_.count() == (target if n_pos > 0 else 10 + n_pos)
    sm = au.smote_to_const(t, target, 3).drop("_nbr", "_t", "_draw")
    assert sm.count() == (target if n_pos > 0 else 10 + n_pos)
    if n_pos >= 2:
        syn = au.smote_to_const(t, target, 3).filter("is_synth").collect()
        assert all(0 < r._t < 1 for r in syn)


def test_smote_points_on_segments(spark):
    t = _train(spark, 6, 4)
    a = au.smote_to_const(t, 30, 5).filter("is_synth")
    pos = {r.row_id: r.features for r in t.filter("y = 1").collect()}
    for r in a.collect():
        xi, xj = pos[r.src_row_id], pos[r._nbr]
        assert r._nbr != r.src_row_id
        for a_, b_, x in zip(xi, xj, r.features):
            assert abs(x - (a_ + r._t * (b_ - a_))) < 1e-12


def test_rebalance_trims_majority_only(spark):
    t = au.as_train(_train(spark, 5, 20))
    r = sa.rebalance(t, 1.0, 1)
    assert {x.y: x["count"] for x in r.groupBy("y").count().collect()} == {1: 5, 0: 5}
    one = au.as_train(_train(spark, 0, 20))
    assert sa.rebalance(one, 1.0, 1).count() == 20


def _preds(spark, rows):
    return spark.createDataFrame(rows, "run string, y_true int, proba double")


def test_metrics_one_class_and_auc_ties(spark):
    p = _preds(spark, [("a", 0, 0.2), ("a", 0, 0.7), ("b", 1, 0.5), ("b", 0, 0.5), ("b", 1, 0.9), ("b", 0, 0.1)])
    out = {r.run: r for r in ev.evaluate(p, ["run"]).collect()}
    a = out["a"]
    assert a.auc is None and a.mcc is None and (a.tp, a.fp, a.fn, a.tn) == (0, 0, 0, 0)
    assert a.accuracy == 0.5 and a.specificity == 0.5 and a.balanced_accuracy == 0.5
    assert out["b"].auc == pytest.approx((1 + 0.5 + 1 + 1) / 4)


def test_auc_matches_pairwise_count(spark):
    d = spark.range(400).select(F.col("id"), (uniform(F.lit(1), F.col("id")) < 0.3).cast("int").alias("y_true"))
    d = d.withColumn("proba", F.round(uniform(F.lit(2), F.col("id")) * 0.7 + F.col("y_true") * 0.2, 2)).withColumn("run", F.lit("r"))
    rows = d.collect()
    pos = [r.proba for r in rows if r.y_true == 1]
    neg = [r.proba for r in rows if r.y_true == 0]
    exp = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = ev.ranking_metrics(d, ["run"]).first().auc
    assert got == pytest.approx(exp, abs=1e-12)


def test_pick_threshold_is_grid_optimum(spark):
    d = spark.range(300).select((uniform(F.lit(3), F.col("id")) < 0.4).cast("int").alias("y_true"), F.col("id"))
    d = d.withColumn("proba", F.round(uniform(F.lit(4), F.col("id")) * 0.8 + F.col("y_true") * 0.15, 3)).withColumn("run", F.lit("r"))
    rows = d.collect()
    best = None
    for i in range(1, 200):
        t = i * (1.0 / 200)
        tp = sum(1 for r in rows if r.y_true == 1 and r.proba >= t)
        fp = sum(1 for r in rows if r.y_true == 0 and r.proba >= t)
        fn = sum(1 for r in rows if r.y_true == 1 and r.proba < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        if best is None or f1 > best[1]:
            best = (t, f1)
    got = th.pick_threshold(d, "f1", 200, ["run"]).first()
    assert got.threshold == best[0] and got.score == pytest.approx(best[1])


def test_pooled_threshold_constant_scores(spark):
    p = spark.createDataFrame([("x", 0.01, "real", 1, 0.3), ("x", 0.01, "real", 0, 0.3)],
                              "prefix string, frac double, variant string, y_true int, proba double")
    r = th.pick_threshold_quantile(p).first()
    assert r.threshold == 0.5 and r.best_score is None


def test_apply_thresholds_keeps_runs_without_predictions(spark):
    raw = spark.createDataFrame([("p", 0.1, "real", "t1", 0.5, 0.1, 0.2, 0.3), ("p", 0.1, "real", "t2", 0.4, 0.9, 0.9, 0.9)],
                                "prefix string, frac double, variant string, tag string, threshold double, f1 double, "
                                "balanced_accuracy double, mcc double")
    preds = spark.createDataFrame([("t1", 1, 0.8), ("t1", 0, 0.2)], "tag string, y_true int, proba double")
    thr = th.pick_threshold_quantile(preds.withColumn("prefix", F.lit("q")).withColumn("frac", F.lit(0.1))
                                     .withColumn("variant", F.lit("real")))
    out = {r.tag: r for r in th.apply_thresholds(raw, thr, preds).collect()}
    assert out["t2"].f1 == 0.9 and out["t1"].f1 == 1.0


def test_pairing_null_keys_and_last_wins(spark):
    cols = "prefix string, kind string, frac double, seed int, variant string, const_train_size int, used_gan boolean, " \
           "test_start string, test_end string, test_window_days int, run_idx long, auc double, pr_auc double, " \
           "f1 double, balanced_accuracy double, mcc double"
    rows = [("p", "temporal", 0.1, 1, "real", None, False, None, None, None, 0, 0.6, 0.5, 0.4, 0.5, 0.1),
            ("p", "temporal", 0.1, 1, "gan", 100, True, None, None, None, 1, 0.7, 0.6, 0.5, 0.6, 0.2),
            ("p", "temporal", 0.1, 1, "gan", 100, True, None, None, None, 5, 0.8, 0.6, 0.5, 0.6, 0.2)]
    raw = spark.createDataFrame(rows, cols)
    p = pa.pair(raw).collect()
    assert len(p) == 1 and p[0].auc_real == 0.6 and p[0].auc_aug == 0.8
    assert p[0].delta_auc == pytest.approx(0.2)
    assert pa.pair(raw, compat=True).count() == 0  # the reference drops rows with null keys


def test_knn_exact_against_numpy(spark):
    import numpy as np
    e = fx.embeddings(spark, SMALL)
    q = e.filter("y = 0").limit(30)
    r = e.filter("y = 1")
    got = {(x.q_id, x.nbr_rank): x.nbr_id for x in __import__("lowdata.operators.knn", fromlist=["knn"]).knn(q, r, 2).collect()}
    qq = [(x.row_id, np.array(x.features)) for x in q.collect()]
    rr = [(x.row_id, np.array(x.features)) for x in r.collect()]
    for qid, qv in qq:
        d = sorted((float(np.sqrt(((qv - rv) ** 2).sum())), rid) for rid, rv in rr)
        assert got[(qid, 1)] == d[0][1] and got[(qid, 2)] == d[1][1]


def test_take_nearest_equals_sort_with_ties_infinities_and_nan(spark):
    from lowdata.operators.ranking import take_nearest
    d = [0.0, 0.0, 1e-300, 0.5, 0.5, 0.5, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(d)], "gen_id long, dist double")
    for n in range(len(d) + 2):
        want = [r.gen_id for r in df.orderBy("dist", "gen_id").limit(n).collect()]
        assert sorted(r.gen_id for r in take_nearest(df, n, "dist", "gen_id").collect()) == sorted(want)
    same = df.withColumn("dist", F.lit(0.0))
    assert sorted(r.gen_id for r in take_nearest(same, 3, "dist", "gen_id").collect()) == [0, 1, 2]


def test_position_follows_the_order(spark):
    from lowdata.operators.ranking import with_position
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(37))).repartition(7)
    got = with_position(df.orderBy("k", "id")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_quota_function_sees_group_sizes(spark):
    from lowdata.operators.ranking import take_first
    df = sa.with_u(spark.range(100).withColumn("row_id", F.col("id")).withColumn("g", F.when(F.col("id") < 90, "a").otherwise("b")), 1, "q")
    half = take_first(df, "g", lambda sizes: sizes.select("g", (F.col("n_c") / 2).alias("quota")))
    assert {r.g: r["count"] for r in half.groupBy("g").count().collect()} == {"a": 45, "b": 5}


def test_profile_and_scaler_of_vectors(spark):
    import numpy as np
    x = np.array([[1.0, 5.0, 0.0], [2.0, 5.0, -3.0], [4.0, 5.0, 8.0]])
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "features array<double>")
    s = au.fit_scaler(df).first()
    assert np.allclose(s.mean, x.mean(0)) and np.allclose(s.scale, [x[:, 0].std(), 1.0, x[:, 2].std()])
    p = au.profile_vectors(df).first()
    assert (p.dim, p.n_values, p.any_nonfinite) == (3, 9, False) and abs(p["std"] - x.std()) < 1e-12
    with pytest.raises(Exception):
        au.fit_scaler(df.where("false")).collect()


def test_audit_of_runs_counts_and_refuses_leaks(spark):
    members = spark.createDataFrame([(0, 1, "train"), (0, 1, "val"), (0, 2, "train"), (1, 2, "train"), (1, 3, "val"), (1, 9, "val"), (1, 9, "train")],
                                    "run_id int, row_id long, part string")
    sha = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (8, "b"), (9, "z")], "row_id long, sha string")
    test = sha.where("row_id >= 8")
    got = {r.run_id: r for r in sp.audit_runs(members, test, sha, strict=False).collect()}
    assert not got[0].ok and got[0].sha_overlap == 1 and got[0].train_test_overlap == 0 and got[0].val_not_in_train == 0
    assert (got[1].val_not_in_train, got[1].train_test_overlap, got[1].val_test_overlap, got[1].sha_overlap) == (1, 1, 1, 2)
    with pytest.raises(AssertionError):
        sp.audit_runs(members, test, sha)


def test_run_evaluation_refuses_leaks_and_takes_every_generator(spark):
    import numpy as np
    from lowdata.plans.evaluate import RunSpec, evaluate_runs
    rows = [(i, int(i % 4 == 0), [float(i % 7) + (i % 4 == 0), float(i % 5)], "train" if i % 3 else "test", f"s{i}") for i in range(120)]
    d = spark.createDataFrame(rows, "row_id long, y int, features array<double>, part string, sha string")
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(4, 2)), np.zeros(2))]
    base = dict(seed=1, frac=0.5, const_train_size=60, min_pos=5, min_neg=5, trees=5, depth=3)
    runs = [RunSpec(**base, variant="gan", gan_sampler="mlp", gan_layers=layers, gan_quality="nn_boundary", gan_boundary_low=0.1, tag="mlp"),
            RunSpec(**base, variant="oversample", tune={"n_estimators": [3, 5], "max_depth": [2]}, tag="tuned"),
            RunSpec(**base, variant="smote", val_source="real", tag="real_val")]
    metrics, audits = evaluate_runs(d, runs)
    a = {r.tag: r for r in audits.collect()}
    assert {r.tag for r in metrics.collect()} == {"mlp", "tuned", "real_val"} and all(r.ok for r in a.values())
    assert a["mlp"].n_train_synth == min(20, 2 * a["mlp"].audit.train_pos_before_aug) and a["tuned"].audit.ros_dup_ratio > 0
    assert a["real_val"].audit.smote_k_neighbors == 5 and a["real_val"].audit.smote_med_nn_dist >= 0
    leaky = d.withColumn("sha", F.lit("same"))
    with pytest.raises(AssertionError):
        evaluate_runs(leaky, runs[1:2])


@pytest.mark.parametrize("name", ["oversample_grown", "with_synth_grown", "dup_ratio_grown"])
def test_grown_oversample_draws_at_every_size(spark, duck, name):
    import __spark_entry__ as E
    from check_oracle import canon
    sf = "/root/testdata/sf0.1"
    df = E.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    rel = duck(sf).execute(E.oracle_sql()[name])
    assert canon(rows, df.columns) == canon(rel.fetchall(), [d[0] for d in rel.description])
    if name == "with_synth_grown":
        n = {synth: sum(r[2] for r in rows if r[0] == synth) for synth in (False, True)}
        assert n[True] == n[False] > 300
    elif name == "oversample_grown":
        assert len(rows) > 300
    else:
        assert 0.4 < rows[0][0] < 1


def test_temporal_runs_add_rows_at_every_size(spark, duck):
    import __spark_entry__ as E
    sf, name = "/root/testdata/sf0.1", "evaluate_runs_temporal_added_check"
    got = {tuple(r) for r in E.queries()[name](spark, sf).select("tag", "n_train_real", "aug_added").collect()}
    assert got == set(duck(sf).execute(E.oracle_sql()[name]).fetchall())
    assert all((added > 0) == (tag != "ev_r005_real") for tag, _, added in got)
