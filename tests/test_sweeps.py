"""Run ledger, resumed sweeps, quarantined lines, bucketed predictions, search and bootstrap details."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowdata.operators import model as md
from lowdata.operators import report as rp
from lowdata.operators import thresholds as th
from lowdata.operators import evaluation as ev
from lowdata.plans.evaluate import RunSpec, evaluate_runs
from lowdata.session import scratch_path
from lowdata.sources import io
from lowdata.sources.ledger import RunLedger


def samples(spark, n=240):
    rng = np.random.default_rng(4)
    y = (rng.random(n) < 0.4).astype(int)
    return spark.createDataFrame([(i, int(y[i]), [float(v) for v in rng.normal(y[i], 1, 3)], f"s{i}", "train" if i % 4 else "test") for i in range(n)],
                                 "row_id long, y int, features array<double>, sha string, part string")


def test_ledger_counts_every_run_once(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([(v, 1.0 * v)], "tag int, auc double")
    a, b = RunLedger(spark, str(tmp_path)), RunLedger(spark.newSession(), str(tmp_path))
    assert a.commits().count() == 0 and a.finished() == {}
    assert [a.append(rows(1), "one"), b.append(rows(2), "two"), a.append(rows(3), "three", {"k": 1}), b.append(rows(4), "one")] == [0, 1, 2, 3]
    got = {(r["run_id"], r["tag"], r["run_idx"]) for r in RunLedger(spark, str(tmp_path)).read().collect()}
    assert got == {("two", 2, 1), ("three", 3, 2), ("one", 4, 3)}
    rows(9).write.parquet(a.attempt_path("lost"))  # written, never committed
    (tmp_path / "commits" / "0000000004.json").write_text('{"seq": 4, "run_')  # a commit that broke off
    assert a.read().count() == 3 and a.finished()["three"]["facts"] == {"k": 1}
    assert a.append(rows(5), "four") == 5


def test_resumed_sweep_fits_only_what_is_missing(spark, tmp_path, monkeypatch):
    runs = [RunSpec(seed=s, frac=0.5, variant=v, const_train_size=120, min_pos=10, min_neg=10, trees=3, depth=3, tag=f"r{s}_{v}")
            for s in (1, 2) for v in ("real", "oversample")]
    d = samples(spark)
    plain, _ = evaluate_runs(d, runs)
    ledger = RunLedger(spark, str(tmp_path / "sweep"))
    fits = []
    real_fit = md.fit_run

    def fit(*a, **k):
        if len(fits) == 3:
            raise RuntimeError("driver lost")
        fits.append(1)
        return real_fit(*a, **k)
    monkeypatch.setattr(md, "fit_run", fit)
    with pytest.raises(RuntimeError, match="driver lost"):
        evaluate_runs(d, runs, ledger=ledger, parallelism=1)
    assert len(ledger.finished()) == 3
    fits.clear()
    metrics, audits = evaluate_runs(d, runs, ledger=RunLedger(spark, str(tmp_path / "sweep")), parallelism=1)
    assert len(fits) == 1 and audits.count() == 4
    cols = ["run_id", "tag", "threshold", "n_pos", "tp", "fp", "auc"]
    assert sorted(map(tuple, metrics.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))
    fits.clear()
    again, _ = evaluate_runs(d, runs[:2], ledger=ledger)
    assert not fits and again.count() == 2


def test_refused_lines_and_kept_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prefix,frac,variant,used_gan,tag,auc,tp\np,0.1,real,no,t1,nan,3\np,0.1,real,TRUE ,t2,0.5,\np,x,real,no,t3,0.5,1\n"
                                    "p,0.1,real,no,t4,0.5,1,9\np,0.1\np,0.1,real,perhaps,,0.5,1\np,0.2,gan,1,\"t,5\",0.25,7\n")
    kept, refused = io.read_raw_checked(spark, str(tmp_path))
    assert {(r["tag"], r["auc"], r["tp"], r["used_gan"]) for r in kept.collect()} == {("t1", None, 3, False), ("t2", 0.5, None, True), ("t,5", 0.25, 7, True)}
    assert sorted((r["line"], tuple(r["reasons"])) for r in refused.collect()) == [
        ("p,0.1", ("fields",)), ("p,0.1,real,no,t4,0.5,1,9", ("fields",)), ("p,0.1,real,perhaps,,0.5,1", ("no tag", "boolean used_gan")),
        ("p,x,real,no,t3,0.5,1", ("number frac",))]


def test_bucketed_predictions_are_not_shuffled(spark):
    preds = spark.range(4000).select(F.concat(F.lit("run"), F.col("id") % 13).alias("tag"), (F.col("id") % 3 == 0).cast("int").alias("y_true"),
                                     ((F.col("id") * 7919) % 101 / 100).alias("proba"))
    t = io.write_preds_bucketed(preds, "bucketed_preds_test", scratch_path(spark, "bucketed-preds-test"), 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (t.groupBy("tag", "proba").agg(F.count("*")), th.pick_threshold(t, "f1", 50, "tag").limit(0)):
        df.collect()
    assert "Exchange" not in plan(t.groupBy("tag", "proba").agg(F.count("*")))
    raw = preds.select("tag").distinct().select("tag", F.lit("p").alias("prefix"), F.lit(0.1).alias("frac"), F.lit("real").alias("variant"),
                                                F.lit(0.3).alias("threshold"), F.lit(0.0).alias("f1"), F.lit(0.0).alias("balanced_accuracy"), F.lit(0.0).alias("mcc"))
    thr = spark.createDataFrame([("p", 0.1, "real", 0.5)], "prefix string, frac double, variant string, threshold double")
    a, b = (th.apply_thresholds(raw, thr, x).orderBy("tag").collect() for x in (t, preds))
    assert a == b
    counted = th.apply_thresholds(raw, thr, t)
    scan = plan(counted).split("bucketed_preds_test")[0].rsplit("Join", 1)[-1]
    assert "Exchange hashpartitioning(tag" not in scan
    spark.sql("drop table bucketed_preds_test")


def test_cut_forest_scores_like_a_forest_grown_with_the_limit(spark):
    d = samples(spark).withColumn("y", F.col("y").cast("double"))
    full = md.forest(1, None, 3).fit(md.with_vector(d))
    cut = md.cut_small_splits(full, 30, spark)
    assert cut.trees[0].numNodes < full.trees[0].numNodes
    text = cut.toDebugString
    assert text.count("If") < full.toDebugString.count("If")
    assert md.cut_small_splits(full, 2, spark) is full
    # cutting everything leaves the share of positives in the tree's sample
    stump = md.cut_small_splits(full, 10 ** 6, spark)
    assert stump.trees[0].numNodes == 1 and md.score(stump, d).select("proba").distinct().count() == 1


def test_bootstrap_by_weights(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(0.5, 1, 300))] + [("b", i, 0.25) for i in range(3)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, pair_id int, delta_auc double")
    out = rp.delta_bootstrap(df, "auc", ["g"], 800, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = {r["g"]: r for r in out.collect()}
    x = np.array([r[2] for r in rows if r[0] == "a"])
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert set(got) == {"a", "b"} and got["a"]["n"] == 300 and np.isclose(got["a"]["delta_mean"], x.mean())
    assert abs(got["a"]["ci_low"] - (x.mean() - half)) < 0.25 * half and abs(got["a"]["ci_high"] - (x.mean() + half)) < 0.25 * half
    assert np.isclose(got["b"]["ci_low"], 0.25) and np.isclose(got["b"]["ci_high"], 0.25) and got["b"]["stars"] == "***"
    w = spark.range(400).select(F.explode(rp._weights(250, F.lit("s"), F.col("id").cast("string"))).alias("w")).groupBy("w").count().collect()
    n = sum(r["count"] for r in w)
    assert n == 100_000 and abs(sum(r["w"] * r["count"] for r in w) / n - 1) < 0.02


def test_ranking_metrics_of_a_peaked_run(spark):
    """Scores that differ in the ninth digit: the ranges are cut from the data, so they don't share one."""
    n = 4000
    p = spark.range(n).select(F.lit("r").alias("tag"), (F.col("id") % 5 == 0).cast("int").alias("y_true"), (F.lit(0.25) + (F.col("id") * 7919) % n * 1e-9).alias("proba"))
    h = ev.score_histogram(p, ["tag"])
    assert h.count() == n
    ranges = ev.with_ranges(p.withColumn("_k", F.struct("tag")), ["_k"], "proba").groupBy("_range").count()
    assert ranges.agg(F.max("count")).first()[0] < n / 40
    pdf = p.toPandas().sort_values("proba")
    rank = np.arange(1, n + 1)
    pos = pdf["y_true"].to_numpy() == 1
    exact = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert np.isclose(ev.ranking_metrics(p, ["tag"]).first()["auc"], exact)


def test_forest_keeps_node_ids_and_grows_the_same_trees(spark):
    """without the kept ids every level sent all trees to every task."""
    d = md.with_vector(samples(spark).withColumn("y", F.col("y").cast("double")).repartition(3, "row_id").localCheckpoint())
    kept = md.forest(6, None, 42)
    assert kept.getCacheNodeIds()
    trees = lambda m: m.toDebugString.split("\n", 1)[1]  # noqa: E731  the first line names the model
    assert trees(kept.fit(d)) == trees(kept.copy({kept.cacheNodeIds: False}).fit(d))


def test_predictions_meet_their_runs_settings_without_a_shuffle(spark, monkeypatch):
    """the join on the run dealt all predictions by run, so that one task held all of a run."""
    seen, evaluate = [], ev.evaluate
    monkeypatch.setattr(ev, "evaluate", lambda preds, *a, **k: seen.append(preds) or evaluate(preds, *a, **k))
    runs = [RunSpec(seed=1, frac=0.5, min_pos=10, min_neg=10, trees=3, depth=3, tag=t) for t in ("a", "b")]
    metrics, _ = evaluate_runs(samples(spark, 4000), [*runs, runs[0]])
    assert metrics.count() == 3
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "hashpartitioning" not in plan  # the settings are the small side
