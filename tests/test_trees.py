"""Trees of a search grown inside tasks: the law, shared trees, layouts, spark.ml's format and what is left to spark.ml."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from lowdata.operators import model as md
from lowdata.operators import trees as tr

SETTINGS = [{"numTrees": 30, "maxDepth": 30}, {"numTrees": 12, "maxDepth": 4, "minInstancesPerNode": 1, "minSamplesSplit": 15},
            {"numTrees": 12, "maxDepth": 6, "minInstancesPerNode": 5}]


def samples(spark, n=400):
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.35).astype(int)
    return spark.createDataFrame([(i, int(y[i]), [float(v) for v in rng.normal(y[i], 1, 4)] + [float(i % 3)]) for i in range(n)],
                                 "row_id long, y int, features array<double>")


def scores(df, settings):
    return {(r["setting"], r["key"]): (r["fold"], r["y"], r["proba"]) for r in md.search_scores(df, settings, 3, 42).collect()}


def walk(tree, depth, min_split, row, level=0, at=0):
    """(leaf share, class said, is leaf) of the pruned and cut tree, node by node."""
    feature, cut, left, c, p, _ = (v[at] for v in tree.levels[level])

    def pruned(level, at):
        feature, _, left, c, p, _ = (v[at] for v in tree.levels[level])
        if feature < 0 or level == depth:
            return True
        return all(pruned(level + 1, left + s) for s in (0, 1)) and len({tree.levels[level + 1][4][left + s] * 2 > tree.levels[level + 1][3][left + s] for s in (0, 1)}) == 1
    if pruned(level, at) or c < min_split:
        return p / c
    return walk(tree, depth, min_split, row, level + 1, left + int(row[feature] > cut))


def test_trees_split_as_said():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (300, 6), dtype=np.uint8)
    y = (rng.random(300) < 0.2 + 0.06 * x[:, 2]).astype(np.int64)
    for least in (1, 6):
        tree = tr.Tree(x, y, np.random.default_rng([1, 2]), 12, 6, least)
        w = np.random.default_rng([1, 2]).poisson(1.0, 300)
        at = {0: np.arange(300)}
        for lv in tree.levels:
            feature, cut, left, c, p, gain = lv
            below = {}
            for n, rows in at.items():
                assert (c[n], p[n]) == (w[rows].sum(), (w * y)[rows].sum())
                gini = lambda r: w[r].sum() and 2 * (w * y)[r].sum() * (w * (1 - y))[r].sum() / w[r].sum()
                sides = [(rows[x[rows, f] <= b], rows[x[rows, f] > b]) for f in range(6) for b in range(9)]
                won = [gini(rows) - gini(a) - gini(z) for a, z in sides if min(w[a].sum(), w[z].sum()) >= least] + [0.0]
                if feature[n] >= 0:  # all features are tried here
                    assert abs(gain[n] * c[n] - max(won)) < 1e-6
                    below[left[n]], below[left[n] + 1] = rows[x[rows, feature[n]] <= cut[n]], rows[x[rows, feature[n]] > cut[n]]
                else:
                    assert max(won) < 1e-6 or lv is tree.levels[-1]
            at = below
        for depth, min_split in ((12, 2), (3, 2), (12, 30)):
            assert np.allclose(tree.shares(x, depth, min_split), [walk(tree, depth, min_split, r) for r in x])


def test_search_fits_no_forest_for_each_setting_and_fold(spark, monkeypatch):
    fits, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d, *a: fits.append(d.count()) or fit(self, d, *a))
    df = samples(spark)
    model, best, aucs = md.search(df, SETTINGS)
    assert not [n for n in fits if n > 2] and len(aucs) == 3 and min(aucs) > 0.7  # only the two rows whose forest lends its format
    assert model.getNumTrees == best["numTrees"] and model.getOrDefault("maxDepth") == best["maxDepth"]


def test_scores_depend_on_no_layout_and_no_other_setting(spark):
    df = samples(spark)
    all_, one = scores(df.repartition(7), SETTINGS), scores(df.coalesce(1), SETTINGS[1:2])
    assert len(all_) == 1200 and {k[1]: v for k, v in all_.items() if k[0] == 1} == {k[1]: v for k, v in one.items()}


def test_refitted_model_is_the_forest_of_its_nodes(spark):
    df = samples(spark)
    for setting in SETTINGS:
        model = md._refit(df, setting, 42, "row_id")
        d = md._rows(df, "row_id", F.lit(0))
        cuts = tr.thresholds(d)
        t = tr.binned(d, cuts, ["rid"]).toPandas().sort_values(["h", "h2"])
        x = np.stack([np.frombuffer(b, np.uint8) for b in t["x"]])
        trees = [tr._grow(x, t["y"].to_numpy(), 42, i, setting["maxDepth"], 3, setting.get("minInstancesPerNode", 1)) for i in range(setting["numTrees"])]
        mean = np.mean([g.shares(x, setting["maxDepth"], setting.get("minSamplesSplit", 2)) for g in trees], axis=0)
        want = {h: round(p, 9) for h, p in zip(t["h"], mean)}
        assert {r["h"]: round(r["proba"], 9) for r in md.score(model, df).withColumn("h", F.xxhash64("row_id")).select("h", "proba").collect()} == want


def test_like_spark_ml(spark, monkeypatch):
    """The same law: mean, spread and agreement with the labels near those of spark.ml's forests."""
    df = samples(spark, 1500)
    law = lambda: [tuple(r) for r in md.search_scores(df, SETTINGS).groupBy("setting").agg(
        F.avg("proba"), F.stddev("proba"), F.corr("proba", "y")).orderBy("setting").collect()]
    ours = law()
    monkeypatch.setattr(tr, "CELLS", 0)
    assert np.allclose(ours, law(), atol=0.02)


def test_odd_rows_are_left_to_spark_ml(spark):
    df = samples(spark, 60)
    fold = lambda d: md._rows(d, "row_id", F.lit(0))
    assert tr.fits(fold(df), 1) and not tr.fits(fold(df.where("y = 0")), 1) and not tr.fits(fold(df.limit(0)), 1)
    for odd in ("null", "array(1D, 2D)", "array(1D, 2D, 3D, 4D, double('NaN'))", "array(1D, 2D, 3D, 4D, null)"):
        assert not tr.fits(fold(df.withColumn("features", F.when(F.col("row_id") == 7, F.expr(odd)).otherwise(F.col("features")))), 1)
    with pytest.raises(Exception, match="(?i)null"):
        md.search_scores(df.withColumn("features", F.when(F.col("row_id") == 7, None).otherwise(F.col("features"))), SETTINGS[1:2]).count()
