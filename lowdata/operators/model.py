"""Model fit and score with spark.ml (M1-M8).

The forest is spark.ml's distributed ``RandomForestClassifier``; features stay
an ``ARRAY<DOUBLE>`` column and become a vector only at this boundary
(``array_to_vector``).  Scores are ``probability[1]``.  Validation thresholds
use the exact grid sweep (E5), cross-validation folds the exact hash folds
(D16); hyper-parameter search scores every setting out of fold and computes all AUCs in one job, its trees are grown
whole inside tasks (``trees``) where a task can hold the rows.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowdata.operators import evaluation as ev
from lowdata.operators import sampling as sa
from lowdata.operators import thresholds as th
from lowdata.operators import trees as tr
from lowdata.session import cut_lineage, materialize, scratch_path

MAX_DEPTH_SPARK = 30  # spark.ml rejects deeper trees; "unlimited" maps here

# Grid-search presets (trees x depth; None = unlimited).
GRID_PRESETS = {
    "light": {"n_estimators": [200, 400], "max_depth": [None, 20]},
    "medium": {"n_estimators": [300, 600], "max_depth": [None, 16, 24]},
    "heavy": {"n_estimators": [400, 800], "max_depth": [None, 14, 20, 28]},
}


def depth_of(d) -> int:
    return MAX_DEPTH_SPARK if d is None else min(int(d), MAX_DEPTH_SPARK)


def with_vector(df: DataFrame, features: str = "features", out: str = "fvec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features)))


def with_class_weight(df: DataFrame, y: str = "y", mode: str | None = "balanced", out: str = "weight") -> DataFrame:
    """M2: ``balanced`` -> n / (2 * n_class) per row, else 1.0 (class counts via a window-free join)."""
    if mode in (None, "none"):
        return df.withColumn(out, F.lit(1.0))
    cnt = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(F.broadcast(cnt), on=y, how="left")  # one row per class
    d = d.withColumn("_n", n.select("_n").scalar())
    return d.withColumn(out, F.col("_n").cast("double") / (F.lit(2.0) * F.col("_nc"))).drop("_nc", "_n")


def forest(trees: int = 100, depth=None, seed: int = 42, weighted: bool = False,
           min_leaf: int = 1) -> RandomForestClassifier:
    """M1: spark.ml random forest with the reference's knobs.

    For deep trees every row's node in every tree is kept between levels: the same trees, but no level sends all trees
    grown so far to every task and walks each row down them from the root.
    """
    rf = RandomForestClassifier(featuresCol="fvec", labelCol="y", numTrees=int(trees), maxDepth=depth_of(depth),
                                seed=int(seed), minInstancesPerNode=int(min_leaf), cacheNodeIds=depth_of(depth) > 10)
    if weighted:
        rf = rf.setWeightCol("weight")
    return rf


def fit_forest(df: DataFrame, trees: int = 100, depth=None, seed: int = 42, class_weight: str | None = None,
               features: str = "features", y: str = "y"):
    d = with_vector(df, features)
    d = d.withColumn("y", F.col(y).cast("double"))
    if class_weight == "balanced":
        d = with_class_weight(d, "y", "balanced")
    return forest(trees, depth, seed, weighted=class_weight == "balanced").fit(d)


def score(model, df: DataFrame, threshold: float = 0.5, features: str = "features") -> DataFrame:
    """M3: ``proba`` = P(y = 1), ``y_pred = proba >= threshold``."""
    s = model.transform(with_vector(df, features))
    s = s.withColumn("proba", vector_to_array("probability")[1])
    return s.withColumn("y_pred", (F.col("proba") >= F.lit(float(threshold))).cast("int")).drop(
        "fvec", "rawPrediction", "probability", "prediction")


@dataclass
class Fitted:
    """A run's model, its decision threshold and the validation rows ``(uid, row_id, y, proba)`` (None: no valid split)."""
    model: object
    threshold: float
    val: DataFrame | None


def fit_run(df: DataFrame, objective: str | None = "balacc", seed: int = 42, trees: int = 100, depth=None,
            class_weight: str | None = None, tune: str | dict | None = None, val_source: str = "augmented",
            key: str = "uid") -> Fitted:
    """M4 (and M6 first with ``tune``): fit on 80% -> choose the threshold on the 20% validation part (E5,
    grid 200) -> refit on everything.  No valid split -> threshold 0.5.

    ``val_source="real"`` validates on real rows only; synthetic rows made from one of those are then left out of the first fit.
    """
    if tune:
        preset, grid = (tune, None) if isinstance(tune, str) else ("light", tune)
        _, best, _ = grid_search(df, preset, 3, seed, grid=grid, key=key)
        trees, depth = best["numTrees"], best["maxDepth"]
    if objective in (None, "none"):
        return Fitted(fit_forest(df, trees, depth, seed, class_weight), 0.5, None)
    if val_source == "real":
        v = cut_lineage(sa.val_split(df.filter(~F.col("is_synth")), "y", seed, 0.2, key))
        val = v.filter(F.col("part") == "val").drop("part")
        held = val.select(F.col("row_id").alias("src_row_id"))
        fit_on = v.filter(F.col("part") == "train").drop("part").unionByName(
            df.filter("is_synth").join(held, "src_row_id", "left_anti").select(*df.columns))
    else:
        v = cut_lineage(sa.val_split(df, "y", seed, 0.2, key))
        val, fit_on = v.filter(F.col("part") == "val").drop("part"), v.filter(F.col("part") == "train").drop("part")
    if val.isEmpty():
        return Fitted(fit_forest(df, trees, depth, seed, class_weight), 0.5, None)
    first = fit_forest(fit_on, trees, depth, seed, class_weight)
    scored = cut_lineage(score(first, val).select("uid", "row_id", "y", "proba"))
    best = th.pick_threshold(scored.withColumn("y_true", F.col("y").cast("int")), objective, 200).first()
    threshold = float(best["threshold"]) if best is not None else 0.5
    return Fitted(fit_forest(df, trees, depth, seed, class_weight), threshold, scored)


def fit_with_threshold(df: DataFrame, objective: str = "balacc", seed: int = 42, trees: int = 100, depth=None,
                       class_weight: str | None = None, key: str = "uid"):
    """M4 as (model, threshold)."""
    fitted = fit_run(df, objective, seed, trees, depth, class_weight, key=key)
    return fitted.model, fitted.threshold


def cv_scores(df: DataFrame, k: int = 5, seed: int = 42, trees: int = 100, depth=None, key: str = "row_id") -> DataFrame:
    """M5: every row scored by the model of the other folds: ``fold, row_id, y, proba, y_pred``."""
    folds = materialize(sa.stratified_folds(df, "y", k, seed, key))
    parts = []
    for f in range(k):
        m = fit_forest(folds.filter(F.col("fold") != f), trees, depth, seed)
        parts.append(score(m, folds.filter(F.col("fold") == f)).select("fold", key, "y", "proba", "y_pred"))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, k: int = 5, seed: int = 42, trees: int = 100, depth=None,
                   key: str = "row_id") -> DataFrame:
    """M5: stratified k-fold CV; mean and population std of accuracy, F1 and exact AUC."""
    preds = cv_scores(df, k, seed, trees, depth, key).withColumn("y_true", F.col("y").cast("int"))
    per = ev.evaluate(preds, ["fold"])
    return per.agg(*[x for m in ("accuracy", "f1", "auc")
                     for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


# ------------------------------------------------------------------ min samples split

def forest_nodes(path: str, spark: SparkSession) -> DataFrame:
    """Nodes of a saved forest: ``treeID`` and ``nodeData`` (id, rawCount: rows of the tree's sample, children, ...)."""
    return spark.read.parquet(f"{path}/data")


def cut_small_splits(model, min_split: int, spark: SparkSession | None = None):
    """The forest with every node of fewer than ``min_split`` rows made a leaf (M7's min samples split).

    spark.ml has no such setting, but a split doesn't depend on what is below it: cutting the fitted trees gives the
    trees that would have been grown.  The saved node table is rewritten (ids stay, what hangs below a new leaf is
    never reached) and the forest read again.
    """
    if min_split <= 2:
        return model
    spark = spark or SparkSession.getActiveSession()
    path, cut = (scratch_path(spark, f"forest-{uuid.uuid4().hex}") for _ in range(2))
    model.write().overwrite().save(path)
    model.write().overwrite().save(cut)
    nodes = forest_nodes(path, spark)
    small = F.col("nodeData.rawCount") < min_split
    leaf = F.lit(-1)
    node = F.struct(*[F.when(small, leaf).otherwise(F.col(f"nodeData.{c}")).cast("int").alias(c) if c in ("leftChild", "rightChild")
                      else F.col(f"nodeData.{c}").alias(c) for c in nodes.schema["nodeData"].dataType.names])
    nodes.select(*[node.alias(c) if c == "nodeData" else F.col(c) for c in nodes.columns]).write.mode("overwrite").parquet(f"{cut}/data")
    return load_model(cut)


# ------------------------------------------------------------------ M6 / M7 search

def _folded(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """Labels and folds that every fit of a search reads, computed once."""
    return materialize(_rows(sa.stratified_folds(df, "y", k, seed, key), key, F.col("fold")))


def _rows(df: DataFrame, key: str, fold) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"),
                     fold.alias("fold"), F.monotonically_increasing_id().alias("rid"))


def _fit_setting(d: DataFrame, setting: dict, seed: int):
    rf = forest(setting["numTrees"], setting["maxDepth"], seed, min_leaf=setting.get("minInstancesPerNode", 1))
    m = rf.fit(with_vector(d))
    least = setting.get("minSamplesSplit", 2)  # a split leaves min_leaf rows on both sides anyway
    return cut_small_splits(m, least, d.sparkSession) if least > 2 * setting.get("minInstancesPerNode", 1) else m


class StoredForest:
    """A forest on shared storage in spark.ml's format; spark.ml's model is read, and held by the driver, when it is first used."""

    def __init__(self, path: str):
        self.path, self.model = path, None

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        if self.model is None:
            self.model = load_model(self.path)
        return getattr(self.model, name)


def forest_of_nodes(nodes: DataFrame, setting: dict, seed: int, width: int):
    """spark.ml's model of a table of ``trees.forest_nodes``: an unsplit forest of the same settings, saved, with these nodes."""
    spark = nodes.sparkSession
    rf = forest(setting["numTrees"], setting["maxDepth"], seed, min_leaf=setting.get("minInstancesPerNode", 1))
    two = spark.createDataFrame([(y, [0.0] * width) for y in (0.0, 1.0)], "y double, features array<double>")
    bare = rf.fit(with_vector(two))
    path, base = (scratch_path(spark, f"forest-{uuid.uuid4().hex}") for _ in range(2))
    bare.write().overwrite().save(base)
    bare.write().overwrite().save(path)
    like = forest_nodes(base, spark).schema
    c, p = F.col("c"), F.col("p")
    inner = F.col("feature") >= 0
    of = {"id": F.col("id"), "prediction": F.when(p > c - p, 1.0).otherwise(0.0), "impurity": 1 - (p / c) * (p / c) - ((c - p) / c) * ((c - p) / c),
          "impurityStats": F.array(c - p, p), "rawCount": c, "gain": F.col("gain"), "leftChild": F.col("left"), "rightChild": F.col("right"),
          "split": F.struct(F.col("feature").alias("featureIndex"), F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                            F.lit(-1).alias("numCategories"))}
    node = F.struct(*[of[f.name].cast(f.dataType).alias(f.name) for f in like["nodeData"].dataType.fields])
    (nodes.select(*[node.alias(f.name) if f.name == "nodeData" else F.col(f.name).cast(f.dataType) for f in like.fields])
     .write.mode("overwrite").parquet(f"{path}/data"))
    return StoredForest(path)


def _refit(df: DataFrame, setting: dict, seed: int, key: str):
    """The model of one setting on all rows."""
    d = materialize(_rows(df, key, F.lit(0)))
    if not tr.fits(d, 1):
        return _fit_setting(df.withColumn("y", F.col("y").cast("double")), setting, seed)
    width = d.select(F.size("features")).first()[0]
    return forest_of_nodes(tr.forest_nodes(d, setting, seed), setting, seed, width)


def search_scores(df: DataFrame, settings: Sequence[dict], k: int = 3, seed: int = 42, parallelism: int = 2, key: str = "row_id") -> DataFrame:
    """``setting, fold, key, y, proba``: every row scored by every setting's model of the other folds.

    Trees are grown whole inside tasks where a task can hold the rows (``trees.fits``).  Else spark.ml fits them: a few fits run at
    a time; each writes its scores into a folder of its own, so a repeated fit replaces itself.
    """
    spark = df.sparkSession
    d = _folded(df, k, seed, key)
    if tr.fits(d, k):
        return materialize(tr.out_of_fold(d, settings, k, seed))
    base = scratch_path(spark, f"search-{uuid.uuid4().hex}")

    def one(job: tuple[int, int]) -> None:
        i, f = job
        m = _fit_setting(d.filter(F.col("fold") != f), settings[i], seed)
        s = score(m, d.filter(F.col("fold") == f)).select("key", "y", "proba")
        s.write.mode("overwrite").parquet(f"{base}/setting={i}/fold={f}")
    with ThreadPool(max(1, parallelism)) as pool:
        pool.map(inheritable_thread_target(spark)(one), [(i, f) for i in range(len(settings)) for f in range(k)], chunksize=1)
    return spark.read.parquet(base).select("setting", "fold", "key", F.col("y").cast("int").alias("y"), "proba")


def search(df: DataFrame, settings: Sequence[dict], k: int = 3, seed: int = 42, parallelism: int = 2, key: str = "row_id"):
    """(model of the best setting refitted on all rows, the setting, mean AUC of every setting); exact AUCs of all
    settings and folds from one grouped job, first best setting wins."""
    scores = search_scores(df, settings, k, seed, parallelism, key).withColumnRenamed("y", "y_true")
    mean = {r["setting"]: r["auc"] for r in ev.ranking_metrics(scores, ["setting", "fold"]).groupBy("setting").agg(F.avg("auc").alias("auc")).collect()}
    aucs = [mean.get(i) if mean.get(i) is not None else float("nan") for i in range(len(settings))]
    best = max(range(len(settings)), key=lambda i: (aucs[i] == aucs[i], aucs[i], -i))
    return _refit(df, settings[best], seed, key), settings[best], aucs


def grid_settings(preset: str = "light", grid: dict | None = None) -> list[dict]:
    """M6 settings: trees x depth of a preset, or of a given grid."""
    p = grid or GRID_PRESETS[preset]
    return [{"numTrees": t, "maxDepth": depth_of(d)} for t in p["n_estimators"] for d in p["max_depth"]]


def grid_search(df: DataFrame, preset: str = "light", k: int = 3, seed: int = 42, parallelism: int = 2,
                grid: dict | None = None, key: str = "row_id"):
    """M6: cross-validated search over a preset (or explicit) grid, exact AUC, hash folds."""
    return search(df, grid_settings(preset, grid), k, seed, parallelism, key)


def random_params(n_iter: int = 20, seed: int = 42) -> list[dict]:
    """M7 parameter draws: trees 50-199, depth {None, 10..100 step 10} (clipped to 30), min leaf 1-10, min samples split 2-10."""
    rng = random.Random(seed)
    depths = [None] + list(range(10, 101, 10))
    drawn = [{"numTrees": rng.randint(50, 199), "maxDepth": depth_of(rng.choice(depths)),
              "minInstancesPerNode": rng.randint(1, 10)} for _ in range(n_iter)]
    return [{**p, "minSamplesSplit": rng.randint(2, 10)} for p in drawn]


def random_search(df: DataFrame, n_iter: int = 20, k: int = 3, seed: int = 42, parallelism: int = 2, frac: float = 0.2):
    """M7: random search on a stratified share ``frac`` of the rows (D15), scored by exact cross-validated AUC."""
    return search(sa.stratified_sample(df, "y", frac, seed) if frac < 1 else df, random_params(n_iter, seed), k, seed, parallelism)


def fit_final(df: DataFrame, path: str, trees: int = 100, depth=None, seed: int = 42):
    """M8 + S17: refit on everything and save with spark.ml's writer."""
    m = fit_forest(df, trees, depth, seed)
    m.write().overwrite().save(path)
    return m


def load_model(path: str):
    from pyspark.ml.classification import RandomForestClassificationModel
    return RandomForestClassificationModel.load(path)


__all__ = ["GRID_PRESETS", "depth_of", "Fitted", "with_class_weight", "forest", "fit_forest", "score", "fit_run", "fit_with_threshold",
           "cv_scores", "cross_validate", "forest_nodes", "cut_small_splits", "StoredForest", "forest_of_nodes", "search_scores", "search", "grid_settings", "grid_search", "random_params", "random_search", "fit_final", "load_model"]
