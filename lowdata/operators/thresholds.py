"""Decision thresholds for many runs at once.

The reference re-scans every prediction once per grid threshold (199, 1999 or
up to 512 passes).  Here each run's predictions are reduced once to a
histogram over grid cells - cell(p) = number of grid points ``i/grid <= p`` -
and reverse cumulative counts give TP/FP at every grid point; the first
maximum of the objective wins (``max_by`` over ``(score, -i)``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowdata.functions.metrics import objective, point_metrics
from lowdata.operators.evaluation import count_where, run_key
from lowdata.operators.ranking import join_null_safe
from lowdata.operators.relational import exact_quantiles, sums_before, with_ranges
from lowdata.session import materialize


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def grid_cell(p, grid: int):
    """Number of thresholds ``t_i = i * (1/grid)``, 1 <= i < grid, with ``t_i <= p``."""
    step = 1.0 / grid
    p = F.col(p) if isinstance(p, str) else p
    c0 = F.least(F.greatest(F.floor(p * F.lit(float(grid))), F.lit(0)), F.lit(grid - 1))
    up = (c0 < grid - 1) & ((c0 + 1).cast("double") * F.lit(step) <= p)
    down = (c0 >= 1) & (c0.cast("double") * F.lit(step) > p)
    return (c0 + F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0)).cast("int")


def grid_counts(preds: DataFrame, by, grid: int = 200, y: str = "y_true", p: str = "proba",
                keep_key: bool = False, weight: str | None = None) -> DataFrame:
    """Per run and grid point i (1..grid-1): threshold, tp, fp, fn, tn at ``p >= i/grid``.

    Cell counts (one partial aggregate over the predictions) and zero-count grid
    points are unioned and swept by one reverse running sum per run.
    """
    keys = _keys(by)
    step = 1.0 / grid
    h = materialize(preds.groupBy(run_key(keys).alias("_k"), grid_cell(p, grid).alias("i")).agg(
        count_where(F.col(y) == 1, weight).alias("pos"), count_where(F.col(y) != 1, weight).alias("neg")))
    pts = (h.select("_k").distinct()
           .select("_k", F.explode(F.sequence(F.lit(1), F.lit(grid - 1))).alias("i"))
           .select("_k", "i", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"),
                   F.lit(1).alias("_pt")))
    u = h.withColumn("_pt", F.lit(0)).unionByName(pts)
    w_run = Window.partitionBy("_k")
    w = w_run.orderBy(F.col("i").desc(), F.col("_pt")).rowsBetween(Window.unboundedPreceding, 0)
    j = u.select("_k", "i", "_pt", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                 F.sum("pos").over(w_run).alias("P"), F.sum("neg").over(w_run).alias("N"))
    j = j.filter(F.col("_pt") == 1)
    out = j.select("_k", "i", (F.col("i").cast("double") * F.lit(step)).alias("threshold"),
                   "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    if keep_key:
        return out
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[c for c in out.columns if c != "_k"])


def pick_threshold(preds: DataFrame, which: str = "balacc", grid: int = 200, by=None,
                   y: str = "y_true", p: str = "proba", style: str = "sklearn", weight: str | None = None) -> DataFrame:
    """E5: best grid threshold per run for f1 / mcc / balacc; first maximum wins.

    Output: keys, threshold, score.
    """
    keys = _keys(by)
    g = grid_counts(preds, keys, grid, y, p, keep_key=True, weight=weight)
    g = g.withColumn("score", objective(which, "tp", "fp", "fn", "tn", style=style))
    best = g.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("_k").agg(
        F.max_by(F.struct("threshold", "score"), F.struct(F.col("score"), -F.col("i"))).alias("b"))
    return best.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("b.threshold").alias("threshold"),
                       F.col("b.score").alias("score"))


def rethreshold(raw: DataFrame, preds: DataFrame, metrics: Sequence[str] = ("f1", "balanced_accuracy", "mcc"),
                grid: int = 2000, tag: str = "tag", y: str = "y_true", p: str = "proba",
                weight: str | None = None) -> DataFrame:
    """Re-tune every run on its own test predictions (grid 2000): overwrite each metric
    with its best value and add ``{m}_thr_test``; runs without predictions are dropped."""
    g = grid_counts(preds, [tag], grid, y, p, weight=weight)
    # all objectives in one aggregate over the grid: first maximum per objective
    aggs = []
    for m in metrics:
        sc = objective(m, "tp", "fp", "fn", "tn", style="plain")
        aggs.append(F.max_by(F.struct(F.col("threshold"), sc.alias("score")), F.struct(sc, -F.col("i"))).alias(f"_b_{m}"))
    b = g.groupBy(tag).agg(*aggs)
    b = b.select(tag, *[x for m in metrics for x in (F.col(f"_b_{m}.score").alias(f"_{m}"),
                                                       F.col(f"_b_{m}.threshold").alias(f"{m}_thr_test"))])
    out = raw.join(b, on=tag, how="inner")
    for m in metrics:
        out = out.withColumn(m, F.col(f"_{m}")).drop(f"_{m}")
    return out


# ------------------------------------------------------------------ E7 / E8 pooled quantile grid

def quantile_levels(n_grid: int = 512, lo: float = 0.005, hi: float = 0.995) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n_grid)]


def pick_threshold_quantile(preds: DataFrame, keys: Sequence[str] = ("prefix", "frac", "variant"),
                            which: str = "balanced_accuracy", n_grid: int = 512,
                            y: str = "y_true", p: str = "proba", weight: str | None = None) -> DataFrame:
    """Pooled non-degenerate threshold per group.

    Grid = distinct exact quantiles at ``linspace(0.005, 0.995, n_grid)`` strictly
    inside (min, max); thresholds predicting one class only are skipped; strict
    improvement over -1 (first maximum).  Constant scores -> 0.5 with a null score; a best score
    below 0 (mcc) keeps its threshold and is reported as null.
    Output: keys, threshold, best_score, n_pos, n_neg.

    Quantiles and running counts are formed in value ranges, so no task holds a
    group's distinct scores.
    """
    keys = list(keys)
    lv = quantile_levels(n_grid)
    # one pass over the predictions: (group, score) counts; everything below works on them
    h = materialize(preds.groupBy(*keys, F.col(p).alias("value")).agg(
        count_where(F.col(y) == 1, weight).alias("pos"), count_where(F.col(y) != 1, weight).alias("neg")))
    total = F.col("pos") + F.col("neg")
    st = h.groupBy(*keys).agg(
        F.min("value").alias("pmin"), F.max("value").alias("pmax"),
        F.sum(total).alias("n"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    st = materialize(join_null_safe(st, exact_quantiles(h.withColumn("_n", total), keys, "value", lv, "_n")
                                    .select(*keys, F.col("_q").alias("qs")), keys))
    grid_pts = (st.select(*keys, "pmin", "pmax", F.explode(F.array_distinct("qs")).alias("value"))
                .filter((F.col("value") > F.col("pmin")) & (F.col("value") < F.col("pmax")))
                .select(*keys, "value", F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.lit(1).alias("is_grid")))
    u = with_ranges(h.withColumn("is_grid", F.lit(0)).unionByName(grid_pts), keys, "value", of=h)
    u = sums_before(u, keys, ["value", "is_grid"], ["pos", "neg"], desc=True)  # a grid point comes after the rows at its value
    c = u.select(*keys, "value", "is_grid", F.col("pos_before").alias("tp"), F.col("neg_before").alias("fp"))
    c = join_null_safe(c.filter(F.col("is_grid") == 1), st.select(*keys, "n", "n_pos", "n_neg"), keys, "inner")
    c = c.filter((F.col("tp") + F.col("fp") > 0) & (F.col("tp") + F.col("fp") < F.col("n")))
    c = c.withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("tn", F.col("n_neg") - F.col("fp"))
    c = c.withColumn("score", objective(which, "tp", "fp", "fn", "tn")).filter(F.col("score") > -1.0)
    best = c.groupBy(*keys).agg(F.max_by(F.struct("value", "score"),
                                         F.struct(F.col("score"), -F.col("value"))).alias("b"))
    out = join_null_safe(st.select(*keys, "n_pos", "n_neg"), best, keys, "left")
    return out.select(*keys, F.coalesce(F.col("b.value"), F.lit(0.5)).alias("threshold"),
                      F.when(F.col("b.score") >= 0, F.col("b.score")).alias("best_score"), "n_pos", "n_neg")


def apply_thresholds(raw: DataFrame, thr: DataFrame, preds: DataFrame,
                     keys: Sequence[str] = ("prefix", "frac", "variant"), tag: str = "tag",
                     y: str = "y_true", p: str = "proba", weight: str | None = None) -> DataFrame:
    """E8 + J9: apply pooled thresholds back to each run (fallback: own threshold, else 0.5)
    and recompute f1 / balanced_accuracy / mcc; runs without predictions keep their row."""
    keys = list(keys)
    r = raw.join(thr.select(*keys, F.col("threshold").alias("_pooled")), on=keys, how="left")
    r = r.withColumn("_t", F.coalesce("_pooled", "threshold", F.lit(0.5)))
    # (run, score) counts meet the thresholds, not every prediction
    h = preds.groupBy(tag, F.col(p).alias("_p")).agg(
        count_where(F.col(y) == 1, weight).alias("_pos"), count_where(F.col(y) != 1, weight).alias("_neg"))
    total = lambda n, cond: F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0)).cast("long")
    above, below = F.col("_p") >= F.col("_t"), F.col("_p") < F.col("_t")
    cm = h.join(r.select(tag, "_t"), on=tag, how="inner").groupBy(tag).agg(
        total("_pos", above).alias("tp"), total("_neg", above).alias("fp"), total("_pos", below).alias("fn"), total("_neg", below).alias("tn"))
    m = point_metrics("tp", "fp", "fn", "tn", mcc_one_class_null=False)
    cm = cm.select(tag, F.lit(True).alias("_has"), m["f1"].alias("_f1"),
                   m["balanced_accuracy"].alias("_ba"), m["mcc"].alias("_mcc"))
    o = r.join(cm, on=tag, how="left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    o = (o.withColumn("threshold", F.when(has, F.col("_t")).otherwise(F.col("threshold")))
         .withColumn("f1", F.when(has, F.col("_f1")).otherwise(F.col("f1")))
         .withColumn("balanced_accuracy", F.when(has, F.col("_ba")).otherwise(F.col("balanced_accuracy")))
         .withColumn("mcc", F.when(has, F.col("_mcc")).otherwise(F.col("mcc"))))
    return o.drop("_pooled", "_t", "_has", "_f1", "_ba", "_mcc")


__all__ = ["grid_cell", "grid_counts", "pick_threshold", "rethreshold", "quantile_levels",
           "pick_threshold_quantile", "apply_thresholds"]
