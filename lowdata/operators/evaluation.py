"""Evaluation metrics for many runs at once.

Predictions are one long table ``(run keys..., y_true, proba[, threshold])``;
every metric is a grouped aggregate over it, so thousands of runs cost one
job.  Ranking metrics (ROC AUC, average precision) come from a per-run score
histogram plus an exact two-level cumulative sum (ranges cut from the run's scores give the
offsets, a window inside each range gives the rest), so no run's scores are
ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.functions.metrics import point_metrics
from lowdata.operators.relational import sums_before, with_ranges
from lowdata.session import materialize


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def confusion(preds: DataFrame, by, y: str = "y_true", p: str = "proba",
              threshold=0.5, pred: str | None = None) -> DataFrame:
    """Per-run counts ``n_pos, n_neg, tp, fp, fn, tn`` at ``proba >= threshold``.

    ``threshold`` is a number or a column name; ``pred`` uses a stored 0/1
    prediction column instead.
    """
    keys = _keys(by)
    if pred:
        yhat = F.col(pred) == 1
    else:
        t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
        yhat = F.col(p) >= t
    pos = F.col(y) == 1
    agg = preds.groupBy(*keys).agg(
        F.count_if(pos).alias("n_pos"),
        F.count_if(~pos).alias("n_neg"),
        F.count_if(pos & yhat).alias("tp"),
        F.count_if(~pos & yhat).alias("fp"),
    )
    return agg.select(*keys, "n_pos", "n_neg", "tp", "fp",
                      (F.col("n_pos") - F.col("tp")).alias("fn"),
                      (F.col("n_neg") - F.col("fp")).alias("tn"))


def with_point_metrics(cm: DataFrame, report_zero_cm_one_class: bool = True) -> DataFrame:
    """Add accuracy .. mcc; with one class in y_true the reported cm is zeroed (as the reference)."""
    m = point_metrics("tp", "fp", "fn", "tn")
    out = cm.select("*", *[c.alias(k) for k, c in m.items()])
    if report_zero_cm_one_class:
        two = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
        for c in ("tp", "fp", "fn", "tn"):
            out = out.withColumn(c, F.when(two, F.col(c)).otherwise(F.lit(0).cast("long")))
    return out


def count_where(cond, weight: str | None = None):
    """count_if(cond), or the sum of ``weight`` over rows where cond holds (pre-aggregated input)."""
    if weight is None:
        return F.count_if(cond)
    return F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0)).cast("long")


def run_key(keys: list[str]):
    """All run keys as one struct column: null fields compare equal in joins and windows."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def score_histogram(preds: DataFrame, by, y: str = "y_true", p: str = "proba", keep_key: bool = False, weight: str | None = None) -> DataFrame:
    """Distinct scores per run with ``pos, neg`` counts and exact counts strictly above.

    Output: keys, score, pos, neg, pos_gt, neg_gt.  The per-run cumulative is two-level:
    a window inside each range of scores, and a running sum over the ranges of a run.  The
    ranges are cut from the run's own scores, so neither a large run nor one with all its scores close together
    has to fit in one task.
    """
    keys = _keys(by)
    h = materialize(preds.groupBy(run_key(keys).alias("_k"), F.col(p).alias("score")).agg(
        count_where(F.col(y) == 1, weight).alias("pos"), count_where(F.col(y) != 1, weight).alias("neg")))
    out = sums_before(with_ranges(h, ["_k"], "score"), ["_k"], ["score"], ["pos", "neg"], desc=True).select(
        "_k", "score", "pos", "neg", F.col("pos_before").alias("pos_gt"), F.col("neg_before").alias("neg_gt"))
    if keep_key:
        return out
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "score", "pos", "neg", "pos_gt", "neg_gt")


def ranking_metrics(preds: DataFrame, by, y: str = "y_true", p: str = "proba",
                    hist: DataFrame | None = None, threshold=None, weight: str | None = None) -> DataFrame:
    """E3 + E4: exact ROC AUC (ties count 1/2) and step average precision per run.

    One class in y_true -> null for both.  With ``threshold`` (number, or a
    column that is constant per run and part of ``by``) the confusion counts
    at ``score >= threshold`` come out of the same aggregate (E1).
    """
    keys = _keys(by)
    if isinstance(threshold, str) and threshold in keys:
        # a per-run threshold column travels inside the run key
        h = hist if hist is not None else score_histogram(preds, keys, y, p, keep_key=True, weight=weight)
        h = h.withColumn(threshold, F.col(f"_k.{threshold}"))
    else:
        h = hist if hist is not None else score_histogram(preds, keys, y, p, keep_key=True, weight=weight)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_ge = (F.col("pos_gt") + F.col("pos")).cast("double")
    neg_ge = (F.col("neg_gt") + F.col("neg")).cast("double")
    aggs = [F.sum("pos").alias("_P"), F.sum("neg").alias("_N"),
            F.sum(neg * (F.col("pos_gt").cast("double") + F.lit(0.5) * pos)).alias("_auc_num"),
            F.sum(pos * pos_ge / (pos_ge + neg_ge)).alias("_ap_num")]
    if threshold is not None:
        t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
        hit = F.col("score") >= t
        aggs += [F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).cast("long").alias("tp"),
                 F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).cast("long").alias("fp")]
    agg = h.groupBy("_k").agg(*aggs)
    agg = agg.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[c for c in agg.columns if c != "_k"])
    two = (F.col("_P") > 0) & (F.col("_N") > 0)
    out = agg.select(
        "*",
        F.when(two, F.col("_auc_num") / (F.col("_P").cast("double") * F.col("_N").cast("double")))
        .alias("auc"),
        F.when(two, F.col("_ap_num") / F.col("_P").cast("double")).alias("pr_auc"))
    if threshold is None:
        return out.select(*keys, "auc", "pr_auc")
    return out.select(*keys, F.col("_P").cast("long").alias("n_pos"), F.col("_N").cast("long").alias("n_neg"),
                      "tp", "fp", (F.col("_P") - F.col("tp")).cast("long").alias("fn"),
                      (F.col("_N") - F.col("fp")).cast("long").alias("tn"), "auc", "pr_auc")


def evaluate(preds: DataFrame, by, y: str = "y_true", p: str = "proba", threshold=0.5,
             weight: str | None = None) -> DataFrame:
    """E1-E4 together: one row per run with counts, point metrics, auc, pr_auc.

    One pass over the predictions: the per-run score histogram feeds the
    cumulative counts (AUC, AP) and the confusion counts at the threshold.
    A threshold column must be constant per run; it is added to the keys.
    """
    keys = _keys(by)
    if isinstance(threshold, str) and threshold not in keys:
        keys = keys + [threshold]
    r = ranking_metrics(preds, keys, y, p, threshold=threshold, weight=weight)
    return with_point_metrics(r)


def classification_report(preds: DataFrame, by=None, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Per-class precision / recall / F1 / support plus accuracy, macro and weighted avg.

    Output rows per run: ``label`` in ('0', '1', 'accuracy', 'macro avg', 'weighted avg').
    """
    keys = _keys(by)
    cm = preds.groupBy(*keys).agg(
        F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"))
    d = lambda c: F.col(c).cast("double")

    def prf(tp, fp, fn):
        prec = F.when(d(tp) + d(fp) > 0, d(tp) / F.when(d(tp) + d(fp) > 0, d(tp) + d(fp))).otherwise(0.0)
        rec = F.when(d(tp) + d(fn) > 0, d(tp) / F.when(d(tp) + d(fn) > 0, d(tp) + d(fn))).otherwise(0.0)
        f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / F.when(prec + rec > 0, prec + rec)).otherwise(0.0)
        return prec, rec, f1

    p1, r1, f1_1 = prf("tp", "fp", "fn")
    p0, r0, f1_0 = prf("tn", "fn", "fp")
    s1 = F.col("tp") + F.col("fn")
    s0 = F.col("tn") + F.col("fp")
    n = s0 + s1
    base = cm.select(*keys, p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
                     p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"),
                     ((d("tp") + d("tn")) / F.when(n > 0, n.cast("double"))).alias("acc"))
    wavg = lambda a, b: (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / F.when(
        F.col("s0") + F.col("s1") > 0, (F.col("s0") + F.col("s1")).cast("double"))
    def row(label, prec, rec, f1, sup):
        return F.struct(F.lit(label).alias("label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    tot = F.col("s0") + F.col("s1")
    rows = F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", F.lit(None), F.lit(None), F.col("acc"), tot),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, tot),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), tot))
    return base.select(*keys, F.inline(rows))


def class_report(df: DataFrame, by: Sequence[str] | str = "part", y: str = "y") -> DataFrame:
    """Class counts per part with a single-class flag."""
    keys = _keys(by)
    return df.groupBy(*keys).agg(
        F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg")
    ).withColumn("single_class", (F.col("n_pos") == 0) | (F.col("n_neg") == 0))
