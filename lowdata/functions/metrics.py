"""Point metrics from confusion counts, as Spark columns and DuckDB twins.

Conventions (from the reference's evaluation):
* precision, recall, F1: zero denominator -> 0;
* specificity: no negatives -> null (NaN in the reference);
* balanced accuracy: mean recall over the classes present in ``y_true``;
* MCC: one class in ``y_true`` -> null, zero denominator -> 0.  The threshold
  sweeps score MCC like the library call (0, never null): ``mcc_one_class_null=False``.
* ``style='plain'`` is the re-threshold script's variant: balanced accuracy
  = (sens + spec) / 2 with a missing class counted as 0.

All divisions are guarded (ANSI mode throws on ``/ 0`` even for doubles).
Counts are converted to DOUBLE before products so MCC cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("double")


def _div(num: Column, den: Column, zero) -> Column:
    z = F.lit(zero).cast("double")
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(z)


def point_metrics(tp="tp", fp="fp", fn="fn", tn="tn", mcc_one_class_null: bool = True,
                  style: str = "sklearn") -> dict[str, Column]:
    tp, fp, fn, tn = _d(tp), _d(fp), _d(fn), _d(tn)
    pos, neg = tp + fn, tn + fp
    n = pos + neg
    sens = _div(tp, pos, 0.0)
    spec0 = _div(tn, neg, 0.0)
    if style == "plain":
        bal = (sens + spec0) / F.lit(2.0)
    else:
        bal = (F.when((pos > 0) & (neg > 0), (sens + spec0) / F.lit(2.0))
               .when(pos > 0, sens).when(neg > 0, spec0))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = _div(tp * tn - fp * fn, F.sqrt(den), 0.0)
    if mcc_one_class_null:
        mcc = F.when((pos > 0) & (neg > 0), mcc)
    return {
        "accuracy": _div(tp + tn, n, None),
        "precision": _div(tp, tp + fp, 0.0),
        "recall": sens,
        "f1": _div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn, 0.0),
        "specificity": _div(tn, neg, None),
        "balanced_accuracy": bal,
        "mcc": mcc,
    }


def objective(name: str, tp="tp", fp="fp", fn="fn", tn="tn", style: str = "sklearn") -> Column:
    """Threshold objective (f1 / mcc / balacc) as scored by the sweeps."""
    key = {"balacc": "balanced_accuracy", "balanced_accuracy": "balanced_accuracy",
           "f1": "f1", "mcc": "mcc"}[name]
    return point_metrics(tp, fp, fn, tn, mcc_one_class_null=False, style=style)[key]


# ---------------------------------------------------------------- SQL twins

def _sdiv(num: str, den: str, zero: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) ELSE {zero} END)"


def sql_point_metrics(tp="tp", fp="fp", fn="fn", tn="tn", mcc_one_class_null: bool = True,
                      style: str = "sklearn") -> dict[str, str]:
    tp, fp, fn, tn = (f"CAST({x} AS DOUBLE)" for x in (tp, fp, fn, tn))
    pos, neg = f"({tp} + {fn})", f"({tn} + {fp})"
    n = f"({pos} + {neg})"
    sens = _sdiv(tp, pos, "0.0")
    spec0 = _sdiv(tn, neg, "0.0")
    if style == "plain":
        bal = f"(({sens} + {spec0}) / 2.0)"
    else:
        bal = (f"(CASE WHEN {pos} > 0 AND {neg} > 0 THEN ({sens} + {spec0}) / 2.0 "
               f"WHEN {pos} > 0 THEN {sens} WHEN {neg} > 0 THEN {spec0} END)")
    den = f"(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    mcc = _sdiv(f"({tp} * {tn} - {fp} * {fn})", f"sqrt({den})", "0.0")
    if mcc_one_class_null:
        mcc = f"(CASE WHEN {pos} > 0 AND {neg} > 0 THEN {mcc} END)"
    return {
        "accuracy": _sdiv(f"({tp} + {tn})", n, "NULL"),
        "precision": _sdiv(tp, f"({tp} + {fp})", "0.0"),
        "recall": sens,
        "f1": _sdiv(f"(2.0 * {tp})", f"(2.0 * {tp} + {fp} + {fn})", "0.0"),
        "specificity": _sdiv(tn, neg, "NULL"),
        "balanced_accuracy": bal,
        "mcc": mcc,
    }


def sql_objective(name: str, tp="tp", fp="fp", fn="fn", tn="tn", style: str = "sklearn") -> str:
    key = {"balacc": "balanced_accuracy", "balanced_accuracy": "balanced_accuracy",
           "f1": "f1", "mcc": "mcc"}[name]
    return sql_point_metrics(tp, fp, fn, tn, mcc_one_class_null=False, style=style)[key]
