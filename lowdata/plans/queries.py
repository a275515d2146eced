"""Registered queries: each is a Spark job over the driver tables plus its DuckDB twin.

``QUERIES[name] = (build(spark, sf_dir) -> DataFrame, sql or None)``.  The
SQL is an independent formulation (plain windows / joins / brute force) of
the same result; column names and types match the Spark output.  Timestamps
are rendered as text and floating sums rounded identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowdata.functions.hashing import round_half_up, sql_round_half_up
from lowdata.functions.metrics import sql_point_metrics
from lowdata.operators import evaluation as ev
from lowdata.operators import splits as sp
from lowdata.operators.layout import spread
from lowdata.session import materialize
from lowdata.plans import grid
from lowdata.sources import fixtures as fx

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"
METRIC_COLS = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")

# Fixed parameters of the events binding (30 days of January 2024).
EVENTS_CUTOFF = "2024-01-10 00:00:00"
EVENTS_WIN_DAYS, EVENTS_WIN_STEP = 6, 3
FIXTURE_SEEDS = (42, 1337, 2025)
FIXTURE_VARIANTS = ("real", "gan", "oversample", "smote")


def bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``: DuckDB returns HUGEINT for it,
    Spark's ``count_if`` is BIGINT (the oracle compares schemas too)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append("CAST(count_if(" + bigint_counts(sql[j + len(tok):k - 1]) + ") AS BIGINT)")
        i = k


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def ts_text(c) -> F.Column:
    return F.date_format(c if isinstance(c, F.Column) else F.col(c), TS_FMT)


def sql_ts_text(expr: str) -> str:
    return f"strftime({expr}, {SQL_TS_FMT})"


def r10(c) -> F.Column:
    return round_half_up(c if isinstance(c, F.Column) else F.col(c), 10)


def sql_r10(expr: str) -> str:
    return sql_round_half_up(expr, 10)


def _sql_values(name: str, values, typ: str) -> str:
    vals = ", ".join(f"({v!r})" if not isinstance(v, str) else f"('{v}')" for v in values)
    return f"(SELECT CAST(col0 AS {typ}) AS {name} FROM (VALUES {vals}) t(col0))"


# ------------------------------------------------------------------ shared parts

def events_windows(spark: SparkSession, sf_dir: str):
    """events -> D1 -> test rows -> D11 windows -> J7; returns ((row, window) pairs, windows).

    The window table (one row per window) is materialised once per call: the row
    assignment, its anchors and the run grid all read it.
    """
    test = sp.temporal_part(fx.events(spark, sf_dir).select("row_id", "y", "ts"), EVENTS_CUTOFF, "test")
    win = materialize(sp.rolling_windows(test, EVENTS_WIN_DAYS, EVENTS_WIN_STEP))
    return sp.assign_windows(spread(test, "row_id"), win, EVENTS_WIN_DAYS, EVENTS_WIN_STEP), win


def events_test_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_windows(spark, sf_dir)[0]


SQL_EVENTS_TEST_WINDOWS = f"""
ev_test AS (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y, ts
            FROM events WHERE ts IS NOT NULL AND ts > TIMESTAMP '{EVENTS_CUTOFF}'),
ev_b AS (SELECT min(ts) AS t0, max(ts) AS t1,
                CAST(ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / {float(EVENTS_WIN_STEP * 86400e6)!r}) AS BIGINT) AS nmax
         FROM ev_test),
ev_k AS (SELECT t0, t1, unnest(generate_series(0, nmax - 1)) AS k FROM ev_b WHERE nmax > 0),
ev_win AS (SELECT CAST(k AS INTEGER) AS window_id, t0 + to_days(CAST(k * {EVENTS_WIN_STEP} AS INTEGER)) AS wstart,
                  t0 + to_days(CAST(k * {EVENTS_WIN_STEP} AS INTEGER)) + to_days({EVENTS_WIN_DAYS}) AS wend
           FROM ev_k WHERE t0 + to_days(CAST(k * {EVENTS_WIN_STEP} AS INTEGER)) < t1),
ev_rows AS (SELECT w.window_id, w.wstart, w.wend, t.row_id, t.y, t.ts
            FROM ev_test t JOIN ev_win w ON t.ts >= w.wstart AND t.ts < w.wend)"""


def events_window_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_test_windows(spark, sf_dir).select("window_id", "wstart", "wend", "row_id", "y")
    return grid.fixture_preds(rows, FIXTURE_SEEDS, FIXTURE_VARIANTS)


SQL_EVENTS_WINDOW_PREDS = SQL_EVENTS_TEST_WINDOWS + f""",
ev_preds AS (SELECT r.window_id, r.wstart, r.wend, r.row_id, r.y, s.seed, v.variant, r.y AS y_true,
                    {grid.sql_fixture_score('s.seed', 'v.variant', 'r.row_id', 'r.y')} AS proba
             FROM ev_rows r CROSS JOIN {_sql_values('seed', FIXTURE_SEEDS, 'INTEGER')} s
             CROSS JOIN {_sql_values('variant', FIXTURE_VARIANTS, 'VARCHAR')} v)"""


def sql_ranking(src: str, keys: list[str]) -> str:
    """AUC / AP by a plain window over distinct scores (independent of the binned Spark path)."""
    k = ", ".join(keys)
    return f"""(SELECT {k},
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (pos_gt + 0.5 * pos)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc,
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (pos_gt + pos) / (pos_gt + pos + neg_gt + neg)) / CAST(sum(pos) AS DOUBLE) END AS pr_auc
      FROM (SELECT *, CAST(coalesce(sum(pos) OVER (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS pos_gt,
                      CAST(coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS neg_gt
            FROM (SELECT {k}, proba AS score, CAST(count_if(y_true = 1) AS DOUBLE) AS pos, CAST(count_if(y_true <> 1) AS DOUBLE) AS neg
                  FROM {src} GROUP BY ALL) h) c
      GROUP BY {k})"""


def sql_confusion(src: str, keys: list[str], thr: str = "0.5") -> str:
    k = ", ".join(keys)
    m = sql_point_metrics("tp", "fp", "fn", "tn")
    two = "(n_pos > 0 AND n_neg > 0)"
    zero = lambda c: f"CASE WHEN {two} THEN {c} ELSE 0 END AS {c}"
    return f"""(SELECT {k}, n_pos, n_neg, {zero('tp')}, {zero('fp')}, {zero('fn')}, {zero('tn')},
        {', '.join(f'{v} AS {n}' for n, v in m.items())}
      FROM (SELECT {k}, n_pos, n_neg, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn
            FROM (SELECT {k}, count_if(y_true = 1) AS n_pos, count_if(y_true <> 1) AS n_neg,
                         count_if(y_true = 1 AND proba >= {thr}) AS tp, count_if(y_true <> 1 AND proba >= {thr}) AS fp
                  FROM {src} GROUP BY ALL) a) b)"""


# ------------------------------------------------------------------ flagship

@register("window_metrics", None)
def q_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> temporal holdout -> rolling windows -> scores -> E1-E4 per (window, seed, variant)."""
    preds = events_window_preds(spark, sf_dir)
    keys = ["window_id", "wstart", "wend", "seed", "variant"]
    out = ev.evaluate(preds, keys)
    return out.select(
        "window_id", ts_text("wstart").alias("wstart"), ts_text("wend").alias("wend"), "seed", "variant",
        "n_pos", "n_neg", "tp", "fp", "fn", "tn", *METRIC_COLS,
        r10("auc").alias("auc"), r10("pr_auc").alias("pr_auc"))


QUERIES["window_metrics"] = (q_window_metrics, "WITH " + SQL_EVENTS_WINDOW_PREDS + f""",
cm AS {sql_confusion('ev_preds', ['window_id', 'wstart', 'wend', 'seed', 'variant'])},
rk AS {sql_ranking('ev_preds', ['window_id', 'seed', 'variant'])}
SELECT cm.window_id, {sql_ts_text('cm.wstart')} AS wstart, {sql_ts_text('cm.wend')} AS wend, cm.seed, cm.variant,
       n_pos, n_neg, tp, fp, fn, tn, {', '.join(METRIC_COLS)},
       {sql_r10('rk.auc')} AS auc, {sql_r10('rk.pr_auc')} AS pr_auc
FROM cm JOIN rk ON cm.window_id = rk.window_id AND cm.seed = rk.seed AND cm.variant = rk.variant""")
