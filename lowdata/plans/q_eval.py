"""Registered queries: metrics and thresholds over many runs.

Run fixture: the events temporal test set, rolling windows, and a grid of
seeds x fractions x variants per window (D22).  Each run's scores are the
deterministic stand-in ``round(0.8 * u(tag, row) + 0.2 * y, 2)``; ``raw``
holds one metrics row per run, as the sweep writes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lowdata.functions.columns import variant_from_tag
from lowdata.functions.hashing import round_half_up, sql_round_half_up, sql_uniform, uniform
from lowdata.functions.metrics import sql_objective, sql_point_metrics
from lowdata.operators import evaluation as ev
from lowdata.operators import thresholds as th
from lowdata.plans.queries import (EVENTS_CUTOFF, EVENTS_WIN_DAYS, QUERIES, SQL_EVENTS_TEST_WINDOWS,
                                   _sql_values, events_windows, r10, sql_r10, sql_ts_text, ts_text)
from lowdata.session import scratch_path
from lowdata.sources import fixtures as fx
from lowdata.sources import io

PREFIX = "cut2024_01"
SEEDS = (42, 1337, 2025)
FRACS = (0.001, 0.01)
VARIANTS = ("real", "gan", "oversample", "smote")
CONST = 2000
KEYS_RUN = ["prefix", "window_id", "seed", "frac", "variant", "const_train_size", "tag", "run_idx"]


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ run fixture

def run_grid(spark, sf, win=None):
    """Windows x seeds x fractions x variants with tag (P12) and sweep order ``run_idx``."""
    from lowdata.plans.grid import run_grid as grid_of
    if win is None:
        _, win = events_windows(spark, sf)
    g = grid_of(win.select("window_id"), SEEDS, FRACS, VARIANTS, PREFIX, CONST)
    idx = lambda c, vals: F.array_position(F.array(*[F.lit(v) for v in vals]), F.col(c)) - 1
    run_idx = ((F.col("window_id") * len(SEEDS) + idx("seed", SEEDS)) * len(FRACS) + idx("frac", FRACS)) \
        * len(VARIANTS) + idx("variant", VARIANTS)
    return g.withColumn("run_idx", run_idx.cast("long"))


def run_preds(spark, sf):
    """Every windowed test row scored by every run of its window (broadcast fan-out on window_id;
    the grid has one row per run)."""
    rows, win = events_windows(spark, sf)
    rows = rows.select("window_id", "wstart", "wend", "row_id", "y")
    p = rows.join(F.broadcast(run_grid(spark, sf, win)), on="window_id", how="inner")
    score = round_half_up(F.lit(0.8) * uniform(F.col("tag"), F.col("row_id")) + F.lit(0.2) * F.col("y").cast("double"), 2)
    return p.withColumn("y_true", F.col("y").cast("int")).withColumn("proba", score)


def sql_frac_code(expr: str) -> str:
    return f"replace(rtrim(rtrim(printf('%.10f', {expr}), '0'), '.'), '.', '')"


def sql_run_tag(prefix, window, seed, variant, frac, const) -> str:
    code = f"CASE {variant} WHEN 'gan' THEN 'gan' WHEN 'oversample' THEN 'os' WHEN 'smote' THEN 'sm' END"
    return (f"({prefix} || CASE WHEN {window} IS NULL THEN '' ELSE printf('_w%02d', {window}) END"
            f" || CASE WHEN {seed} IS NULL THEN '' ELSE '_s' || CAST({seed} AS VARCHAR) END"
            f" || CASE WHEN {variant} = 'real' THEN '_real' || {sql_frac_code(frac)}"
            f" ELSE '_r' || {sql_frac_code(frac)} || '_' || {code} || CAST({const} AS VARCHAR) END)")


def _pos(col: str, vals) -> str:
    return f"(list_position({list(vals)!r}, {col}) - 1)"


SQL_RUN_PREDS = SQL_EVENTS_TEST_WINDOWS + f""",
rp0 AS (SELECT r.window_id, r.wstart, r.wend, r.row_id, r.y, s.seed, f.frac, v.variant,
               CASE WHEN v.variant = 'real' THEN NULL ELSE {CONST} END AS const_train_size, '{PREFIX}' AS prefix
        FROM ev_rows r CROSS JOIN {_sql_values('seed', SEEDS, 'INTEGER')} s
        CROSS JOIN {_sql_values('frac', FRACS, 'DOUBLE')} f CROSS JOIN {_sql_values('variant', VARIANTS, 'VARCHAR')} v),
rp1 AS (SELECT *, {sql_run_tag('prefix', 'window_id', 'seed', 'variant', 'frac', 'const_train_size')} AS tag,
               CAST((((window_id * {len(SEEDS)} + {_pos('seed', SEEDS)}) * {len(FRACS)} + {_pos('frac', FRACS)}) * {len(VARIANTS)}
                     + {_pos('variant', VARIANTS)}) AS BIGINT) AS run_idx FROM rp0),
rp AS (SELECT *, y AS y_true, {sql_round_half_up(f"0.8 * {sql_uniform('tag', 'row_id')} + 0.2 * CAST(y AS DOUBLE)", 2)} AS proba FROM rp1)"""


def run_preds_agg(spark, sf):
    """Predictions reduced to (run, label, score) counts ``w``: forest-like scores are
    discrete, so this is the table every metric and threshold sweep reads (once)."""
    from lowdata.session import materialize
    keys = KEYS_RUN + ["wstart", "wend"]
    p = run_preds(spark, sf)
    return materialize(p.groupBy(*keys, "y_true", "proba").agg(F.count(F.lit(1)).alias("w")))


def run_raw(spark, sf, agg=None):
    """``raw``: one metrics row per run (the sweep's results table) from the fixture predictions."""
    p = agg if agg is not None else run_preds_agg(spark, sf)
    keys = KEYS_RUN + ["wstart", "wend"]
    e = ev.evaluate(p, keys, weight="w")
    n_train = fx.events(spark, sf).filter(F.col("ts").isNull() | (F.col("ts") <= F.lit(EVENTS_CUTOFF).cast("timestamp"))) \
        .agg(F.count(F.lit(1)).alias("_N"))
    from lowdata.operators.ranking import join_small
    e = join_small(e, n_train, [])
    n_real = F.greatest(F.lit(1), F.bround(F.col("frac") * F.col("_N").cast("double"), 0).cast("long"))
    n_total = F.when(F.col("variant") == "real", n_real).otherwise(F.col("const_train_size").cast("long"))
    return e.select(
        "prefix", F.lit("temporal").alias("kind"), "frac", "const_train_size", "variant",
        (F.col("variant") == "gan").alias("used_gan"), "tag", "auc", "pr_auc",
        "accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc",
        n_real.alias("n_train_real"), (n_total - n_real).alias("n_train_synth"), n_total.alias("n_train_total"),
        "tn", "fp", "fn", "tp", F.lit(0.5).alias("threshold"), "seed",
        ts_text("wstart").alias("test_start"), ts_text("wend").alias("test_end"),
        F.lit(EVENTS_WIN_DAYS).alias("test_window_days"), "window_id", "run_idx")


def _sql_cm(src: str, keys: str) -> str:
    m = sql_point_metrics("tp", "fp", "fn", "tn")
    two = "(n_pos > 0 AND n_neg > 0)"
    z = lambda c: f"CASE WHEN {two} THEN {c} ELSE 0 END AS {c}"
    return f"""(SELECT {keys}, n_pos, n_neg, {z('tp')}, {z('fp')}, {z('fn')}, {z('tn')},
        {', '.join(f'{v} AS {n}' for n, v in m.items())}
      FROM (SELECT *, n_pos - tp AS fn, n_neg - fp AS tn FROM (
            SELECT {keys}, count_if(y_true = 1) AS n_pos, count_if(y_true <> 1) AS n_neg,
                   count_if(y_true = 1 AND proba >= 0.5) AS tp, count_if(y_true <> 1 AND proba >= 0.5) AS fp
            FROM {src} GROUP BY ALL) a) b)"""


def _sql_rank(src: str, key: str) -> str:
    return f"""(SELECT {key},
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (pos_gt + 0.5 * pos)) / (sum(pos) * sum(neg)) END AS auc,
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (pos_gt + pos) / (pos_gt + pos + neg_gt + neg)) / sum(pos) END AS pr_auc
      FROM (SELECT *, coalesce(sum(pos) OVER (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_gt,
                      coalesce(sum(neg) OVER (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_gt
            FROM (SELECT {key}, proba AS score, CAST(count_if(y_true = 1) AS DOUBLE) AS pos, CAST(count_if(y_true <> 1) AS DOUBLE) AS neg
                  FROM {src} GROUP BY ALL) h) c GROUP BY {key})"""


SQL_RAW = SQL_RUN_PREDS + f""",
ntr AS (SELECT count(*) AS N FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '{EVENTS_CUTOFF}'),
rcm AS {_sql_cm('rp', 'prefix, window_id, seed, frac, variant, const_train_size, tag, run_idx, wstart, wend')},
rrk AS {_sql_rank('rp', 'tag')},
raw0 AS (SELECT rcm.*, rrk.auc, rrk.pr_auc, greatest(1, CAST(round_even(frac * CAST(ntr.N AS DOUBLE), 0) AS BIGINT)) AS n_real
         FROM rcm JOIN rrk ON rcm.tag = rrk.tag CROSS JOIN ntr),
raw AS (SELECT prefix, 'temporal' AS kind, frac, const_train_size, variant, variant = 'gan' AS used_gan, tag,
               auc, pr_auc, accuracy, precision, recall, f1, specificity,
               balanced_accuracy, mcc, n_real AS n_train_real,
               (CASE WHEN variant = 'real' THEN n_real ELSE CAST(const_train_size AS BIGINT) END) - n_real AS n_train_synth,
               CASE WHEN variant = 'real' THEN n_real ELSE CAST(const_train_size AS BIGINT) END AS n_train_total,
               tn, fp, fn, tp, CAST(0.5 AS DOUBLE) AS threshold, seed, {sql_ts_text('wstart')} AS test_start,
               {sql_ts_text('wend')} AS test_end, {EVENTS_WIN_DAYS} AS test_window_days, window_id, run_idx FROM raw0)"""


@reg("run_results", "WITH " + SQL_RAW + " SELECT * REPLACE (" + sql_r10("auc") + " AS auc, "
     + sql_r10("pr_auc") + " AS pr_auc) FROM raw")
def q_run_results(spark, sf):
    """D22 + P12 + E1-E4: the results table of a windows x seeds x fractions x variants sweep."""
    r = run_raw(spark, sf)
    return r.withColumn("auc", r10("auc")).withColumn("pr_auc", r10("pr_auc"))


# ------------------------------------------------------------------ E1 / E2 / E3 / E4 on the full test set

SQL_TEST_PREDS = f"""
tp0 AS (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events
        WHERE ts IS NOT NULL AND ts > TIMESTAMP '{EVENTS_CUTOFF}'),
tpp AS (SELECT t.row_id, s.seed, v.variant, t.y AS y_true,
               {sql_round_half_up(f"0.8 * {sql_uniform("concat_ws('|', CAST(s.seed AS VARCHAR), v.variant)", 't.row_id')} + 0.2 * CAST(t.y AS DOUBLE)", 2)} AS proba
        FROM tp0 t CROSS JOIN {_sql_values('seed', SEEDS, 'INTEGER')} s CROSS JOIN {_sql_values('variant', VARIANTS, 'VARCHAR')} v)"""


def test_preds(spark, sf):
    from lowdata.operators import splits as sp
    from lowdata.plans.grid import fixture_preds
    from lowdata.operators.layout import spread
    t = sp.temporal_holdout(fx.events(spark, sf).select("row_id", "y", "ts"), EVENTS_CUTOFF)
    return fixture_preds(spread(t.filter(F.col("part") == "test").select("row_id", "y"), "row_id"), SEEDS, VARIANTS)


@reg("confusion_metrics", f"""WITH {SQL_TEST_PREDS}
SELECT * FROM {_sql_cm('tpp', 'seed, variant')}""")
def q_confusion_metrics(spark, sf):
    """E1 + E2 at threshold 0.5 per (seed, variant)."""
    return ev.with_point_metrics(ev.confusion(test_preds(spark, sf), ["seed", "variant"]))


@reg("ranking_metrics", f"""WITH {SQL_TEST_PREDS},
k AS (SELECT *, CAST(seed AS VARCHAR) || '|' || variant AS run FROM tpp)
SELECT split_part(run, '|', 1)::INTEGER AS seed, split_part(run, '|', 2) AS variant,
       {sql_r10('auc')} AS auc, {sql_r10('pr_auc')} AS pr_auc FROM {_sql_rank('k', 'run')} x""")
def q_ranking_metrics(spark, sf):
    """E3 + E4: exact ROC AUC (ties 1/2) and step average precision per (seed, variant)."""
    r = ev.ranking_metrics(test_preds(spark, sf), ["seed", "variant"])
    return r.select("seed", "variant", r10("auc").alias("auc"), r10("pr_auc").alias("pr_auc"))


@reg("auc_bruteforce_check", f"""WITH {SQL_TEST_PREDS},
pr AS (SELECT a.seed, a.variant,
              sum(CASE WHEN a.proba > b.proba THEN 1.0 WHEN a.proba = b.proba THEN 0.5 ELSE 0.0 END) AS wins,
              count(*) AS pairs
       FROM tpp a JOIN tpp b ON a.seed = b.seed AND a.variant = b.variant AND a.y_true = 1 AND b.y_true = 0
       GROUP BY a.seed, a.variant)
SELECT seed, variant, {sql_r10('wins / pairs')} AS auc FROM pr""")
def q_auc_bruteforce_check(spark, sf):
    """E3 checked against the pairwise Mann-Whitney count (SQL side is brute force)."""
    r = ev.ranking_metrics(test_preds(spark, sf), ["seed", "variant"])
    return r.select("seed", "variant", r10("auc").alias("auc"))


# ------------------------------------------------------------------ E5 threshold sweeps (brute-force SQL twin)

def sql_pick_first_max(src: str, keys: str, which: str, grid: int, style: str = "sklearn") -> str:
    step = 1.0 / grid
    obj = sql_objective(which, "tp", "fp", "fn", "tn", style=style)
    return f"""(SELECT {keys}, threshold, score FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, i) AS rk FROM (
        SELECT *, {obj} AS score FROM (
          SELECT {keys}, g.i, CAST(g.i AS DOUBLE) * {step!r} AS threshold,
                 sum(CASE WHEN y_true = 1 AND proba >= CAST(g.i AS DOUBLE) * {step!r} THEN c ELSE 0 END) AS tp,
                 sum(CASE WHEN y_true <> 1 AND proba >= CAST(g.i AS DOUBLE) * {step!r} THEN c ELSE 0 END) AS fp,
                 sum(CASE WHEN y_true = 1 AND proba < CAST(g.i AS DOUBLE) * {step!r} THEN c ELSE 0 END) AS fn,
                 sum(CASE WHEN y_true <> 1 AND proba < CAST(g.i AS DOUBLE) * {step!r} THEN c ELSE 0 END) AS tn
          FROM (SELECT {keys}, y_true, proba, count(*) AS c FROM {src} GROUP BY ALL) d
          CROSS JOIN (SELECT unnest(generate_series(1, {grid - 1})) AS i) g
          GROUP BY ALL) a) b) c WHERE rk = 1)"""


for _which in ("balacc", "f1", "mcc"):
    def _mk(which):
        def q(spark, sf):
            return th.pick_threshold(test_preds(spark, sf), which, 200, ["seed", "variant"])
        q.__doc__ = f"E5: best of 199 grid thresholds for {which} per run (first maximum)."
        return q
    QUERIES[f"pick_threshold_{_which}"] = (_mk(_which), f"WITH {SQL_TEST_PREDS} SELECT * FROM "
                                           + sql_pick_first_max("tpp", "seed, variant", _which, 200))


# ------------------------------------------------------------------ E6 re-threshold on test

def sql_grid_counts(src: str, keys: str, grid: int) -> str:
    step = 1.0 / grid
    t = f"CAST(g.i AS DOUBLE) * {step!r}"
    return f"""(SELECT {keys}, g.i, {t} AS threshold,
          sum(CASE WHEN y_true = 1 AND proba >= {t} THEN c ELSE 0 END) AS tp,
          sum(CASE WHEN y_true <> 1 AND proba >= {t} THEN c ELSE 0 END) AS fp,
          sum(CASE WHEN y_true = 1 AND proba < {t} THEN c ELSE 0 END) AS fn,
          sum(CASE WHEN y_true <> 1 AND proba < {t} THEN c ELSE 0 END) AS tn
        FROM (SELECT {keys}, y_true, proba, count(*) AS c FROM {src} GROUP BY ALL) d
        CROSS JOIN (SELECT unnest(generate_series(1, {grid - 1})) AS i) g GROUP BY ALL)"""


def sql_best(gc: str, keys: str, which: str, style: str) -> str:
    obj = sql_objective(which, "tp", "fp", "fn", "tn", style=style)
    return f"""(SELECT {keys}, threshold, score FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, i) AS rk FROM (
        SELECT *, {obj} AS score FROM {gc}) a) b WHERE rk = 1)"""


@reg("rethreshold", "WITH " + SQL_RAW + f""",
gc AS {sql_grid_counts('rp', 'tag', 2000)},
b1 AS {sql_best('gc', 'tag', 'f1', 'plain')},
b2 AS {sql_best('gc', 'tag', 'balanced_accuracy', 'plain')},
b3 AS {sql_best('gc', 'tag', 'mcc', 'plain')}
SELECT raw.tag, raw.variant, raw.seed, raw.frac, raw.window_id,
       b1.score AS f1, b1.threshold AS f1_thr_test, b2.score AS balanced_accuracy, b2.threshold AS balanced_accuracy_thr_test,
       b3.score AS mcc, b3.threshold AS mcc_thr_test
FROM raw JOIN b1 ON raw.tag = b1.tag JOIN b2 ON raw.tag = b2.tag JOIN b3 ON raw.tag = b3.tag""")
def q_rethreshold(spark, sf):
    """Every run re-tuned on its own test predictions (grid 2000) for f1 / balacc / mcc."""
    agg = run_preds_agg(spark, sf)
    raw = run_raw(spark, sf, agg)
    out = th.rethreshold(raw, agg.select("tag", "y_true", "proba", "w"), ("f1", "balanced_accuracy", "mcc"), 2000,
                         weight="w")
    return out.select("tag", "variant", "seed", "frac", "window_id", "f1", "f1_thr_test", "balanced_accuracy",
                      "balanced_accuracy_thr_test", "mcc", "mcc_thr_test")


# ------------------------------------------------------------------ E7 / E8 pooled thresholds

def _levels_sql() -> str:
    return "[" + ", ".join(repr(x) for x in th.quantile_levels(512)) + "]"


SQL_POOLED = SQL_RUN_PREDS + f""",
st AS (SELECT prefix, frac, variant, min(proba) AS pmin, max(proba) AS pmax, count(*) AS n,
              count_if(y_true = 1) AS n_pos, count_if(y_true <> 1) AS n_neg,
              quantile_cont(proba, {_levels_sql()}) AS qs FROM rp GROUP BY ALL),
gp AS (SELECT DISTINCT prefix, frac, variant, unnest(qs) AS t FROM st),
gp2 AS (SELECT gp.* FROM gp JOIN st USING (prefix, frac, variant) WHERE t > pmin AND t < pmax),
hc AS (SELECT prefix, frac, variant, y_true, proba, count(*) AS c FROM rp GROUP BY ALL),
sc AS (SELECT g.prefix, g.frac, g.variant, g.t,
              sum(CASE WHEN h.y_true = 1 AND h.proba >= g.t THEN c ELSE 0 END) AS tp,
              sum(CASE WHEN h.y_true <> 1 AND h.proba >= g.t THEN c ELSE 0 END) AS fp,
              sum(CASE WHEN h.y_true = 1 AND h.proba < g.t THEN c ELSE 0 END) AS fn,
              sum(CASE WHEN h.y_true <> 1 AND h.proba < g.t THEN c ELSE 0 END) AS tn
       FROM gp2 g JOIN hc h USING (prefix, frac, variant) GROUP BY ALL),
sc2 AS (SELECT *, {sql_objective('balanced_accuracy')} AS score FROM sc WHERE tp + fp > 0 AND fn + tn > 0),
best AS (SELECT prefix, frac, variant, t, score FROM (
           SELECT *, row_number() OVER (PARTITION BY prefix, frac, variant ORDER BY score DESC, t) AS rk FROM sc2 WHERE score > -1.0)
         WHERE rk = 1),
pooled AS (SELECT st.prefix, st.frac, st.variant, coalesce(best.t, 0.5) AS threshold, CASE WHEN best.score >= 0 THEN best.score END AS best_score, st.n_pos, st.n_neg
           FROM st LEFT JOIN best USING (prefix, frac, variant))"""


def pooled(spark, sf, agg=None, which="balanced_accuracy"):
    agg = agg if agg is not None else run_preds_agg(spark, sf)
    return th.pick_threshold_quantile(agg, ("prefix", "frac", "variant"), which, 512, weight="w")


@reg("pooled_threshold", "WITH " + SQL_POOLED + f"""
SELECT prefix, frac, variant, {sql_r10('threshold')} AS threshold, {sql_r10('best_score')} AS best_score, n_pos, n_neg FROM pooled""")
def q_pooled_threshold(spark, sf):
    """Pooled non-degenerate balanced-accuracy threshold per (prefix, frac, variant) on a 512-quantile grid."""
    p = pooled(spark, sf)
    return p.select("prefix", "frac", "variant", r10("threshold").alias("threshold"),
                    r10("best_score").alias("best_score"), "n_pos", "n_neg")


def _reg_pooled(which: str):
    sql = SQL_POOLED.replace(sql_objective("balanced_accuracy"), sql_objective(which))

    @reg(f"pooled_threshold_{which}", "WITH " + sql + f"""
SELECT prefix, frac, variant, {sql_r10('threshold')} AS threshold, {sql_r10('best_score')} AS best_score, n_pos, n_neg FROM pooled""")
    def q(spark, sf):
        """E7 with another objective."""
        return pooled(spark, sf, which=which).select("prefix", "frac", "variant", r10("threshold").alias("threshold"),
                                                     r10("best_score").alias("best_score"), "n_pos", "n_neg")


for _which in ("f1", "mcc"):
    _reg_pooled(_which)

_SQL_APPLY_M = sql_point_metrics("cm.tp", "cm.fp", "cm.fn", "cm.tn", mcc_one_class_null=False)


@reg("apply_thresholds", "WITH " + SQL_RAW + "," + SQL_POOLED.split(
    SQL_RUN_PREDS + ",", 1)[1] + f""",
rt AS (SELECT raw.*, coalesce(pooled.threshold, raw.threshold, 0.5) AS t FROM raw LEFT JOIN pooled USING (prefix, frac, variant)),
cm AS (SELECT rp.tag, count_if(rp.y_true = 1 AND rp.proba >= rt.t) AS tp, count_if(rp.y_true <> 1 AND rp.proba >= rt.t) AS fp,
              count_if(rp.y_true = 1 AND rp.proba < rt.t) AS fn, count_if(rp.y_true <> 1 AND rp.proba < rt.t) AS tn
       FROM rp JOIN rt ON rp.tag = rt.tag GROUP BY rp.tag)
SELECT rt.tag, {sql_r10('rt.t')} AS threshold, {_SQL_APPLY_M['f1']} AS f1, {_SQL_APPLY_M['balanced_accuracy']} AS balanced_accuracy,
       {_SQL_APPLY_M['mcc']} AS mcc
FROM rt JOIN cm ON rt.tag = cm.tag""")
def q_apply_thresholds(spark, sf):
    """E8 + J9: pooled thresholds applied back to every run; f1 / balacc / mcc recomputed."""
    agg = run_preds_agg(spark, sf)
    raw = run_raw(spark, sf, agg)
    out = th.apply_thresholds(raw, pooled(spark, sf, agg), agg.select("tag", "y_true", "proba", "w"), weight="w")
    return out.select("tag", r10("threshold").alias("threshold"), "f1", "balanced_accuracy", "mcc")


@reg("apply_thresholds_bucketed", QUERIES["apply_thresholds"][1])
def q_apply_thresholds_bucketed(spark, sf):
    """S8 + E8: the same over predictions stored as a table bucketed by run, which is grouped and joined by run without a shuffle."""
    name = f"preds_{uuid.uuid4().hex[:12]}"
    agg = run_preds_agg(spark, sf)
    stored = io.write_preds_bucketed(agg, name, scratch_path(spark, name), buckets=8)
    out = th.apply_thresholds(run_raw(spark, sf, agg), pooled(spark, sf, agg), stored.select("tag", "y_true", "proba", "w"), weight="w")
    return out.select("tag", r10("threshold").alias("threshold"), "f1", "balanced_accuracy", "mcc")


# ------------------------------------------------------------------ E9 / E10 / P9

@reg("classification_report", f"""WITH {SQL_TEST_PREDS},
c AS (SELECT seed, variant, count_if(y_true = 1 AND proba >= 0.5) AS tp, count_if(y_true = 0 AND proba >= 0.5) AS fp,
             count_if(y_true = 1 AND proba < 0.5) AS fn, count_if(y_true = 0 AND proba < 0.5) AS tn FROM tpp GROUP BY ALL),
m AS (SELECT seed, variant, tp, fp, fn, tn, tn + fp AS s0, tp + fn AS s1,
             CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1
      FROM c),
m2 AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2.0 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
                 CASE WHEN p1 + r1 > 0 THEN 2.0 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM m)
SELECT seed, variant, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m2
UNION ALL SELECT seed, variant, '1', p1, r1, f1, s1 FROM m2
UNION ALL SELECT seed, variant, 'accuracy', NULL, NULL, CASE WHEN s0 + s1 > 0 THEN (tp + tn) / (s0 + s1) END, s0 + s1 FROM m2
UNION ALL SELECT seed, variant, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m2
UNION ALL SELECT seed, variant, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                 (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m2""")
def q_classification_report(spark, sf):
    """Per-class precision / recall / F1 / support with accuracy, macro and weighted averages."""
    p = test_preds(spark, sf).withColumn("y_pred", (F.col("proba") >= 0.5).cast("int"))
    return ev.classification_report(p, ["seed", "variant"], "y_true", "y_pred")


@reg("class_report", f"""
SELECT CASE WHEN ts IS NULL OR ts <= TIMESTAMP '{EVENTS_CUTOFF}' THEN 'train' ELSE 'test' END AS part,
       count_if(event_type = 'error') AS n_pos, count_if(event_type <> 'error') AS n_neg,
       count_if(event_type = 'error') = 0 OR count_if(event_type <> 'error') = 0 AS single_class
FROM events GROUP BY ALL""")
def q_class_report(spark, sf):
    """Class counts of the temporal train and test parts."""
    from lowdata.operators import splits as sp
    return ev.class_report(sp.temporal_holdout(fx.events(spark, sf), EVENTS_CUTOFF))


@reg("variant_from_tag", "WITH " + SQL_RUN_PREDS + """
SELECT DISTINCT tag, CASE WHEN lower(tag) LIKE '%\\_gan%' ESCAPE '\\' THEN 'gan'
       WHEN lower(tag) LIKE '%\\_os%' ESCAPE '\\' OR lower(tag) LIKE '%\\_oversample%' ESCAPE '\\' THEN 'oversample'
       WHEN lower(tag) LIKE '%\\_sm%' ESCAPE '\\' OR lower(tag) LIKE '%\\_smote%' ESCAPE '\\' THEN 'smote' ELSE 'real' END AS variant
FROM rp""")
def q_variant_from_tag(spark, sf):
    """Variant recovered from the run tag."""
    return run_preds(spark, sf).select("tag").distinct().select("tag", variant_from_tag("tag").alias("variant"))
