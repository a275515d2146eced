"""Registered queries: pairing and aggregation of run results.

Input is the sweep's ``raw`` table from :mod:`q_eval` plus a re-run of the
window-0 runs (same keys, later ``run_idx``, other metric values) so that
"last run per key wins" is exercised.  Doubles are rounded to 10 digits on
both sides (sums and standard deviations are order dependent in the last bit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.functions.hashing import round_half_up, sql_round_half_up
from lowdata.operators import evaluation as ev
from lowdata.operators import pairing as pa
from lowdata.operators import report as rp
from lowdata.plans import grid
from lowdata.plans.q_eval import SQL_RAW, run_raw
from lowdata.plans.queries import FIXTURE_SEEDS, FIXTURE_VARIANTS, QUERIES, r10, sql_r10, sql_ranking
from lowdata.session import materialize
from lowdata.sources import fixtures as fx

CORE = pa.CORE
KB = ["prefix", "kind", "frac", "seed", "test_start", "test_end", "test_window_days"]
KA = KB + ["variant", "const_train_size"]


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r10(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def results(spark, sf) -> DataFrame:
    """raw plus a later re-run of every window-0 run (one pass: rows fan out with ``explode``)."""
    raw = run_raw(spark, sf)
    rep = F.explode(F.when(F.col("window_id") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    d = raw.withColumn("_rep", rep)
    again = F.col("_rep") == 1
    return (d.withColumn("auc", F.when(again, F.lit(1.0) - F.col("auc")).otherwise(F.col("auc")))
            .withColumn("f1", F.when(again, F.col("f1") / 2).otherwise(F.col("f1")))
            .withColumn("mcc", F.when(again, -F.col("mcc")).otherwise(F.col("mcc")))
            .withColumn("run_idx", F.when(again, F.col("run_idx") + 100000).otherwise(F.col("run_idx")))
            .drop("_rep"))


SQL_RESULTS = SQL_RAW + """,
res AS (SELECT * FROM raw UNION ALL
        SELECT * REPLACE (1.0 - auc AS auc, f1 / 2 AS f1, -mcc AS mcc, run_idx + 100000 AS run_idx)
        FROM raw WHERE window_id = 0)"""


def _sql_last(src: str, keys: list[str], cols: list[str], where: str, suffix: str) -> str:
    k = ", ".join(keys)
    sel = ", ".join(keys + [f"{c} AS {c}{suffix}" for c in cols])
    return f"""(SELECT {sel} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY run_idx DESC) AS rn
                FROM {src} WHERE {where}) WHERE rn = 1)"""


def _on(a: str, b: str, keys: list[str]) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _sql_pair(where_base: str, where_aug: str, kb: list[str], ka: list[str], null_filter: bool = False) -> str:
    base = _sql_last("res", kb, CORE, where_base, "_real")
    aug = _sql_last("res", ka, CORE, where_aug, "_aug")
    on = _on("a", "b", kb) if not null_filter else " AND ".join(f"a.{k} = b.{k}" for k in kb)
    nn = ""
    if null_filter:
        nn = " WHERE " + " AND ".join(f"a.{k} IS NOT NULL" for k in ka)
    cols = ", ".join([f"a.{k}" for k in ka] + [f"{sql_r10('b.' + m + '_real')} AS {m}_real" for m in CORE]
                     + [f"{sql_r10('a.' + m + '_aug')} AS {m}_aug" for m in CORE]
                     + [f"{sql_r10(f'a.{m}_aug - b.{m}_real')} AS delta_{m}" for m in CORE])
    return f"SELECT {cols} FROM {aug} a LEFT JOIN {base} b ON {on}{nn}"


# ------------------------------------------------------------------ G2 / W2

@reg("last_per_key", "WITH " + SQL_RESULTS + f"""
SELECT tag, run_idx, {sql_r10('auc')} AS auc, {sql_r10('f1')} AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY run_idx DESC) AS rn FROM res) WHERE rn = 1""")
def q_last_per_key(spark, sf):
    """The last run (max run_idx) per tag."""
    last = pa.last_per_key(results(spark, sf).select("tag", "run_idx", "auc", "f1"), ["tag"])
    return last.select("tag", "run_idx", r10("auc").alias("auc"), r10("f1").alias("f1"))


# ------------------------------------------------------------------ J4 + P15 + P18

SQL_PAIRED = "WITH " + SQL_RESULTS + ", paired AS (" + _sql_pair("variant = 'real'", "variant <> 'real'", KB, KA) + ")"


@reg("pair", SQL_PAIRED + " SELECT * FROM paired")
def q_pair(spark, sf):
    """J4 + P15 + P18: every augmented run beside its real-only baseline, deltas of five metrics."""
    return round_doubles(pa.pair(results(spark, sf)))


@reg("pair_compat", "WITH " + SQL_RESULTS + ", paired AS ("
     + _sql_pair("NOT used_gan", "used_gan", KB, KB + ["const_train_size"], True) + ") SELECT * FROM paired")
def q_pair_compat(spark, sf):
    """J4 with the reference's rule: baseline = last non-GAN run, null keys dropped."""
    return round_doubles(pa.pair(results(spark, sf), compat=True))


def _paired_metric_cols():
    return [f"{m}_real" for m in CORE] + [f"{m}_aug" for m in CORE] + [f"delta_{m}" for m in CORE]


SQL_PAIRED_CV_BODY = ("SELECT " + ", ".join([k for k in KA if k != "seed"]
                                             + [f"{sql_r10(f'avg({c})')} AS {c}_mean" for c in _paired_metric_cols()]
                                             + [f"{sql_r10(f'stddev_samp({c})')} AS {c}_std" for c in _paired_metric_cols()])
                      + " FROM paired GROUP BY " + ", ".join(k for k in KA if k != "seed"))


@reg("paired_cv", SQL_PAIRED + " " + SQL_PAIRED_CV_BODY)
def q_paired_cv(spark, sf):
    """Mean and sample std across seeds of every paired metric."""
    return round_doubles(pa.mean_std(round_doubles(pa.pair(results(spark, sf)))))


@reg("cv_view", SQL_PAIRED + ", cv AS (" + SQL_PAIRED_CV_BODY + ") SELECT prefix, CAST(const_train_size AS DOUBLE) AS const_train_size, frac, "
     + ", ".join(f"{m}_{s}_mean AS {m}_{s}, {m}_{s}_std AS {m}_{s}_std" for s in ("real", "aug") for m in CORE) + " FROM cv")
def q_cv_view(spark, sf):
    """paired_cv reshaped to real/aug means with their std."""
    cv = pa.mean_std(round_doubles(pa.pair(results(spark, sf))))
    return round_doubles(pa.cv_view(cv))


SMP_M = CORE + ["precision", "recall", "accuracy", "specificity"]


@reg("pair_simple", "WITH " + SQL_RESULTS + """,
b AS """ + _sql_last("res", ["prefix", "kind", "frac"], CORE, "NOT used_gan", "_real") + """,
a AS """ + _sql_last("res", ["prefix", "kind", "frac", "const_train_size"], CORE, "used_gan", "_aug") + """
SELECT a.prefix, a.kind, a.frac, a.const_train_size, """
     + ", ".join([f"{sql_r10('b.' + m + '_real')} AS {m}_real" for m in CORE] + [f"{sql_r10('a.' + m + '_aug')} AS {m}_aug" for m in CORE]
                 + [f"{sql_r10(f'a.{m}_aug - b.{m}_real')} AS delta_{m}" for m in CORE])
     + " FROM a LEFT JOIN b ON a.prefix = b.prefix AND a.kind = b.kind AND a.frac = b.frac")
def q_pair_simple(spark, sf):
    """Legacy pairing on (prefix, kind, frac) only."""
    return round_doubles(pa.pair_simple(results(spark, sf)))


# ------------------------------------------------------------------ G4 / G5 / G7 / J5 / R1-R6

SQL_AGG = ("SELECT prefix, const_train_size, frac, variant, "
           + ", ".join(f"{sql_r10(f'avg({m})')} AS {m}_mean, {sql_r10(f'stddev_samp({m})')} AS {m}_std" for m in CORE)
           + " FROM res GROUP BY prefix, const_train_size, frac, variant")


@reg("agg_by_variant", "WITH " + SQL_RESULTS + " " + SQL_AGG)
def q_agg_by_variant(spark, sf):
    """Mean and std per (prefix, const, frac, variant), null const kept as a group."""
    return round_doubles(pa.agg_by_variant(results(spark, sf)))


def _collapse_sql(src: str) -> str:
    parts = []
    for m in CORE:
        between = f"CASE WHEN count(*) > 1 THEN var_samp({m}_mean) ELSE 0.0 END"
        parts.append(f"{sql_r10(f'avg({m}_mean)')} AS {m}_mean")
        var = f"(avg({m}_std * {m}_std) + {between})"
        parts.append(f"{sql_r10(f'sqrt(CASE WHEN {var} IS NOT NULL THEN greatest({var}, 0.0) END)')} AS {m}_std")
    return f"SELECT prefix, frac, variant, {', '.join(parts)} FROM {src} GROUP BY prefix, frac, variant"


@reg("collapse_means", "WITH " + SQL_RESULTS + ", agg AS (SELECT prefix, const_train_size, frac, variant, "
     + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in CORE)
     + " FROM res GROUP BY prefix, const_train_size, frac, variant) " + _collapse_sql("agg"))
def q_collapse_means(spark, sf):
    """Collapse per-variant aggregates over const sizes (pooled std)."""
    agg = pa.agg_by_variant(results(spark, sf))
    out = pa.collapse_means(agg, ["prefix", "frac", "variant"], [(f"{m}_mean", f"{m}_std") for m in CORE])
    return round_doubles(out)


@reg("collapse_means_one_seed", "WITH " + SQL_RESULTS + ", agg AS (SELECT prefix, const_train_size, frac, variant, "
     + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in CORE)
     + " FROM res WHERE seed = 42 GROUP BY prefix, const_train_size, frac, variant) " + _collapse_sql("agg"))
def q_collapse_means_one_seed(spark, sf):
    """G5 where groups have one seed: an unknown std stays unknown."""
    agg = pa.agg_by_variant(results(spark, sf).filter("seed = 42"))
    return round_doubles(pa.collapse_means(agg, ["prefix", "frac", "variant"], [(f"{m}_mean", f"{m}_std") for m in CORE]))


@reg("distinct_label", "WITH " + SQL_RESULTS + """
SELECT prefix, CASE WHEN count(const_train_size) = 0 THEN 'NA'
       ELSE array_to_string(list_sort(list(DISTINCT CAST(CAST(const_train_size AS BIGINT) AS VARCHAR)) FILTER (WHERE const_train_size IS NOT NULL)), '/') END AS label
FROM res GROUP BY prefix""")
def q_distinct_label(spark, sf):
    """Display label of the distinct const sizes per prefix."""
    return pa.distinct_label(results(spark, sf), "const_train_size", ["prefix"])


@reg("align_to", "WITH " + SQL_RESULTS + ", agg AS (SELECT prefix, const_train_size, frac, variant, "
     + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in CORE)
     + " FROM res GROUP BY prefix, const_train_size, frac, variant) "
     + """SELECT b.prefix, b.frac, s.variant, """ + sql_r10("s.auc_mean") + """ AS auc_mean
FROM (SELECT DISTINCT prefix, frac FROM agg WHERE variant = 'real') b
LEFT JOIN (SELECT * FROM agg WHERE variant = 'smote') s ON b.prefix = s.prefix AND b.frac = s.frac""")
def q_align_to(spark, sf):
    """The smote series aligned to the real baseline's fractions."""
    agg = pa.agg_by_variant(results(spark, sf))
    base = agg.filter(F.col("variant") == "real")
    series = agg.filter(F.col("variant") == "smote").select("prefix", "frac", "variant", "auc_mean")
    return round_doubles(pa.align_to(base, series))


@reg("lines_agg", "WITH " + SQL_RESULTS + f"""
SELECT frac, variant, {sql_r10('avg(auc)')} AS auc_mean, {sql_r10('stddev_samp(auc)')} AS auc_std, count(auc) AS n,
       count(DISTINCT test_start) AS n_test_start FROM res GROUP BY frac, variant""")
def q_lines_agg(spark, sf):
    """R2: AUC vs fraction aggregated over windows."""
    return round_doubles(rp.lines_agg(results(spark, sf), "auc", "test_start"))


@reg("delta_matrix", SQL_PAIRED + f"""
SELECT variant, prefix, test_start, {sql_r10('avg(delta_auc)')} AS delta_auc_mean, count(delta_auc) AS n
FROM paired WHERE frac = 0.01 GROUP BY variant, prefix, test_start""")
def q_delta_matrix(spark, sf):
    """Mean AUC delta per (method, cutoff) x window at one fraction."""
    p = round_doubles(pa.pair(results(spark, sf)))
    return round_doubles(rp.delta_matrix(p, "auc", 0.01, "prefix", "test_start"))


@reg("seed_box", "WITH " + SQL_RESULTS + f"""
SELECT prefix, frac, variant, count(auc) AS n, """ + ", ".join(
    f"{sql_r10(f'quantile_cont(auc, {q})')} AS {n}" for q, n in
    ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))) + """
FROM res GROUP BY prefix, frac, variant""")
def q_seed_box(spark, sf):
    """Five-number summary of AUC across seeds and windows."""
    return round_doubles(rp.seed_box(results(spark, sf), "auc"))


def sql_bootstrap(src: str, keys: list[str], unit: str, n_boot: int = 1000, seed: int = 42) -> str:
    """CTEs ending in the bootstrap table ``bt`` of ``src(keys..., unit, delta_auc)``: one row per (unit, replicate) here."""
    k = ", ".join(keys)
    gid = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in keys) + ")"
    h = f"md5('{seed}|' || {gid} || '|' || unit || '|' || CAST(b // {rp.PER_HASH} AS VARCHAR))"
    v = f"(('0x' || substr({h}, CAST(8 * (b % {rp.PER_HASH}) + 1 AS BIGINT), 8))::UBIGINT)::BIGINT"
    weight = " + ".join(f"CAST(v >= {x} AS INTEGER)" for x in rp.POISSON_LIMITS)
    return f"""bu AS (SELECT {k}, {unit} AS unit, delta_auc FROM {src} WHERE delta_auc IS NOT NULL),
bv AS (SELECT {k}, delta_auc, b, {v} AS v
       FROM bu, (SELECT unnest(range({n_boot})) AS b) n),
bw AS (SELECT {k}, b, delta_auc, {weight} AS w FROM bv),
br AS (SELECT {k}, b, sum(w * delta_auc) / sum(w) AS m FROM bw GROUP BY {k}, b HAVING sum(w) > 0),
bc AS (SELECT {k}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi,
              least(1.0, 2.0 * least(avg(CAST(m <= 0 AS DOUBLE)), avg(CAST(m >= 0 AS DOUBLE)))) AS p FROM br GROUP BY {k}),
bn AS (SELECT {k}, count(*) AS n, avg(delta_auc) AS delta_mean FROM bu GROUP BY {k}),
bt AS (SELECT {", ".join(f"bn.{c}" for c in keys)}, n, {sql_round_half_up('delta_mean', 8)} AS delta_mean, {sql_round_half_up('lo', 8)} AS ci_low,
              {sql_round_half_up('hi', 8)} AS ci_high, {sql_round_half_up('p', 8)} AS p_boot,
              CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
       FROM bn LEFT JOIN bc ON {" AND ".join(f"bn.{c} = bc.{c}" for c in keys)})"""


def _round8(df: DataFrame) -> DataFrame:
    return df.select(*[round_half_up(F.col(c), 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@reg("delta_bootstrap", SQL_PAIRED + ", pu AS (SELECT *, CAST(seed AS VARCHAR) || '|' || test_start AS unit FROM paired), "
     + sql_bootstrap("pu", ["prefix", "variant", "frac"], "unit") + " SELECT * FROM bt")
def q_delta_bootstrap(spark, sf):
    """Mean paired AUC delta with a 1000-replicate percentile bootstrap CI and stars."""
    p = round_doubles(pa.pair(results(spark, sf))).withColumn("pair_id", F.concat_ws("|", "seed", "test_start"))
    return _round8(rp.delta_bootstrap(p, "auc", ["prefix", "variant", "frac"], 1000, 42))


N_MATRIX_WINDOWS = 7  # windows that the matrix has columns for


@reg("delta_matrix_wide", SQL_PAIRED + f""",
w AS (SELECT test_start, row_number() OVER (ORDER BY test_start) - 1 AS k FROM (SELECT DISTINCT test_start FROM paired) t)
SELECT variant, prefix, {", ".join(f"{sql_r10(f'avg(CASE WHEN w.k = {i} THEN delta_auc END)')} AS w{i}" for i in range(N_MATRIX_WINDOWS))}
FROM paired JOIN w ON w.test_start = paired.test_start WHERE frac = 0.01 GROUP BY variant, prefix""")
def q_delta_matrix_wide(spark, sf):
    """The matrix of mean AUC deltas, (method, cutoff) x window, at one fraction."""
    p = round_doubles(pa.pair(results(spark, sf)))
    starts = [r[0] for r in p.select("test_start").distinct().orderBy("test_start").limit(N_MATRIX_WINDOWS).collect()]
    starts += [f"none{i}" for i in range(N_MATRIX_WINDOWS - len(starts))]
    return round_doubles(rp.delta_matrix_wide(p, starts, "auc", 0.01, "prefix", "test_start", names=[f"w{i}" for i in range(N_MATRIX_WINDOWS)]))


# ------------------------------------------------------------------ R5 per family

SQL_FAMILY_ROWS = """fr AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_orderpriority AS family, year(o_orderdate) AS yr FROM orders),
ff AS (SELECT DISTINCT family FROM fr WHERE y = 1),
fp AS (SELECT ff.family, yr, row_id, y FROM fr JOIN ff ON fr.y = 0 OR fr.family = ff.family)"""
SQL_FAMILY_DELTAS = "WITH " + SQL_FAMILY_ROWS + f""",
fs AS (SELECT p.family, p.yr, s.seed, v.variant, p.y AS y_true, {grid.sql_fixture_score('s.seed', 'v.variant', 'p.row_id', 'p.y')} AS proba
       FROM fp p, (SELECT unnest([{", ".join(map(str, FIXTURE_SEEDS))}])::INTEGER AS seed) s, (SELECT unnest({list(FIXTURE_VARIANTS)!r}) AS variant) v),
fa AS (SELECT * FROM {sql_ranking('fs', ['family', 'yr', 'seed', 'variant'])} t),
pu AS (SELECT a.family, a.variant, CAST(a.seed AS VARCHAR) || '|' || CAST(a.yr AS VARCHAR) AS unit, {sql_r10(f"{sql_r10('a.auc')} - {sql_r10('b.auc')}")} AS delta_auc
       FROM fa a JOIN fa b ON a.family = b.family AND a.yr = b.yr AND a.seed = b.seed AND b.variant = 'real' WHERE a.variant <> 'real'), """


def family_deltas(spark, sf) -> DataFrame:
    """(family, variant, pair_id, delta_auc): each held-out family's positives against all negatives, by year and seed.

    Scores are counted once per (row's family, year, seed, variant, label, score); the negatives' counts then go to every family.
    """
    o = fx.orders(spark, sf).select("row_id", "y", "family", F.year("ts").alias("yr"))
    preds = grid.fixture_preds(o, FIXTURE_SEEDS, FIXTURE_VARIANTS)
    h = materialize(preds.groupBy("family", "yr", "seed", "variant", "y_true", "proba").agg(F.count(F.lit(1)).alias("n")))
    families = h.where("y_true = 1").select("family").distinct()
    negatives = h.where("y_true = 0").groupBy("yr", "seed", "variant", "y_true", "proba").agg(F.sum("n").alias("n"))
    to_all = negatives.select("*", F.explode(families.agg(F.sort_array(F.collect_set("family")).alias("f")).scalar()).alias("family"))
    counts = h.where("y_true = 1").unionByName(to_all.select(*h.columns))
    keys = ["family", "yr", "seed"]
    auc = ev.ranking_metrics(counts, [*keys, "variant"], weight="n").select(*keys, "variant", r10("auc").alias("auc"))
    base = auc.where("variant = 'real'").select(*keys, F.col("auc").alias("auc_real"))
    return (auc.where("variant <> 'real'").join(base, keys)
            .select("family", "variant", F.concat_ws("|", "seed", "yr").alias("pair_id"), r10(F.col("auc") - F.col("auc_real")).alias("delta_auc")))


@reg("delta_bootstrap_family", SQL_FAMILY_DELTAS + sql_bootstrap("pu", ["family", "variant"], "unit") + " SELECT * FROM bt")
def q_delta_bootstrap_family(spark, sf):
    """Mean AUC delta per held-out family with a bootstrap CI over its (seed, year) pairs."""
    return _round8(rp.delta_bootstrap(family_deltas(spark, sf), "auc", ["family", "variant"], 1000, 42))
