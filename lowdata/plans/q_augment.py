"""Registered queries: augmentation, kNN and vector diagnostics.

Bindings: ``embeddings`` (64-d, y = label 0) for the vector operators; the
events temporal train set for oversampling and budgets.  SQL twins compute
neighbours by brute force (``list_distance``) and reproduce the seeded draws.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lowdata.functions.hashing import round_half_up, sql_normal, sql_round_half_up, sql_uniform
from lowdata.operators import augment as au
from lowdata.operators import knn as kn
from lowdata.operators import sampling as sa
from lowdata.operators import splits as sp
from lowdata.plans.queries import QUERIES
from lowdata.session import scratch_path
from lowdata.sources import fixtures as fx

EMB = fx.SQL_EMBEDDINGS
SEED = 42


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def r6(c):
    return round_half_up(F.col(c) if isinstance(c, str) else c, 6)


def s6(e: str) -> str:
    return sql_round_half_up(e, 6)


def u(stream: str, key: str, seed: int = SEED) -> str:
    return sql_uniform(str(seed), f"'{stream}'", key)


def vsum(c: str):
    return F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)


# ------------------------------------------------------------------ J6 / A7

@reg("knn", f"""
WITH e AS {EMB}, q AS (SELECT * FROM e WHERE y = 0), r AS (SELECT * FROM e WHERE y = 1),
d AS (SELECT q.row_id AS q_id, r.row_id AS nbr_id, list_distance(q.features, r.features) AS dist FROM q CROSS JOIN r),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, nbr_id) AS nbr_rank FROM d)
SELECT q_id, nbr_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, {s6('dist')} AS dist FROM k WHERE nbr_rank <= 3""")
def q_knn(spark, sf):
    """3 nearest positives (Euclidean, ties by id) of every negative embedding."""
    e = fx.embeddings(spark, sf)
    nb = kn.knn(e.filter("y = 0"), e.filter("y = 1"), 3)
    return nb.select("q_id", "nbr_id", "nbr_rank", r6("dist").alias("dist"))


@reg("knn_offset", f"""
WITH e AS {EMB}, o AS (SELECT row_id, y, [CAST(x AS DOUBLE) + 1000000.0 for x in features] AS f FROM e),
q AS (SELECT * FROM o WHERE y = 0), r AS (SELECT * FROM o WHERE y = 1),
d AS (SELECT q.row_id AS q_id, r.row_id AS nbr_id, list_distance(q.f, r.f) AS dist FROM q CROSS JOIN r),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, nbr_id) AS nbr_rank FROM d)
SELECT q_id, nbr_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, {s6('dist')} AS dist FROM k WHERE nbr_rank <= 3""")
def q_knn_offset(spark, sf):
    """J6 far from the origin: every component moved by a million."""
    e = fx.embeddings(spark, sf).withColumn("features", F.transform("features", lambda x: x.cast("double") + 1e6))
    nb = kn.knn(e.filter("y = 0"), e.filter("y = 1"), 3, block_bytes=1 << 14)
    return nb.select("q_id", "nbr_id", "nbr_rank", r6("dist").alias("dist"))


@reg("knn_query_broadcast", f"""
WITH e AS {EMB}, q AS (SELECT * FROM e WHERE y = 1), r AS (SELECT * FROM e WHERE y = 0),
d AS (SELECT q.row_id AS q_id, r.row_id AS nbr_id, list_distance(q.features, r.features) AS dist FROM q CROSS JOIN r),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, nbr_id) AS nbr_rank FROM d)
SELECT q_id, nbr_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, {s6('dist')} AS dist FROM k WHERE nbr_rank <= 2""")
def q_knn_query_broadcast(spark, sf):
    """J6 with the small side as query: partial top-k per reference partition, merged by query id."""
    e = fx.embeddings(spark, sf)
    nb = kn.knn(e.filter("y = 1"), e.filter("y = 0"), 2)
    return nb.select("q_id", "nbr_id", "nbr_rank", r6("dist").alias("dist"))


@reg("nn_dist", f"""
WITH e AS {EMB}, a AS (SELECT * FROM e WHERE CAST(family AS INTEGER) >= 5), b AS (SELECT * FROM e WHERE CAST(family AS INTEGER) < 5)
SELECT a.row_id, {s6('min(list_distance(a.features, b.features))')} AS dist FROM a CROSS JOIN b GROUP BY a.row_id""")
def q_nn_dist(spark, sf):
    """Distance of each label>=5 embedding to the nearest label<5 one."""
    e = fx.embeddings(spark, sf)
    a = e.filter(F.col("family").cast("int") >= 5)
    b = e.filter(F.col("family").cast("int") < 5)
    return kn.nn_dist(a, b).select("row_id", r6("dist").alias("dist"))


@reg("knn_events", f"""
WITH e AS (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y, CAST(value AS DOUBLE) AS a, CAST(user_id AS DOUBLE) AS b FROM events),
q AS (SELECT * FROM e WHERE y = 1), r AS (SELECT * FROM e WHERE y = 0),
d AS (SELECT q.row_id AS q_id, r.row_id AS nbr_id, sqrt((q.a - r.a) * (q.a - r.a) + (q.b - r.b) * (q.b - r.b)) AS dist FROM q CROSS JOIN r),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, nbr_id) AS nbr_rank FROM d)
SELECT q_id, nbr_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, {s6('dist')} AS dist FROM k WHERE nbr_rank <= 2""")
def q_knn_events(spark, sf):
    """J6 in few dimensions, where the pivots rule out most cells: 2 nearest other events of every error event."""
    e = fx.events(spark, sf)
    nb = kn.knn(e.filter("y = 1"), e.filter("y = 0"), 2)
    return nb.select("q_id", "nbr_id", "nbr_rank", r6("dist").alias("dist"))


# ------------------------------------------------------------------ A14 / A6 / A15 / A16

SQL_SCALER = f"""
sc AS (SELECT j, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s
       FROM (SELECT unnest(generate_series(0, len(features) - 1)) AS j, unnest(features) AS x FROM {EMB} e WHERE y = 1)
       GROUP BY j)"""


@reg("fit_scaler", f"WITH {SQL_SCALER} SELECT CAST(j AS INTEGER) AS j, {s6('m')} AS mean, {s6('s')} AS scale FROM sc")
def q_fit_scaler(spark, sf):
    """Per-feature mean and population std (0 -> 1) of the positive embeddings."""
    s = au.fit_scaler(fx.embeddings(spark, sf).filter("y = 1"))
    z = s.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("j", "v"))
    return z.select(F.col("j").cast("int").alias("j"), r6("v.mean").alias("mean"), r6("v.scale").alias("scale"))


@reg("profile_vectors", f"""
SELECT CAST(max(len(features)) AS INTEGER) AS dim, count(*) AS n_values, {s6('avg(x)')} AS mean, {s6('stddev_pop(x)')} AS std,
       {s6('min(x)')} AS min, {s6('max(x)')} AS max, bool_or(isnan(x) OR isinf(x)) AS any_nonfinite
FROM (SELECT features, unnest(features) AS x FROM {EMB} e)""")
def q_profile_vectors(spark, sf):
    """Shape, mean, population std, min, max and any non-finite over all embedding values."""
    p = au.profile_vectors(fx.embeddings(spark, sf))
    return p.select(F.col("dim").cast("int").alias("dim"), "n_values", r6("mean").alias("mean"), r6("std").alias("std"),
                    r6("min").alias("min"), r6("max").alias("max"), "any_nonfinite")


#: Candidates of the quality gates for each positive row, and candidates kept for each.
GEN_TIMES, KEEP_TIMES = 5, 1


def n_positives(spark, sf) -> int:
    return fx.embeddings(spark, sf).filter("y = 1").count()


def diag_candidates(spark, sf):
    s = au.fit_scaler(fx.embeddings(spark, sf).filter("y = 1"))
    return au.sample_diag_gaussian(spark, s, GEN_TIMES * n_positives(spark, sf), SEED)


SQL_POS = f"(SELECT count(*) FROM {EMB} e WHERE y = 1)"
SQL_KEEP = f"({KEEP_TIMES} * {SQL_POS})"
SQL_DIAG = f"""{SQL_SCALER},
gg AS (SELECT unnest(generate_series(0, {GEN_TIMES} * {SQL_POS} - 1)) AS gen_id),
xv AS (SELECT gg.gen_id, sc.j, sc.m + sc.s * {sql_normal(str(SEED), "'diag'", 'gg.gen_id', 'sc.j')} AS v FROM gg CROSS JOIN sc),
cand AS (SELECT gen_id, list(v ORDER BY j) AS features FROM xv GROUP BY gen_id)"""


@reg("diag_gaussian_sample", f"WITH {SQL_DIAG} SELECT gen_id, {s6('list_sum(features)')} AS checksum FROM cand")
def q_diag_gaussian_sample(spark, sf):
    """A16 (re-aimed generator) + A6: diagonal-Gaussian draws from the positives' moments."""
    c = diag_candidates(spark, sf)
    return c.select("gen_id", r6(vsum("features")).alias("checksum"))


@reg("inverse_scale", f"""
WITH {SQL_SCALER}, z AS (SELECT e.row_id, unnest(generate_series(0, len(e.features) - 1)) AS j, unnest(e.features) AS x
                         FROM {EMB} e WHERE y = 0)
SELECT z.row_id, {s6('sum(z.x * sc.s + sc.m)')} AS checksum FROM z JOIN sc ON z.j = sc.j GROUP BY z.row_id""")
def q_inverse_scale(spark, sf):
    """X * scale + mean of the negatives with the positives' scaler (checksum per row)."""
    e = fx.embeddings(spark, sf)
    s = au.fit_scaler(e.filter("y = 1"))
    out = au.inverse_scale(e.filter("y = 0").select("row_id", "features"), s)
    return out.select("row_id", r6(vsum("features")).alias("checksum"))


# ------------------------------------------------------------------ A1 / A11 / A13

def ev_train(spark, sf):
    return sp.temporal_part(fx.events(spark, sf), "2024-01-10 00:00:00", "train")


def scarce_train(spark, sf):
    return sa.scarce_sample(ev_train(spark, sf), 0.05, SEED, 50, 50)


SQL_SCARCE = """(SELECT s.* FROM (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y, value, CAST(user_id AS DOUBLE) AS uid_d
  FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00') s
  JOIN ({scarce}) k ON s.row_id = k.row_id)"""
#: Rows added by oversampling as a share of the train part, of which the scarce set is a twentieth.
OS_SHARE = 0.25
SQL_EV_TRAIN_ROWS = "(SELECT count(*) FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00')"
SQL_OS_TARGET = f"n + CAST(floor({OS_SHARE} * {SQL_EV_TRAIN_ROWS}) AS BIGINT)"


def _sql_scarce_ids():
    from lowdata.plans.q_sampling import EV_TRAIN, sql_scarce
    return sql_scarce(EV_TRAIN, 0.05, SEED, 50, 50)


def sql_oversample(target) -> str:
    return f"""
tr AS {SQL_SCARCE.format(scarce=_sql_scarce_ids())},
c AS (SELECT count(*) AS n, count_if(y = 1) AS p FROM tr),
pos AS (SELECT row_id, value, uid_d, row_number() OVER (ORDER BY {u('os-order', 'row_id')}, row_id) AS pos_rank FROM tr WHERE y = 1),
need AS (SELECT {target} - n AS need, p FROM c),
dr AS (SELECT pos_rank, unnest(range(need * (pos_rank - 1) // p, need * pos_rank // p)) AS draw FROM pos, need),
syn AS (SELECT 'os:' || CAST(dr.draw AS VARCHAR) AS uid, pos.row_id AS src_row_id, pos.value AS x0, pos.uid_d AS x1
        FROM dr JOIN pos ON dr.pos_rank = pos.pos_rank)"""


SQL_OVERSAMPLE = sql_oversample(SQL_OS_TARGET)


def oversampled(spark, sf):
    tr = scarce_train(spark, sf)
    return au.oversample_to_const(tr, tr.count() + int(OS_SHARE * ev_train(spark, sf).count()), SEED)


@reg("oversample", f"WITH {SQL_OVERSAMPLE} SELECT uid, src_row_id, x0, x1 FROM syn")
def q_oversample(spark, sf):
    """A1: scarce temporal train set grown by a quarter of the train part's rows, drawn from its positives."""
    a = oversampled(spark, sf).filter("is_synth")
    return a.select("uid", "src_row_id", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@reg("with_synth", f"""WITH {SQL_OVERSAMPLE}
SELECT false AS is_synth, y, count(*) AS n FROM tr GROUP BY y UNION ALL SELECT true, 1, count(*) FROM syn""")
def q_with_synth(spark, sf):
    """Real and synthetic row counts of the augmented set."""
    return oversampled(spark, sf).groupBy("is_synth", "y").agg(F.count(F.lit(1)).alias("n"))


@reg("dup_ratio", f"""WITH {SQL_OVERSAMPLE},
allrows AS (SELECT value AS x0, uid_d AS x1 FROM tr UNION ALL SELECT x0, x1 FROM syn)
SELECT {s6('1.0 - count(DISTINCT [x0, x1]) / count(*)')} AS dup_ratio FROM allrows""")
def q_dup_ratio(spark, sf):
    """Duplicate ratio of the oversampled train set."""
    return au.dup_ratio(oversampled(spark, sf)).select(r6("dup_ratio").alias("dup_ratio"))


#: Rows after oversampling for each scarce row.
OS_TIMES = 2
SQL_OVERSAMPLE_GROWN = sql_oversample(f"{OS_TIMES} * (SELECT n FROM c)")


def oversampled_grown(spark, sf, draws: str = "dealt"):
    tr = scarce_train(spark, sf)
    return au.oversample_to_const(tr, OS_TIMES * tr.count(), SEED, draws)


SQL_OVERSAMPLE_RANDOM = f"""
tr AS {SQL_SCARCE.format(scarce=_sql_scarce_ids())},
c AS (SELECT count(*) AS n, count_if(y = 1) AS p FROM tr),
pos AS (SELECT row_id, value, uid_d, row_number() OVER (ORDER BY {u('os-order', 'row_id')}, row_id) AS pos_rank FROM tr WHERE y = 1),
dr AS (SELECT draw, CAST(floor({u('os', 'draw')} * c.p) + 1 AS BIGINT) AS pos_rank
       FROM c, (SELECT unnest(generate_series(0, {OS_TIMES} * (SELECT n FROM c) - (SELECT n FROM c) - 1)) AS draw)),
syn AS (SELECT 'os:' || CAST(dr.draw AS VARCHAR) AS uid, pos.row_id AS src_row_id, pos.value AS x0, pos.uid_d AS x1
        FROM dr JOIN pos ON dr.pos_rank = pos.pos_rank)"""


@reg("oversample_grown", f"WITH {SQL_OVERSAMPLE_RANDOM} SELECT uid, src_row_id, x0, x1 FROM syn")
def q_oversample_grown(spark, sf):
    """A1: scarce temporal train set grown to twice its rows, each new one a random draw (with replacement) of its positives."""
    a = oversampled_grown(spark, sf, "random").filter("is_synth")
    return a.select("uid", "src_row_id", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@reg("with_synth_grown", f"""WITH {SQL_OVERSAMPLE_GROWN}
SELECT false AS is_synth, y, count(*) AS n FROM tr GROUP BY y UNION ALL SELECT true, 1, count(*) FROM syn""")
def q_with_synth_grown(spark, sf):
    """Real and synthetic row counts of the set grown to twice its rows."""
    return oversampled_grown(spark, sf).groupBy("is_synth", "y").agg(F.count(F.lit(1)).alias("n"))


@reg("dup_ratio_grown", f"""WITH {SQL_OVERSAMPLE_GROWN},
allrows AS (SELECT value AS x0, uid_d AS x1 FROM tr UNION ALL SELECT x0, x1 FROM syn)
SELECT {s6('1.0 - count(DISTINCT [x0, x1]) / count(*)')} AS dup_ratio FROM allrows""")
def q_dup_ratio_grown(spark, sf):
    """Duplicate ratio of the train set grown to twice its rows."""
    return au.dup_ratio(oversampled_grown(spark, sf)).select(r6("dup_ratio").alias("dup_ratio"))


# ------------------------------------------------------------------ A2 / A12

SMOTE_TIMES = 3  # points for each positive
SQL_SMOTE = f"""
tr AS {EMB},
c AS (SELECT count(*) AS n, count_if(y = 1) AS p FROM tr),
pos AS (SELECT row_id, features, row_number() OVER (ORDER BY {u('sm-order', 'row_id')}, row_id) AS pos_rank FROM tr WHERE y = 1),
nb AS (SELECT a.row_id AS q_id, b.row_id AS nbr_id,
              row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features), b.row_id) AS nbr_rank
       FROM pos a CROSS JOIN pos b),
kk AS (SELECT least(5, greatest(1, p - 1)) AS k_eff FROM c),
cands AS (SELECT q_id, list(nbr_id ORDER BY nbr_rank) AS cands FROM nb, kk WHERE nbr_rank <= k_eff AND nbr_id <> q_id GROUP BY q_id),
dr AS (SELECT unnest(range({SMOTE_TIMES} * p * (pos_rank - 1) // p, {SMOTE_TIMES} * p * pos_rank // p)) AS draw, pos_rank, row_id AS base_id, p FROM pos, c),
d2 AS (SELECT dr.*, coalesce(len(cands.cands), 0) AS nc, cands.cands FROM dr LEFT JOIN cands ON cands.q_id = dr.base_id),
d3 AS (SELECT *, CASE WHEN nc > 0 THEN cands[CAST(floor({u('sm-j', 'draw')} * nc) + 1 AS INTEGER)] END AS nbr_direct,
              CAST(floor({u('sm-alt', 'base_id')} * (p - 1)) + 1 AS BIGINT) AS alt0, {u('sm-t', 'draw')} AS t FROM d2),
d4 AS (SELECT d3.*, coalesce(nbr_direct, pa.row_id) AS nbr_id FROM d3
       LEFT JOIN pos pa ON nc = 0 AND pa.pos_rank = CASE WHEN alt0 >= d3.pos_rank THEN alt0 + 1 ELSE alt0 END),
syn AS (SELECT 'sm:' || CAST(d4.draw AS VARCHAR) AS uid, d4.base_id AS src_row_id, d4.nbr_id AS nbr, d4.t,
               list_transform(list_zip(xi.features, xj.features, list_resize([d4.t], len(xi.features), d4.t)),
                              lambda z: z[1] + z[3] * (z[2] - z[1])) AS x
        FROM d4 JOIN pos xi ON xi.row_id = d4.base_id JOIN pos xj ON xj.row_id = d4.nbr_id)"""


def smoted(spark, sf):
    e = fx.embeddings(spark, sf)
    return au.smote_to_const(e, e.count() + SMOTE_TIMES * n_positives(spark, sf), SEED, 5)


@reg("smote", f"""WITH {SQL_SMOTE}
SELECT uid, src_row_id, nbr, {s6('t')} AS t, {s6('list_sum(x)')} AS checksum, {s6('x[1]')} AS x0 FROM syn""")
def q_smote(spark, sf):
    """A2: three SMOTE points a positive embedding, between it and one of its 4 nearest positives."""
    a = smoted(spark, sf).filter("is_synth")
    return a.select("uid", "src_row_id", F.col("_nbr").alias("nbr"), r6("_t").alias("t"),
                    r6(vsum("features")).alias("checksum"), r6(F.col("features")[0]).alias("x0"))


@reg("smote_segment_check", f"""WITH {SQL_SMOTE}
SELECT count(*) AS n_synth, count_if(t > 0 AND t < 1) AS n_inside FROM syn""")
def q_smote_segment_check(spark, sf):
    """A2 invariant: every SMOTE point lies on a segment between two positives (0 < t < 1)."""
    a = smoted(spark, sf).filter("is_synth")
    return a.agg(F.count(F.lit(1)).alias("n_synth"), F.count_if((F.col("_t") > 0) & (F.col("_t") < 1)).alias("n_inside"))


@reg("smote_nn_median", f"""WITH {SQL_SMOTE},
dd AS (SELECT s.uid, min(list_distance(s.x, p.features)) AS d FROM syn s CROSS JOIN pos p GROUP BY s.uid)
SELECT {s6('quantile_cont(d, 0.5)')} AS smote_med_nn_dist FROM dd""")
def q_smote_nn_median(spark, sf):
    """Median distance of the SMOTE points to their nearest real positive."""
    a = smoted(spark, sf).drop("_nbr", "_t", "_draw")
    return au.smote_nn_median(a).select(r6("smote_med_nn_dist").alias("smote_med_nn_dist"))


# ------------------------------------------------------------------ A3

@reg("augment_budget", """
WITH n AS (SELECT count_if(event_type = 'error') AS p, count(*) AS n FROM events
           WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00'),
g AS (SELECT f.frac, v.variant, greatest(1, CAST(round_even(f.frac * n.n, 0) AS BIGINT)) AS n_real,
             greatest(1, CAST(round_even(f.frac * n.p, 0) AS BIGINT)) AS n_real_pos
      FROM n CROSS JOIN (VALUES (CAST(0.001 AS DOUBLE)), (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) f(frac)
      CROSS JOIN (VALUES ('real'), ('gan'), ('oversample'), ('smote')) v(variant))
SELECT CAST(frac AS DOUBLE) AS frac, variant, n_real, n_real_pos,
  CASE WHEN variant = 'real' THEN 0
       WHEN variant = 'gan' THEN least(CASE WHEN 2000 > n_real THEN 2000 - n_real ELSE 0 END, CAST(floor(2.0 * greatest(1, n_real_pos)) AS BIGINT))
       ELSE CASE WHEN 2000 > n_real THEN 2000 - n_real ELSE 0 END END AS n_synth
FROM g""")
def q_augment_budget(spark, sf):
    """A3: synthetic rows per run (const 2000, GAN capped at 2 per real positive)."""
    from lowdata.plans.grid import explode_values
    c = ev_train(spark, sf).agg(F.count_if(F.col("y") == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    g = explode_values(c, "frac", (0.001, 0.01, 0.05), "double")
    g = explode_values(g, "variant", ("real", "gan", "oversample", "smote"), "string")
    g = g.withColumn("n_real", F.greatest(F.lit(1), F.bround(F.col("frac") * F.col("n"), 0).cast("long")))
    g = g.withColumn("n_real_pos", F.greatest(F.lit(1), F.bround(F.col("frac") * F.col("p"), 0).cast("long")))
    g = g.withColumn("n_synth", au.augment_budget("n_real", "n_real_pos", F.lit(2000), "variant", per_real=2))
    return g.select("frac", "variant", "n_real", "n_real_pos", "n_synth")


# ------------------------------------------------------------------ A8-A10, A17 quality gate

def n_keep(spark, sf) -> int:
    return KEEP_TIMES * n_positives(spark, sf)


@reg("quality_gate_none", f"WITH {SQL_DIAG} SELECT gen_id, {s6('list_sum(features)')} AS checksum FROM cand WHERE gen_id < {SQL_KEEP}")
def q_quality_gate_none(spark, sf):
    """Quality 'none' keeps the first n candidates; checksum of their features."""
    kept = au.quality_gate(diag_candidates(spark, sf), n_keep(spark, sf), "none")
    return kept.select("gen_id", r6(vsum("features")).alias("checksum"))


@reg("quality_gate_nn", f"""WITH {SQL_DIAG},
pos AS (SELECT features FROM {EMB} e WHERE y = 1),
d AS (SELECT c.gen_id, min(list_distance(c.features, p.features)) AS dpos FROM cand c CROSS JOIN pos p GROUP BY c.gen_id)
SELECT gen_id FROM d QUALIFY row_number() OVER (ORDER BY dpos, gen_id) <= {SQL_KEEP}""")
def q_quality_gate_nn(spark, sf):
    """The n candidates closest to the positive set."""
    e = fx.embeddings(spark, sf)
    pos, _ = au.gate_sets(e, None, "full")
    return au.quality_gate(diag_candidates(spark, sf), n_keep(spark, sf), "nn", pos).select("gen_id")


@reg("quality_gate_boundary", f"""WITH {SQL_DIAG},
pos AS (SELECT features FROM {EMB} e WHERE y = 1), neg AS (SELECT features FROM {EMB} e WHERE y = 0),
dp AS (SELECT c.gen_id, min(list_distance(c.features, p.features)) AS dpos FROM cand c CROSS JOIN pos p GROUP BY c.gen_id),
dn AS (SELECT c.gen_id, min(list_distance(c.features, n.features)) AS dneg FROM cand c CROSS JOIN neg n GROUP BY c.gen_id),
d AS (SELECT dp.gen_id, dpos, dneg FROM dp JOIN dn ON dp.gen_id = dn.gen_id),
q AS (SELECT quantile_cont(dpos, 0.5) AS med, quantile_cont(dneg, 0.2) AS lo, quantile_cont(dneg, 0.6) AS hi FROM d),
k AS (SELECT d.*, (dpos <= med AND dneg >= lo AND dneg <= hi) AS ok FROM d CROSS JOIN q),
nok AS (SELECT count_if(ok) AS n_ok FROM k),
pick AS (SELECT gen_id, row_number() OVER (ORDER BY {u('gate', 'gen_id')}, gen_id) AS rn FROM k WHERE ok),
fill AS (SELECT gen_id, row_number() OVER (ORDER BY dpos, gen_id) AS rn FROM k WHERE NOT ok)
SELECT gen_id FROM pick, nok WHERE n_ok >= {SQL_KEEP} AND rn <= {SQL_KEEP}
UNION ALL SELECT gen_id FROM k, nok WHERE n_ok < {SQL_KEEP} AND ok
UNION ALL SELECT gen_id FROM fill, nok WHERE n_ok < {SQL_KEEP} AND rn <= {SQL_KEEP} - n_ok""")
def q_quality_gate_boundary(spark, sf):
    """A10: on-manifold and near-boundary candidates (median / 20-60% quantile rule)."""
    e = fx.embeddings(spark, sf)
    pos, neg = au.gate_sets(e, None, "full")
    return au.quality_gate(diag_candidates(spark, sf), n_keep(spark, sf), "nn_boundary", pos, neg, seed=SEED).select("gen_id")


# ------------------------------------------------------------------ A5 generator

ZDIM, HIDDEN = 16, 32


def _n_latent(spark, sf) -> int:
    """Candidates for a budget of one synthetic row per real positive, qmult 5."""
    return au.n_candidates(n_positives(spark, sf), 5.0)


@reg("latents", f"""
WITH n AS (SELECT CAST(ceil(5.0 * count(*)) AS BIGINT) AS n FROM {EMB} e WHERE y = 1),
z AS (SELECT g.gen_id, j.j FROM n, LATERAL (SELECT unnest(generate_series(0, n.n - 1)) AS gen_id) g,
      (SELECT unnest(generate_series(0, {ZDIM} - 1)) AS j) j)
SELECT gen_id, {s6(f"sum({sql_normal(str(SEED), "'z'", 'gen_id', 'j')})")} AS z_sum FROM z GROUP BY gen_id""")
def q_latents(spark, sf):
    """A5 input: seeded standard-normal latents, 5 per real positive embedding."""
    z = au.latents(spark, _n_latent(spark, sf), ZDIM, SEED)
    return z.select("gen_id", r6(vsum("z")).alias("z_sum"))


def mlp_layers(dim: int, seed: int = SEED):
    """A user-supplied parameter table stand-in: ReLU MLP weights from seeded hashes."""
    import hashlib

    import numpy as np

    def mat(name, r, c, scale):
        v = [int(hashlib.md5(f"{seed}|{name}|{i}".encode()).hexdigest()[:13], 16) / 2 ** 52 - 0.5 for i in range(r * c)]
        return np.asarray(v).reshape(r, c) * scale

    sizes = [ZDIM, HIDDEN, HIDDEN, dim]
    return [(mat(f"w{i}", sizes[i], sizes[i + 1], 2.0 / sizes[i] ** 0.5), mat(f"b{i}", 1, sizes[i + 1], 0.1)[0])
            for i in range(3)]


def _sql_weights(name: str, rows: int, cols: int, scale: float) -> str:
    """The twin of ``mlp_layers``: one row (i, j, w) per weight."""
    h = f"md5('{SEED}|{name}|' || CAST(i * {cols} + j AS VARCHAR))"
    return (f"(SELECT i, j, (('0x' || substr({h}, 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 - 0.5) * {scale!r} AS w "
            f"FROM (SELECT unnest(generate_series(0, {rows} - 1)) AS i) a, (SELECT unnest(generate_series(0, {cols} - 1)) AS j) b)")


def _sql_mlp(dim: int) -> str:
    sizes = [ZDIM, HIDDEN, HIDDEN, dim]
    steps = []
    for k in range(3):
        src = "(SELECT gen_id, j AS i, x FROM h0)" if k == 0 else f"(SELECT gen_id, j AS i, greatest(x, 0.0) AS x FROM h{k})"
        steps.append(f"""h{k + 1} AS (SELECT h.gen_id, w.j, sum(h.x * w.w) + any_value(b.w) AS x FROM {src} h
  JOIN {_sql_weights(f'w{k}', sizes[k], sizes[k + 1], 2.0 / sizes[k] ** 0.5)} w ON h.i = w.i
  JOIN {_sql_weights(f'b{k}', 1, sizes[k + 1], 0.1)} b ON w.j = b.j GROUP BY h.gen_id, w.j)""")
    return ",\n".join(steps)


@reg("gan_candidates", f"""WITH {SQL_SCALER}, np AS (SELECT CAST(ceil(5.0 * count(*)) AS BIGINT) AS n FROM {EMB} e WHERE y = 1),
h0 AS (SELECT g.gen_id, j.j, {sql_normal(str(SEED), "'z'", 'g.gen_id', 'j.j')} AS x
       FROM np, LATERAL (SELECT unnest(generate_series(0, np.n - 1)) AS gen_id) g, (SELECT unnest(generate_series(0, {ZDIM} - 1)) AS j) j),
{_sql_mlp(64)}
SELECT gen_id, {s6('sum(h3.x * sc.s + sc.m)')} AS checksum FROM h3 JOIN sc ON h3.j = sc.j GROUP BY gen_id""")
def q_gan_candidates(spark, sf):
    """A5 + A6: MLP generator over the latents (broadcast weights, NumPy batches), inverse-scaled
    with the positives' scaler."""
    e = fx.embeddings(spark, sf)
    g = au.generate(spark, mlp_layers(64), _n_latent(spark, sf), SEED)
    x = au.inverse_scale(g, au.fit_scaler(e.filter("y = 1")))
    return x.select("gen_id", r6(vsum("features")).alias("checksum"))


@reg("gmm_sample", None)
def q_gmm_sample(spark, sf):
    """A16 (gmm): PCA + GaussianMixture fitted on the positive embeddings, 5 draws per positive."""
    e = fx.embeddings(spark, sf).filter("y = 1")
    params = au.fit_sampler(e, "gmm", k=3, dims=8, seed=SEED)
    g = au.sample_gmm(spark, params, _n_latent(spark, sf), SEED)
    return g.select("gen_id", "component", r6(vsum("features")).alias("checksum"))


GMM_TIMES = 100  # draws for each positive: enough for the bounds below


@reg("gmm_moments_check", f"""
WITH p AS (SELECT count(*) AS p FROM {EMB} e WHERE y = 1), f AS (SELECT max(len(features)) AS d FROM {EMB} e WHERE y = 1)
SELECT {GMM_TIMES} * p AS n_gen, CAST(d AS INTEGER) AS n_features, CAST(d AS INTEGER) AS means_agree, CAST(d AS INTEGER) AS variances_agree,
       3 AS components_agree FROM p, f""")
def q_gmm_moments_check(spark, sf):
    """A16 (gmm): draws have the positives' feature means (within 6 standard errors) and variances (within a
    quarter), and the mixture's component shares (within 6 standard errors)."""
    e = fx.embeddings(spark, sf).filter("y = 1")
    params = au.fit_sampler(e, "gmm", k=3, dims=8, seed=SEED)
    n = GMM_TIMES * e.count()
    g = au.sample_gmm(spark, params, n, SEED)
    both = (au.fit_scaler(e).select(F.posexplode(F.arrays_zip("mean", "scale")).alias("j", "a"))
            .join(au.fit_scaler(g).select(F.posexplode(F.arrays_zip("mean", "scale")).alias("j", "b")), "j"))
    near = F.abs(F.col("a.mean") - F.col("b.mean")) <= 6 * F.col("a.scale") / F.lit(n) ** 0.5
    # the draws follow the mixture's variance, which divides by p - 1
    ratio = (F.col("b.scale") / F.col("a.scale")) ** 2
    moments = both.agg(F.count(F.lit(1)).cast("int").alias("n_features"), F.count_if(near).cast("int").alias("means_agree"),
                       F.count_if(F.abs(ratio - 1) <= 0.25).cast("int").alias("variances_agree"))
    share = F.create_map(*[x for i, w in enumerate(params["weights"]) for x in (F.lit(i), F.lit(float(w)))])
    parts = g.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("w", share[F.col("component")])
    close = F.abs(F.col("n") / n - F.col("w")) <= 6 * F.sqrt(F.col("w") * (1 - F.col("w")) / n)
    shares = parts.agg(F.sum("n").alias("n_gen"), F.count_if(close).cast("int").alias("components_agree"))
    return shares.crossJoin(moments).select("n_gen", "n_features", "means_agree", "variances_agree", "components_agree")


@reg("gan_candidates_stored", QUERIES["gan_candidates"][1])
def q_gan_candidates_stored(spark, sf):
    """A5: the generator fed by a written parameter table (layer, row, values), read and checked before the broadcast."""
    path = scratch_path(spark, "generator-layers")
    au.layers_table(spark, mlp_layers(64)).write.mode("overwrite").parquet(path)
    e = fx.embeddings(spark, sf)
    g = au.generate(spark, au.read_layers(spark.read.parquet(path)), _n_latent(spark, sf), SEED)
    return au.inverse_scale(g, au.fit_scaler(e.filter("y = 1"))).select("gen_id", r6(vsum("features")).alias("checksum"))
