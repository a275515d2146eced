"""Registered queries: exact-size samplers.

The SQL twins use the plain single window ``row_number() OVER (PARTITION BY
class ORDER BY u, row_id)`` that the Spark operators compute without a
single-task window.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lowdata.functions.hashing import sql_uniform
from lowdata.operators import ranking as rk
from lowdata.operators import sampling as sa
from lowdata.operators import splits as sp
from lowdata.plans.queries import QUERIES
from lowdata.sources import fixtures as fx


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def u(seed: int, stream: str, key: str = "row_id") -> str:
    return sql_uniform(str(seed), f"'{stream}'", key)


EV = fx.SQL_EVENTS
EV_TRAIN = f"(SELECT * FROM {EV} e WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00')"


def sql_largest_remainder(counts: str, total_expr: str, out: str = "quota") -> str:
    """counts(y, n_c) -> (y, n_c, n, quota) with floor + largest remainders (ties by class)."""
    return f"""(SELECT y, n_c, n, CAST(fl + CASE WHEN r <= need THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM (
      SELECT *, row_number() OVER (ORDER BY cont - fl DESC, y) AS r, tot - sum(fl) OVER () AS need FROM (
        SELECT *, floor(cont) AS fl FROM (
          SELECT y, n_c, n, tot, CAST(n_c AS DOUBLE) * CAST(tot AS DOUBLE) / CAST(n AS DOUBLE) AS cont FROM (
            SELECT y, n_c, n, CAST({total_expr} AS BIGINT) AS tot FROM (
              SELECT y, n_c, sum(n_c) OVER () AS n FROM {counts}) a) b) c) d) e)"""


# ------------------------------------------------------------------ D5

@reg("stratified_split", f"""
WITH s AS {EV}, cc AS (SELECT y, count(*) AS n_c FROM s GROUP BY y),
q AS {sql_largest_remainder('cc', 'n - ceil(CAST(0.25 AS DOUBLE) * n)', 'q_train')},
r AS (SELECT s.row_id, s.y, row_number() OVER (PARTITION BY s.y ORDER BY {u(42, 'split', 's.row_id')}, s.row_id) AS rn FROM s)
SELECT r.row_id, CASE WHEN r.rn <= q.n_c - q.q_train THEN 'test' ELSE 'train' END AS part
FROM r JOIN q ON r.y = q.y""")
def q_stratified_split(spark, sf):
    """Stratified 25% test split of events (class proportions kept exactly)."""
    return sa.stratified_split(fx.events(spark, sf), "y", 0.25, 42).select("row_id", "part")


@reg("stratified_sample", f"""
WITH s AS {fx.SQL_ORDERS}, cc AS (SELECT y, count(*) AS n_c FROM s GROUP BY y),
q AS {sql_largest_remainder('cc', 'floor(CAST(0.2 AS DOUBLE) * n)')},
r AS (SELECT s.row_id, s.y, row_number() OVER (PARTITION BY s.y ORDER BY {u(7, 'subsample', 's.row_id')}, s.row_id) AS rn FROM s)
SELECT r.row_id, r.y FROM r JOIN q ON r.y = q.y WHERE r.rn <= q.quota""")
def q_stratified_sample(spark, sf):
    """Exact stratified 20% subsample of orders."""
    return sa.stratified_sample(fx.orders(spark, sf), "y", 0.2, 7).select("row_id", "y")


@reg("stratified_folds", f"""
SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {u(42, 'fold')}, row_id) - 1) % 5 AS INTEGER) AS fold
FROM {EV} s""")
def q_stratified_folds(spark, sf):
    """D16 + W4: per-class hash rank mod 5 as the fold (exact rank, bucketed windows)."""
    return sa.stratified_folds(fx.events(spark, sf), "y", 5, 42).select("row_id", "y", "fold")


@reg("hash_rank", f"""
SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {u(3, 'rank')}, row_id) AS rank FROM {fx.SQL_ORDERS} s""")
def q_hash_rank(spark, sf):
    """Exact per-class rank by seeded hash (histogram offsets + in-bucket row_number)."""
    d = sa.with_u(fx.orders(spark, sf), 3, "rank")
    return rk.hash_rank(d, "y", "u", "row_id", out="rank").select("row_id", "y", "rank")


@reg("val_split", f"""
WITH s AS {EV_TRAIN}, cc AS (SELECT y, count(*) AS n_c FROM s GROUP BY y),
q AS {sql_largest_remainder('cc', 'n - ceil(CAST(0.2 AS DOUBLE) * n)', 'q_train')},
r AS (SELECT s.row_id, s.y, row_number() OVER (PARTITION BY s.y ORDER BY {u(1337, 'split', 's.row_id')}, s.row_id) AS rn FROM s)
SELECT r.row_id, CASE WHEN r.rn <= q.n_c - q.q_train THEN 'val' ELSE 'train' END AS part
FROM r JOIN q ON r.y = q.y""")
def q_val_split(spark, sf):
    """Stratified 20% validation split of the temporal train set."""
    tr = sp.temporal_part(fx.events(spark, sf), "2024-01-10 00:00:00", "train")
    return sa.val_split(tr, "y", 1337).select("row_id", "part")


# ------------------------------------------------------------------ D12

def sql_scarce(src: str, frac: float, seed: int, min_pos: int, min_neg: int) -> str:
    return f"""
WITH s AS {src}, c AS (SELECT count_if(y = 1) AS P, count_if(y = 0) AS Q FROM s),
a AS (SELECT P, Q, greatest(1, CAST(round_even(CAST({frac!r} AS DOUBLE) * CAST(P + Q AS DOUBLE), 0) AS BIGINT)) AS n_total,
             CAST(P AS DOUBLE) / CAST(greatest(1, P + Q) AS DOUBLE) AS prior FROM c),
b AS (SELECT *, least(P, greatest({min_pos}, CAST(round_even(n_total * prior, 0) AS BIGINT))) AS n_pos0 FROM a),
b2 AS (SELECT *, least(Q, greatest({min_neg}, n_total - n_pos0)) AS n_neg FROM b),
qq AS (SELECT n_neg, n_pos0 + greatest(0, least(P - n_pos0, n_total - n_pos0 - n_neg)) AS n_pos FROM b2),
r AS (SELECT s.row_id, s.y, row_number() OVER (PARTITION BY s.y ORDER BY {u(seed, 'scarce', 's.row_id')}, s.row_id) AS rn FROM s)
SELECT r.row_id, r.y FROM r CROSS JOIN qq WHERE (r.y = 1 AND r.rn <= qq.n_pos) OR (r.y = 0 AND r.rn <= qq.n_neg)"""


@reg("scarce_sample", sql_scarce(EV_TRAIN, 0.05, 42, 50, 50))
def q_scarce_sample(spark, sf):
    """Exact-size scarce subsample (5%, floors 50/50) of the temporal train set."""
    tr = sp.temporal_part(fx.events(spark, sf), "2024-01-10 00:00:00", "train")
    return sa.scarce_sample(tr, 0.05, 42, 50, 50).select("row_id", "y")


@reg("scarce_sample_floor", sql_scarce(fx.SQL_DOCUMENTS, 0.01, 2025, 5, 5))
def q_scarce_sample_floor(spark, sf):
    """D12 where the floors bind (1% of the labelled documents, floors 5/5)."""
    return sa.scarce_sample(fx.documents(spark, sf), 0.01, 2025, 5, 5).select("row_id", "y")


# ------------------------------------------------------------------ D13 / D18 / D19

@reg("class_sample", f"""
SELECT row_id, y FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {u(42, 'class')}, row_id) AS rn
                       FROM {EV} s) WHERE rn <= 1000""")
def q_class_sample(spark, sf):
    """1000 rows per class."""
    return sa.class_sample(fx.events(spark, sf), 1000, 42).select("row_id", "y")


@reg("capped_subset", f"""
SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {u(42, 'cap')}, row_id) AS rn
                    FROM {EV} s WHERE y = 1) WHERE rn <= 500""")
def q_capped_subset(spark, sf):
    """Uniform cap of 500 positives."""
    pos = fx.events(spark, sf).filter(F.col("y") == 1)
    return sa.capped_subset(pos, 500, 42).select("row_id")


FAM_CAP = 1000
SQL_FAMILY_CAP = f"""
WITH s AS (SELECT * FROM {fx.SQL_ORDERS} o WHERE y = 1),
n AS (SELECT count(*) AS n FROM s),
f AS (SELECT family, count(*) AS n_f FROM s GROUP BY family),
q AS (SELECT family, CAST(least(n_f, greatest(1, floor(CAST({FAM_CAP} AS DOUBLE) * n_f / CAST(n AS DOUBLE)))) AS BIGINT) AS quota
      FROM f CROSS JOIN n),
r AS (SELECT s.row_id, s.family, row_number() OVER (PARTITION BY s.family ORDER BY {u(42, 'fam', 's.row_id')}, s.row_id) AS rn FROM s),
taken AS (SELECT r.row_id FROM r JOIN q ON r.family = q.family WHERE r.rn <= q.quota),
t AS (SELECT count(*) AS t FROM taken),
rest AS (SELECT row_id, row_number() OVER (ORDER BY {u(42, 'fill')}, row_id) AS rn FROM s WHERE row_id NOT IN (SELECT row_id FROM taken)),
trimmed AS (SELECT row_id, row_number() OVER (ORDER BY {u(42, 'trim')}, row_id) AS rn FROM taken)
SELECT row_id FROM s WHERE (SELECT n FROM n) <= {FAM_CAP}
UNION ALL SELECT row_id FROM taken WHERE (SELECT n FROM n) > {FAM_CAP} AND (SELECT t FROM t) <= {FAM_CAP}
UNION ALL SELECT row_id FROM rest WHERE (SELECT n FROM n) > {FAM_CAP} AND (SELECT t FROM t) < {FAM_CAP} AND rn <= {FAM_CAP} - (SELECT t FROM t)
UNION ALL SELECT row_id FROM trimmed WHERE (SELECT n FROM n) > {FAM_CAP} AND (SELECT t FROM t) > {FAM_CAP} AND rn <= {FAM_CAP}"""


@reg("family_capped_subset", SQL_FAMILY_CAP)
def q_family_capped_subset(spark, sf):
    """Family-proportional cap of 1000 positive orders (family = priority)."""
    pos = fx.orders(spark, sf).filter(F.col("y") == 1)
    return sa.family_capped_subset(pos, FAM_CAP, 42).select("row_id")


# ------------------------------------------------------------------ A4

@reg("rebalance", f"""
WITH s AS {EV_TRAIN}, c AS (SELECT count_if(y = 1) AS P, count_if(y = 0) AS Q FROM s),
k AS (SELECT P, Q, CAST(round_even(CAST(least(P, Q) AS DOUBLE) * 1.0, 0) AS BIGINT) AS keep FROM c),
q AS (SELECT CASE WHEN P > 0 AND Q > 0 AND P > Q THEN least(P, keep) ELSE P END AS qp,
             CASE WHEN P > 0 AND Q > 0 AND P <= Q THEN least(Q, keep) ELSE Q END AS qn FROM k),
r AS (SELECT s.row_id, s.y, row_number() OVER (PARTITION BY s.y ORDER BY {u(42, 'rebalance', "concat('r:', CAST(s.row_id AS VARCHAR))")}, concat('r:', CAST(s.row_id AS VARCHAR))) AS rn FROM s)
SELECT r.row_id, r.y FROM r CROSS JOIN q WHERE (r.y = 1 AND r.rn <= q.qp) OR (r.y = 0 AND r.rn <= q.qn)""")
def q_rebalance(spark, sf):
    """A4: trim the majority class of the temporal train set to the minority size."""
    from lowdata.operators.augment import as_train
    tr = sp.temporal_part(fx.events(spark, sf), "2024-01-10 00:00:00", "train")
    return sa.rebalance(as_train(tr), 1.0, 42).select("row_id", "y")
