"""Registered queries: splits, cutoff scans, windows, verification, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowdata.functions.columns import month_tag
from lowdata.functions.hashing import sql_md5_bucket, sql_md5_unit
from lowdata.operators import sampling as sa
from lowdata.operators import splits as sp
from lowdata.plans.queries import QUERIES, sql_ts_text, ts_text
from lowdata.sources import fixtures as fx

ORDERS_CUTOFF = "1998-01-01 00:00:00"
ORDERS_SCAN = ("1995-01-01", "2001-08-31")
HELD_FAMILIES = ("src3", "src7")
LOFO_MIN_POS = 3


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- D1 / D6

@reg("temporal_holdout", f"""
SELECT event_id AS row_id, CASE WHEN ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00' THEN 'train' ELSE 'test' END AS part
FROM events""")
def q_temporal_holdout(spark, sf):
    """D1 on events: every row's part."""
    return sp.temporal_holdout(fx.events(spark, sf), "2024-01-10 00:00:00").select("row_id", "part")


@reg("describe_split", f"""
SELECT count(*) AS n_total, count_if(part = 'train') AS n_train, count_if(part = 'test') AS n_test,
       round_even(100.0 * count_if(part = 'test') / greatest(1, count(*)), 3) AS pct_test
FROM (SELECT CASE WHEN o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '{ORDERS_CUTOFF}' THEN 'train' ELSE 'test' END AS part
      FROM orders)""")
def q_describe_split(spark, sf):
    """D1 + D6 on orders."""
    return sp.describe_split(sp.temporal_holdout(fx.orders(spark, sf), ORDERS_CUTOFF))


@reg("verify_temporal", f"""
SELECT {sql_ts_text("max(CASE WHEN part = 'train' THEN ts END)")} AS train_max,
       {sql_ts_text("min(CASE WHEN part = 'test' THEN ts END)")} AS test_min,
       coalesce(min(CASE WHEN part = 'test' THEN ts END) > max(CASE WHEN part = 'train' THEN ts END), false) AS ok
FROM (SELECT o_orderdate AS ts, CASE WHEN o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '{ORDERS_CUTOFF}' THEN 'train' ELSE 'test' END AS part
      FROM orders)""")
def q_verify_temporal(spark, sf):
    """D7 on the orders holdout."""
    v = sp.verify_temporal(sp.temporal_holdout(fx.orders(spark, sf), ORDERS_CUTOFF))
    return v.select(ts_text("train_max").alias("train_max"), ts_text("test_min").alias("test_min"), "ok")


# ---------------------------------------------------------------- D9 / D10 / P13

SQL_SCAN_CTE = f"""
cuts AS (SELECT unnest(generate_series(TIMESTAMP '{ORDERS_SCAN[0]}', TIMESTAMP '{ORDERS_SCAN[1]}', INTERVAL 1 MONTH)) AS cutoff),
tot AS (SELECT count(*) AS tot_n, count_if(o_orderstatus = 'F') AS tot_pos FROM orders),
scan AS (SELECT c.cutoff,
       count(o.o_orderkey) AS train_n, count_if(o.o_orderstatus = 'F') AS train_pos
  FROM cuts c LEFT JOIN orders o ON o.o_orderdate <= c.cutoff GROUP BY c.cutoff),
scan2 AS (SELECT cutoff, train_n, train_pos,
  round_even(CASE WHEN train_n > 0 THEN train_pos / train_n ELSE 0.0 END, 4) AS train_pos_rate,
  tot_n - train_n AS test_n, tot_pos - train_pos AS test_pos,
  round_even(CASE WHEN tot_n - train_n > 0 THEN (tot_pos - train_pos) / (tot_n - train_n) ELSE 0.0 END, 4) AS test_pos_rate
FROM scan CROSS JOIN tot)"""
SQL_SCAN = f"""WITH {SQL_SCAN_CTE}
SELECT {sql_ts_text('cutoff')} AS cutoff, strftime(cutoff, 'cut%Y_%m') AS prefix, train_n, train_pos, train_pos_rate,
       test_n, test_pos, test_pos_rate FROM scan2"""


@reg("cutoff_scan", SQL_SCAN)
def q_cutoff_scan(spark, sf):
    """D9 + P13: monthly cutoff scan over orders in one pass."""
    s = sp.scan_cutoffs(fx.orders(spark, sf), *ORDERS_SCAN)
    return s.select(ts_text("cutoff").alias("cutoff"), month_tag("cutoff").alias("prefix"), "train_n", "train_pos",
                    "train_pos_rate", "test_n", "test_pos", "test_pos_rate")


@reg("suggest_cutoff", f"""
WITH {SQL_SCAN_CTE}
SELECT {sql_ts_text('min(cutoff)')} AS cutoff FROM scan2 WHERE train_pos >= 2000 AND train_pos_rate >= 0.05
HAVING min(cutoff) IS NOT NULL""")
def q_suggest_cutoff(spark, sf):
    """First cutoff with >= 2000 train positives and rate >= 0.05."""
    s = sp.suggest_cutoff(sp.scan_cutoffs(fx.orders(spark, sf), *ORDERS_SCAN), 2000, 0.05)
    return s.select(ts_text("cutoff").alias("cutoff"))


# ---------------------------------------------------------------- D11 / J7 / P8

SQL_ORDERS_WINDOWS = f"""
ot AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_orderdate AS ts FROM orders
       WHERE o_orderdate IS NOT NULL AND o_orderdate > TIMESTAMP '{ORDERS_CUTOFF}'),
ob AS (SELECT min(ts) AS t0, max(ts) AS t1,
              CAST(ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / {float(30 * 86400e6)!r}) AS BIGINT) AS nmax FROM ot),
ok AS (SELECT t0, t1, unnest(generate_series(0, nmax - 1)) AS k FROM ob WHERE nmax > 0),
ow AS (SELECT CAST(k AS INTEGER) AS window_id, t0 + to_days(CAST(k * 30 AS INTEGER)) AS wstart,
              t0 + to_days(CAST(k * 30 AS INTEGER)) + to_days(60) AS wend
       FROM ok WHERE t0 + to_days(CAST(k * 30 AS INTEGER)) < t1)"""


def _orders_test(spark, sf):
    return sp.temporal_part(fx.orders(spark, sf), ORDERS_CUTOFF, "test")


@reg("rolling_windows", f"""WITH {SQL_ORDERS_WINDOWS}
SELECT window_id, {sql_ts_text('wstart')} AS wstart, {sql_ts_text('wend')} AS wend FROM ow""")
def q_rolling_windows(spark, sf):
    """60-day windows, 30-day step, anchored at the first test order."""
    w = sp.rolling_windows(_orders_test(spark, sf), 60, 30)
    return w.select("window_id", ts_text("wstart").alias("wstart"), ts_text("wend").alias("wend"))


@reg("window_counts", f"""WITH {SQL_ORDERS_WINDOWS}
SELECT w.window_id, count(*) AS n, count_if(t.y = 1) AS n_pos
FROM ot t JOIN ow w ON t.ts >= w.wstart AND t.ts < w.wend GROUP BY w.window_id""")
def q_window_counts(spark, sf):
    """J7 + P8: rows per overlapping window (a row may be in two windows)."""
    test = _orders_test(spark, sf)
    w = sp.rolling_windows(test, 60, 30)
    a = sp.assign_windows(test, w, 60, 30)
    return a.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))


@reg("time_filter", """
SELECT count(*) AS n, count_if(event_type = 'error') AS n_pos FROM events
WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def q_time_filter(spark, sf):
    """Half-open time filter pushed to the parquet scan."""
    from lowdata.functions.columns import time_filter
    e = time_filter(fx.events(spark, sf), "ts", "2024-01-05 12:00:00", "2024-01-20 00:00:00")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))


# ---------------------------------------------------------------- D2 / D3 / D4 / D8

@reg("hash_bucket", f"""
SELECT d.doc_id AS row_id, {sql_md5_bucket('md5(d.text)', 100)} AS bucket
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_hash_bucket(spark, sf):
    """md5 bucket of each labelled document's sha."""
    d = fx.documents(spark, sf)
    return d.select("row_id", sp.hash_bucket(F.col("sha"), 100).alias("bucket"))


SQL_FAMILY_HOLDOUT = f"""
fam AS (SELECT row_id, y, trim(family) AS family, sha,
          CASE WHEN (trim(family) IN {HELD_FAMILIES!r} AND trim(family) <> 'Benign')
                 OR (trim(family) = 'Benign' AND {sql_md5_bucket('sha', 100)} < 20)
               THEN 'test' ELSE 'train' END AS part
        FROM {fx.SQL_DOCUMENTS})"""


@reg("family_holdout", f"WITH {SQL_FAMILY_HOLDOUT} SELECT row_id, part FROM fam")
def q_family_holdout(spark, sf):
    """D3: held-out families + a hashed 20% slice of benign."""
    return sp.family_holdout(fx.documents(spark, sf), list(HELD_FAMILIES)).select("row_id", "part")


@reg("verify_family", f"""WITH {SQL_FAMILY_HOLDOUT},
f AS (SELECT family, max(CAST(part = 'train' AS INTEGER)) AS tr, max(CAST(part = 'test' AS INTEGER)) AS te FROM fam GROUP BY family)
SELECT coalesce(array_to_string(list_sort(list(family) FILTER (WHERE tr = 1 AND te = 1 AND family <> 'Benign')), ','), '') AS overlap,
       coalesce(bool_or(family = 'Benign' AND tr = 1), false) AS benign_train,
       coalesce(bool_or(family = 'Benign' AND te = 1), false) AS benign_test,
       coalesce(len(list(family) FILTER (WHERE tr = 1 AND te = 1 AND family <> 'Benign')), 0) = 0
         AND coalesce(bool_or(family = 'Benign' AND tr = 1), false) AND coalesce(bool_or(family = 'Benign' AND te = 1), false) AS ok
FROM f""")
def q_verify_family(spark, sf):
    """D8 on the D3 split."""
    v = sp.verify_family(sp.family_holdout(fx.documents(spark, sf), list(HELD_FAMILIES)))
    return v.select(F.array_join("overlap", ",").alias("overlap"), "benign_train", "benign_test", "ok")


SQL_LOFO = f"""
lp AS (SELECT row_id, y, sha, coalesce(nullif(trim(family), ''), 'UNKNOWN') AS family,
              (y = 0 AND {sql_md5_unit('sha')} < 0.2) AS neg_test FROM {fx.SQL_DOCUMENTS}),
lf AS (SELECT family, count(*) AS n_test_pos FROM lp WHERE y = 1 AND family <> 'UNKNOWN'
       GROUP BY family HAVING count(*) >= {LOFO_MIN_POS})"""


@reg("lofo_info", f"""WITH {SQL_LOFO}
SELECT family, n_test_pos, (SELECT count_if(neg_test) FROM lp) AS n_test_neg, CAST(0.2 AS DOUBLE) AS benign_test_frac,
       {LOFO_MIN_POS} AS min_test_pos FROM lf""")
def q_lofo_info(spark, sf):
    """D4 + S19: held-out families with enough positives and their test sizes."""
    return sp.lofo_info(fx.documents(spark, sf), LOFO_MIN_POS, 0.2)


@reg("lofo_membership", f"""WITH {SQL_LOFO}
SELECT lf.family AS split_id, lp.row_id, 'test' AS part FROM lp JOIN lf ON lp.family = lf.family WHERE lp.y = 1
UNION ALL
SELECT lf.family AS split_id, lp.row_id, 'test' AS part FROM lp CROSS JOIN lf WHERE lp.neg_test""")
def q_lofo_membership(spark, sf):
    """D4 long form: test rows of every leave-one-family-out split."""
    return sp.lofo_membership(fx.documents(spark, sf), LOFO_MIN_POS, 0.2)


# ---------------------------------------------------------------- D20 audit

@reg("audit", None)
def q_audit(spark, sf):
    """Leakage audit of the family split plus a stratified validation slice of its train part."""
    d = sp.family_holdout(fx.documents(spark, sf), list(HELD_FAMILIES))
    train = d.filter(F.col("part") == "train")
    val = sa.val_split(train, seed=42).filter(F.col("part") == "val").select("row_id", "part")
    mem = d.select("row_id", "part").unionByName(val)
    return sp.audit(mem, sha=d.select("row_id", "sha"))
