"""Holdout splits, rolling test windows and split verification.

A split is a ``part`` column (``'train'`` / ``'test'`` / ``'val'``) on the
sample table, or the long table ``(split_id, row_id, part)``.  Every operator
here is map-only or a small aggregate: per-row rules plus scalars that come
from one grouped aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowdata.functions.columns import blank_to, to_utc
from lowdata.functions.hashing import md5_bucket, md5_unit
from lowdata.operators.ranking import join_small
from lowdata.session import materialize

BENIGN = "Benign"
UNKNOWN = "UNKNOWN"
DAY_US = 86_400_000_000


# --------------------------------------------------------------- D1 temporal

def temporal_holdout(df: DataFrame, cutoff, ts: str = "ts", part: str = "part") -> DataFrame:
    """``ts <= cutoff`` or null ts -> train; ``ts > cutoff`` -> test."""
    c = to_utc(F.lit(cutoff))
    return df.withColumn(part, F.when(F.col(ts).isNull() | (F.col(ts) <= c), "train").otherwise("test"))


def temporal_part(df: DataFrame, cutoff, side: str, ts: str = "ts") -> DataFrame:
    """The rows of one side of D1, as a plain comparison that reaches the parquet scan."""
    c = to_utc(F.lit(cutoff))
    return df.filter(F.col(ts) > c) if side == "test" else df.filter(F.col(ts).isNull() | (F.col(ts) <= c))


# --------------------------------------------------------------- D2-D4 family

def hash_bucket(col, modulo: int = 100):
    """First 8 md5 hex digits as int, modulo ``modulo``."""
    return md5_bucket(col, modulo)


def family_holdout(df: DataFrame, families, benign_label: str = BENIGN, frac: float = 0.20,
                   family: str = "family", sha: str = "sha", part: str = "part",
                   check: bool = True) -> DataFrame:
    """D3: test = held-out families (not benign) + benign whose sha bucket < round(100*frac)."""
    held = sorted({f.strip() for f in families})
    if benign_label.lower() in map(str.lower, held):
        raise ValueError(f"held-out families must be malicious, got the benign one ({benign_label})")
    fam = F.trim(F.col(family).cast("string"))
    is_benign = fam == F.lit(benign_label)
    cut = int(round(frac * 100))  # Python round: half-even
    test = (fam.isin(*held) & ~is_benign) | (is_benign & (md5_bucket(F.col(sha), 100) < cut))
    out = df.withColumn(part, F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train"))
    if check:
        r = out.agg(F.count_if(is_benign).alias("nb"), F.count_if(F.col(part) == "test").alias("nt")).first()
        if r["nb"] == 0:
            raise ValueError(f"the samples hold no row of family {benign_label}, so the test part would have no negatives")
        if r["nt"] == 0:
            raise ValueError(f"no row falls into the test part (families {held}, benign share {frac})")
    return out


def lofo_prepare(df: DataFrame, family: str = "family", y: str = "y", sha: str = "sha",
                 frac: float = 0.20) -> DataFrame:
    """Normalise family (blank -> UNKNOWN) and mark the shared benign test slice."""
    return (df.withColumn(family, blank_to(F.col(family), UNKNOWN))
            .withColumn("neg_test", (F.col(y) == 0) & (md5_unit(F.col(sha)) < F.lit(frac))))


def lofo_info(df: DataFrame, min_test_pos: int = 200, frac: float = 0.20, family: str = "family",
              y: str = "y", sha: str = "sha") -> DataFrame:
    """D4 + S19: one row per held-out family with >= ``min_test_pos`` positives.

    Columns: family, n_test_pos, n_test_neg, benign_test_frac, min_test_pos.
    """
    d = lofo_prepare(df, family, y, sha, frac)
    fams = (d.filter((F.col(y) == 1) & (F.col(family) != UNKNOWN))
            .groupBy(family).agg(F.count(F.lit(1)).alias("n_test_pos"))
            .filter(F.col("n_test_pos") >= min_test_pos))
    neg = d.agg(F.count_if("neg_test").alias("n_test_neg"))
    return join_small(fams, neg, []).select(
        family, "n_test_pos", "n_test_neg",
        F.lit(float(frac)).alias("benign_test_frac"), F.lit(int(min_test_pos)).alias("min_test_pos"))


def lofo_split(df: DataFrame, held_family: str, frac: float = 0.20, family: str = "family",
               y: str = "y", sha: str = "sha", part: str = "part") -> DataFrame:
    """D4 for one split: test = positives of ``held_family`` + the shared benign slice."""
    d = lofo_prepare(df, family, y, sha, frac)
    test = ((F.col(y) == 1) & (F.col(family) == F.lit(held_family))) | F.col("neg_test")
    return d.withColumn(part, F.when(test, "test").otherwise("train")).drop("neg_test")


def lofo_membership(df: DataFrame, min_test_pos: int = 200, frac: float = 0.20,
                    family: str = "family", y: str = "y", sha: str = "sha", shared: str | None = None) -> DataFrame:
    """D4 long form of all splits, test rows only: (split_id, row_id, part='test'); train = anti-join of this table.

    The benign slice that all splits share is repeated once per held-out family; with ``shared`` it is
    kept once under that split id, the form to store (``io.read_split`` adds it to every split).
    """
    d = lofo_prepare(df, family, y, sha, frac)
    info = lofo_info(df, min_test_pos, frac, family, y, sha).select(F.col(family).alias("split_id"))
    pos = (d.filter(F.col(y) == 1).join(info, d[family] == info["split_id"], "inner")
           .select("split_id", "row_id"))
    if shared is not None:
        return pos.unionByName(d.filter("neg_test").select(F.lit(shared).alias("split_id"), "row_id")).withColumn("part", F.lit("test"))
    # the shared benign slice fans out over the held-out families (map-side explode)
    fams = info.agg(F.array_sort(F.collect_list("split_id")).alias("fams")).scalar()
    neg = d.filter("neg_test").select(F.explode(fams).alias("split_id"), "row_id")
    return pos.unionByName(neg).withColumn("part", F.lit("test"))


# --------------------------------------------------------------- D6-D8 checks

def describe_split(df: DataFrame, part: str = "part", by=None) -> DataFrame:
    """n_total, n_train, n_test, pct_test (rounded half-even to 3)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"),
                              F.count_if(F.col(part) == "train").alias("n_train"),
                              F.count_if(F.col(part) == "test").alias("n_test"))
    pct = F.bround(F.lit(100.0) * F.col("n_test") / F.greatest(F.lit(1), F.col("n_total")), 3)
    return a.withColumn("pct_test", pct)


def verify_temporal(df: DataFrame, part: str = "part", ts: str = "ts", by=None) -> DataFrame:
    """Max train ts < min test ts (nulls dropped); an empty side fails, as in the reference."""
    keys = [by] if isinstance(by, str) else list(by or [])
    a = df.groupBy(*keys).agg(F.max(F.when(F.col(part) == "train", F.col(ts))).alias("train_max"),
                              F.min(F.when(F.col(part) == "test", F.col(ts))).alias("test_min"))
    return a.withColumn("ok", F.coalesce(F.col("test_min") > F.col("train_max"), F.lit(False)))


def verify_family(df: DataFrame, part: str = "part", family: str = "family",
                  benign_label: str = BENIGN, by=None) -> DataFrame:
    """Families on both sides (benign excluded) must be none; benign on both sides."""
    keys = [by] if isinstance(by, str) else list(by or [])
    f = df.groupBy(*keys, family).agg(F.max((F.col(part) == "train").cast("int")).alias("tr"),
                                      F.max((F.col(part) == "test").cast("int")).alias("te"))
    is_b = F.col(family) == F.lit(benign_label)
    a = f.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when((F.col("tr") == 1) & (F.col("te") == 1) & ~is_b,
                                           F.col(family)))).alias("overlap"),
        F.coalesce(F.max(F.when(is_b, F.col("tr") == 1)), F.lit(False)).alias("benign_train"),
        F.coalesce(F.max(F.when(is_b, F.col("te") == 1)), F.lit(False)).alias("benign_test"))
    return a.withColumn("ok", (F.size("overlap") == 0) & F.col("benign_train") & F.col("benign_test"))


# --------------------------------------------------------------- D9-D10 cutoffs

def month_starts(spark, start: str, end: str) -> DataFrame:
    """Month-start cutoffs in [start, end] (first one is the first month start >= start)."""
    s = to_utc(F.lit(start))
    first = F.when(F.date_trunc("month", s) == s, F.date_trunc("month", s)).otherwise(
        F.date_trunc("month", s) + F.expr("INTERVAL 1 MONTH"))
    e = to_utc(F.lit(end))
    return (spark.range(1).select(F.explode(F.sequence(first, e, F.expr("INTERVAL 1 MONTH"))).alias("cutoff"))
            .filter(F.col("cutoff") <= e)
            .withColumn("cutoff_idx", F.row_number().over(Window.orderBy("cutoff")) - 1))


def scan_cutoffs(df: DataFrame, start: str, end: str, ts: str = "ts", y: str = "y") -> DataFrame:
    """Per monthly cutoff, train (ts <= c) / test counts and positive rates.

    One pass: each row is binned by the first cutoff it is train for; a
    cumulative sum over the (few) cutoffs gives every side.  Null ts is test.
    """
    spark = df.sparkSession
    cuts = month_starts(spark, start, end)
    first = cuts.agg(F.min("cutoff").alias("c0"), F.count(F.lit(1)).alias("m"))
    t = F.col(ts)
    midx = ((F.year(t) - F.year("c0")) * 12 + F.month(t) - F.month("c0"))
    j0 = F.when(t <= F.col("c0"), F.lit(0)).otherwise(
        midx + F.when(F.date_trunc("month", t) == t, 0).otherwise(1))
    rows = join_small(df.select(ts, y), first, [])
    binned = rows.withColumn("cutoff_idx", F.when(t.isNull(), F.lit(None)).otherwise(j0))
    tot = df.agg(F.count(F.lit(1)).alias("tot_n"), F.count_if(F.col(y) == 1).alias("tot_pos"))
    hist = binned.groupBy("cutoff_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("p"))
    j = cuts.join(hist, on="cutoff_idx", how="left").fillna(0, subset=["n", "p"])
    w = Window.orderBy("cutoff_idx").rowsBetween(Window.unboundedPreceding, 0)
    j = j.select("cutoff", "cutoff_idx", F.sum("n").over(w).alias("train_n"), F.sum("p").over(w).alias("train_pos"))
    j = join_small(j, tot, [])
    rate = lambda a, b: F.bround(F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0), 4)
    return (j.withColumn("test_n", F.col("tot_n") - F.col("train_n"))
            .withColumn("test_pos", F.col("tot_pos") - F.col("train_pos"))
            .select("cutoff", "train_n", "train_pos", rate("train_pos", "train_n").alias("train_pos_rate"),
                    "test_n", "test_pos", rate("test_pos", "test_n").alias("test_pos_rate")))


def suggest_cutoff(scan: DataFrame, min_train_pos: int = 500, min_train_pos_rate: float = 0.05) -> DataFrame:
    """The first cutoff with enough train positives and a high enough rate (0 or 1 row)."""
    ok = scan.filter((F.col("train_pos") >= min_train_pos) & (F.col("train_pos_rate") >= min_train_pos_rate))
    return ok.agg(F.min("cutoff").alias("cutoff")).filter(F.col("cutoff").isNotNull())


# --------------------------------------------------------------- D11 + J7 windows

def rolling_windows(df: DataFrame, days: int, step: int | None = None, n: int | None = None,
                    ts: str = "ts") -> DataFrame:
    """Windows anchored at min(ts), width ``days``, step (default width), half-open.

    Count = ``n`` or ceil(span / step); windows starting at or after max(ts) are dropped.
    Output: window_id, wstart, wend.
    """
    step = int(step or days)
    b = df.filter(F.col(ts).isNotNull()).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    span_us = F.unix_micros("t1") - F.unix_micros("t0")
    nmax = F.lit(int(n)) if n else F.ceil(span_us / F.lit(float(step * DAY_US))).cast("int")
    w = b.select("t0", "t1", F.explode(F.sequence(F.lit(0), F.greatest(nmax - 1, F.lit(-1)))).alias("window_id"))
    w = w.filter(nmax > 0)
    wstart = F.col("t0") + F.make_dt_interval(days=F.col("window_id") * F.lit(step))
    return (w.select(F.col("window_id").cast("int").alias("window_id"), wstart.alias("wstart"), "t1")
            .filter(F.col("wstart") < F.col("t1"))
            .select("window_id", "wstart", (F.col("wstart") + F.make_dt_interval(days=F.lit(days))).alias("wend")))


def assign_windows(df: DataFrame, windows: DataFrame, days: int, step: int | None = None,
                   ts: str = "ts") -> DataFrame:
    """Every (row, window) with ``wstart <= ts < wend``; rows may fall in several windows.

    The candidate window ids of a row are computed arithmetically from the
    anchor, so no range join is needed: ``explode(sequence(k_lo, k_hi))``,
    then an equi-join on ``window_id`` against the (small) window table and an
    exact bound check.
    """
    step = int(step or days)
    meta = windows.agg(F.min("wstart").alias("_t0"), F.max("window_id").alias("_kmax"))
    d = join_small(df.filter(F.col(ts).isNotNull()), meta, [])
    rel = F.unix_micros(F.col(ts)) - F.unix_micros("_t0")
    k_hi = F.least(F.floor(rel / F.lit(float(step * DAY_US))), F.col("_kmax"))
    k_lo = F.greatest(F.floor((rel - F.lit(days * DAY_US)) / F.lit(float(step * DAY_US))) + 1, F.lit(0))
    d = d.withColumn("window_id", F.explode(F.sequence(k_lo.cast("int"),
                                                        F.greatest(k_hi, k_lo - 1).cast("int"))))
    d = d.drop("_t0", "_kmax")
    # one row per window (count bounded by span / step): broadcast
    out = join_small(d, windows, ["window_id"])
    return out.filter((F.col(ts) >= F.col("wstart")) & (F.col(ts) < F.col("wend")))


# --------------------------------------------------------------- D20 audit

def audit(membership: DataFrame, sha: DataFrame | None = None, by=None, strict: bool = False) -> DataFrame:
    """Leakage audit over a long membership table ``(row_id, part)`` (+ run keys ``by``).

    Counts: val rows not in train, train/test overlap, val/test overlap and
    (with ``sha``: row_id -> sha) sha values on both train and test.  With
    ``strict`` any violation raises.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    r = membership.groupBy(*keys, "row_id").agg(
        F.max((F.col("part") == "train").cast("int")).alias("tr"),
        F.max((F.col("part") == "val").cast("int")).alias("va"),
        F.max((F.col("part") == "test").cast("int")).alias("te"))
    a = r.groupBy(*keys).agg(
        F.count_if((F.col("va") == 1) & (F.col("tr") == 0)).alias("val_not_in_train"),
        F.count_if((F.col("tr") == 1) & (F.col("te") == 1)).alias("train_test_overlap"),
        F.count_if((F.col("va") == 1) & (F.col("te") == 1)).alias("val_test_overlap"))
    if sha is not None:
        s = (membership.join(sha.select("row_id", "sha"), on="row_id", how="inner")
             .groupBy(*keys, "sha").agg(F.max((F.col("part") == "train").cast("int")).alias("tr"),
                                        F.max((F.col("part") == "test").cast("int")).alias("te"))
             .groupBy(*keys).agg(F.count_if((F.col("tr") == 1) & (F.col("te") == 1)).alias("sha_overlap")))
        a = a.join(s, on=keys, how="left") if keys else join_small(a, s, [])
        a = a.withColumn("sha_overlap", F.coalesce("sha_overlap", F.lit(0)))
    return _judged(a, keys, strict)


def _judged(a: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Add ``ok``: every count is zero.  ``strict`` raises on the first row that is not."""
    ok = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in a.columns if c not in keys])
    a = a.withColumn("ok", ok)
    if strict:
        bad = a.filter(~F.col("ok")).limit(1).collect()
        if bad:
            raise AssertionError(f"leakage audit failed: {bad[0].asDict()}")
    return a


def audit_runs(members: DataFrame, test: DataFrame, sha: DataFrame, by: str = "run_id", strict: bool = True) -> DataFrame:
    """D20 for many runs that share one test set, in one job.

    ``members`` is (run, row_id, part: train or val), ``test`` (row_id, sha), ``sha`` (row_id, sha) of all
    samples.  The test set meets the runs' rows in two joins instead of being copied into every run.
    """
    rows = members.groupBy(by, "row_id").agg(F.bool_or(F.col("part") == "train").alias("tr"), F.bool_or(F.col("part") == "val").alias("va"))
    te = test.select("row_id").distinct().withColumn("te", F.lit(True))
    zero = F.lit(False)
    a = (rows.join(te, "row_id", "left").withColumn("te", F.coalesce("te", zero)).groupBy(by)
         .agg(F.count_if(F.col("va") & ~F.col("tr")).alias("val_not_in_train"), F.count_if(F.col("tr") & F.col("te")).alias("train_test_overlap"),
              F.count_if(F.col("va") & F.col("te")).alias("val_test_overlap")))
    trained = rows.where("tr").join(sha.select("row_id", "sha"), "row_id").select(by, "sha").distinct()
    shared = trained.join(test.select("sha").distinct(), "sha", "left_semi").groupBy(by).agg(F.count("*").alias("sha_overlap"))
    a = a.join(shared, by, "left").withColumn("sha_overlap", F.coalesce("sha_overlap", F.lit(0)))
    return _judged(materialize(a), [by], strict)


def shuffle(df: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    """Seeded permutation; only meaningful where order is output."""
    from lowdata.functions.hashing import uniform
    return df.orderBy(uniform(F.lit(seed), F.lit("shuffle"), F.col(key)), F.col(key))

