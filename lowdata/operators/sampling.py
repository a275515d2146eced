"""Exact-size, seeded samplers.

Every sampler draws ``u = uniform(seed, stream, row_id)`` per row and keeps
the first ``quota`` rows per class by ``(u, row_id)`` - exactly
``row_number() OVER (PARTITION BY class ORDER BY u, row_id) <= quota`` - via
:mod:`lowdata.operators.ranking` (histogram + boundary bucket, no
single-task window).  Quotas come from the class sizes of that histogram, so the input is
read once for counts and histogram together; only per-class scalars leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowdata.functions.hashing import uniform
from lowdata.operators.ranking import hash_rank, mark_first, take_first
from lowdata.session import materialize


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def with_u(df: DataFrame, seed: int, stream: str, key: str = "row_id", out: str = "u") -> DataFrame:
    return df.withColumn(out, uniform(F.lit(int(seed)), F.lit(stream), F.col(key)))


def class_counts(df: DataFrame, y: str = "y", by=None) -> DataFrame:
    """Rows per (by..., class)."""
    return df.groupBy(*_keys(by), y).agg(F.count(F.lit(1)).alias("n_c"))


def largest_remainder(counts: DataFrame, total, y: str = "y", by=None, out: str = "quota") -> DataFrame:
    """Allocate ``total`` draws over classes proportionally to ``n_c`` (floor, then the
    largest remainders get +1, ties by class value).  ``total`` is an int or a column
    expression over ``n`` (the group size)."""
    keys = _keys(by)
    w_all = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    c = counts.withColumn("n", F.sum("n_c").over(w_all))
    tot = F.lit(int(total)) if isinstance(total, (int, float)) else total
    c = c.withColumn("_tot", tot.cast("long"))
    cont = F.col("n_c").cast("double") * F.col("_tot").cast("double") / F.col("n").cast("double")
    c = c.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    c = c.withColumn("_need", F.col("_tot") - F.sum("_fl").over(w_all))
    w_rem = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        (F.col("_cont") - F.col("_fl")).desc(), F.col(y))
    c = c.withColumn("_r", F.row_number().over(w_rem))
    q = F.col("_fl") + F.when(F.col("_r") <= F.col("_need"), 1).otherwise(0)
    return c.select(*keys, y, "n_c", "n", q.cast("long").alias(out))


# ----------------------------------------------------------------- D5 / D14 / D15 / D17

def stratified_split(df: DataFrame, y: str = "y", test_frac: float = 0.25, seed: int = 42,
                     key: str = "row_id", part: str = "part", by=None) -> DataFrame:
    """Per-class proportional split; n_test = ceil(frac * n), train allocated by
    largest remainder and test = the rest of each class."""
    keys = _keys(by)
    n_train = F.col("n") - F.ceil(F.lit(float(test_frac)) * F.col("n"))

    def quota(sizes):
        train_q = largest_remainder(sizes, n_train, y, keys, out="q_train")
        return train_q.select(*keys, y, (F.col("n_c") - F.col("q_train")).alias("quota"))

    d = with_u(df, seed, "split", key)
    d = mark_first(d, [*keys, y], quota, "u", key, out="_is_test")
    return d.withColumn(part, F.when(F.col("_is_test"), "test").otherwise("train")).drop("u", "_is_test")


def stratified_sample(df: DataFrame, y: str = "y", frac: float = 0.2, seed: int = 42,
                      key: str = "row_id") -> DataFrame:
    """Exact stratified subsample of floor(frac * n) rows (``sampleBy`` is Bernoulli)."""
    n_kept = F.floor(F.lit(float(frac)) * F.col("n"))
    return take_first(with_u(df, seed, "subsample", key), y, lambda sizes: largest_remainder(sizes, n_kept, y).select(y, "quota"),
                      "u", key).drop("u")


def val_split(df: DataFrame, y: str = "y", seed: int = 42, frac: float = 0.2, key: str = "row_id",
              part: str = "part", require_min_class: bool = True) -> DataFrame:
    """Stratified validation split of a train set; only with two classes, n > 10 and
    (unless disabled) at least 2 rows per class - else every row stays train."""
    st = df.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q")).first()
    p, q = st["p"], st["q"]
    ok = p > 0 and q > 0 and p + q > 10 and (not require_min_class or min(p, q) >= 2)
    if not ok:
        return df.withColumn(part, F.lit("train"))
    s = stratified_split(df, y, frac, seed, key, part)
    return s.withColumn(part, F.when(F.col(part) == "test", "val").otherwise("train"))


def stratified_folds(df: DataFrame, y: str = "y", k: int = 5, seed: int = 42, key: str = "row_id",
                     out: str = "fold") -> DataFrame:
    """fold = (hash rank within class - 1) mod k."""
    d = hash_rank(with_u(df, seed, "fold", key), y, "u", key, out="_rank")
    return d.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("u", "_rank")


# ----------------------------------------------------------------- D12 scarce

def scarce_quotas(counts: DataFrame, frac: float, min_pos: int = 50, min_neg: int = 50) -> DataFrame:
    """Quota formula of the scarce subsample over a one-row table ``(P, Q)`` (+ run keys).

    n_total = max(1, round(f*N)); n_pos = min(P, max(min_pos, round(n_total*P/N)));
    n_neg = min(Q, max(min_neg, n_total - n_pos)); a remaining deficit (only
    possible when negatives ran out) is topped up with positives.
    """
    P, Q = F.col("P"), F.col("Q")
    N = P + Q
    n_total = F.greatest(F.lit(1), F.bround(F.lit(float(frac)) * N.cast("double"), 0).cast("long"))
    prior = P.cast("double") / F.greatest(F.lit(1), N).cast("double")
    c = counts.withColumn("n_total", n_total)
    c = c.withColumn("n_pos", F.least(P, F.greatest(F.lit(min_pos), F.bround(F.col("n_total") * prior, 0).cast("long"))))
    c = c.withColumn("n_neg", F.least(Q, F.greatest(F.lit(min_neg), F.col("n_total") - F.col("n_pos"))))
    top = F.greatest(F.lit(0), F.least(P - F.col("n_pos"), F.col("n_total") - F.col("n_pos") - F.col("n_neg")))
    return c.withColumn("n_pos", F.col("n_pos") + top)


def two_class_counts(sizes: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """Class sizes ``(keys, y, n_c)`` as one row ``(P, Q)`` per key."""
    n = lambda v, name: F.coalesce(F.sum(F.when(F.col(y) == v, F.col("n_c"))), F.lit(0)).cast("long").alias(name)
    return sizes.groupBy(*keys).agg(n(1, "P"), n(0, "Q"))


def scarce_sample(df: DataFrame, frac: float, seed: int, min_pos: int = 50, min_neg: int = 50,
                  y: str = "y", key: str = "row_id", by=None) -> DataFrame:
    """Exact-size scarce subsample of a train set (per run keys ``by``)."""
    keys = _keys(by)

    def quota(sizes):
        q = scarce_quotas(two_class_counts(sizes, y, keys), frac, min_pos, min_neg)
        return (q.select(*keys, F.lit(1).alias(y), F.col("n_pos").alias("quota"))
                .unionByName(q.select(*keys, F.lit(0).alias(y), F.col("n_neg").alias("quota"))))

    return take_first(with_u(df, seed, "scarce", key), [*keys, y], quota, "u", key).drop("u")


# ----------------------------------------------------------------- D13 / D18 / D19

def class_sample(df: DataFrame, n_per_class: int = 1000, seed: int = 42, y: str = "y",
                 key: str = "row_id") -> DataFrame:
    """First ``n`` rows of each class by seeded hash order."""
    return take_first(with_u(df, seed, "class", key), y, n_per_class, "u", key).drop("u")


def capped_subset(df: DataFrame, cap: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Uniform subset of at most ``cap`` rows."""
    return take_first(with_u(df, seed, "cap", key), None, cap, "u", key).drop("u")


def family_capped_subset(df: DataFrame, cap: int, seed: int = 42, family: str = "family",
                         key: str = "row_id") -> DataFrame:
    """Per family max(1, floor(cap * n_f / n)) clipped to n_f; a shortfall is filled from
    the rows not taken (anti-join, no duplicates), an excess trimmed at random."""
    fams = materialize(df.groupBy(family).agg(F.count(F.lit(1)).alias("n_f")))
    n = fams.agg(F.coalesce(F.sum("n_f"), F.lit(0))).first()[0]
    if n <= cap:
        return df
    q = fams.select(family, F.least(F.col("n_f"), F.greatest(F.lit(1), F.floor(
        F.lit(float(cap)) * F.col("n_f") / F.lit(float(n))))).cast("long").alias("quota"))
    total = q.agg(F.sum("quota")).first()[0]
    d = mark_first(with_u(df, seed, "fam", key), family, q, "u", key, out="_take").drop("u")
    taken = d.filter("_take").drop("_take")
    if total < cap:
        rest = d.filter(~F.col("_take")).drop("_take")
        add = take_first(with_u(rest, seed, "fill", key), None, cap - total, "u", key).drop("u")
        return taken.unionByName(add)
    if total > cap:
        return take_first(with_u(taken, seed, "trim", key), None, cap, "u", key).drop("u")
    return taken


# ----------------------------------------------------------------- A4 rebalance

def rebalance(df: DataFrame, ratio: float = 1.0, seed: int = 42, y: str = "y",
              key: str = "uid", by=None) -> DataFrame:
    """A4: trim the majority class to round(n_min * max(1, ratio)); never upsample;
    a missing class leaves the set unchanged."""
    keys = _keys(by)
    keep = F.bround(F.least("P", "Q").cast("double") * F.lit(max(1.0, float(ratio))), 0).cast("long")
    both = (F.col("P") > 0) & (F.col("Q") > 0)
    qp = F.when(both & (F.col("P") > F.col("Q")), F.least("P", keep)).otherwise(F.col("P"))
    qn = F.when(both & (F.col("P") <= F.col("Q")), F.least("Q", keep)).otherwise(F.col("Q"))

    def quota(sizes):
        cnt = two_class_counts(sizes, y, keys)
        return (cnt.select(*keys, F.lit(1).alias(y), qp.alias("quota"))
                .unionByName(cnt.select(*keys, F.lit(0).alias(y), qn.alias("quota"))))

    return take_first(with_u(df, seed, "rebalance", key), [*keys, y], quota, "u", key).drop("u")



__all__ = ["class_counts", "largest_remainder", "stratified_split", "stratified_sample", "val_split",
           "stratified_folds", "scarce_quotas", "scarce_sample", "class_sample", "capped_subset",
           "family_capped_subset", "rebalance"]
