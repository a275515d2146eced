"""Exact hash ranks and exact-size selection per group, without a single-task window.

``row_number() OVER (PARTITION BY g ORDER BY u, id) <= k`` is the rule every
sampler uses (``u`` is a seeded md5 uniform, see ``functions.hashing``).  A
window partitioned by class alone sends a whole class to one task, so the same
rank is computed in two exact parts:

* a histogram of ``floor(u * B)`` per group (partial/final hash aggregate, at
  most ``groups * B`` small rows) whose running sum is each bucket's offset;
* a ``row_number`` inside ``(group, bucket)`` - a window over ~``n / B`` rows.

For selection (``rank <= k``) only the one bucket holding the k-th row needs
the window; it yields a per-group boundary ``(u*, id*)``, and the selection is
then a map-side comparison against that one-row-per-group table.  Nothing but
histogram counts and boundary rows is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowdata.session import materialize

DEFAULT_BUCKETS = 1 << 16


def _cols(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def _bucket(u: str, buckets: int) -> Column:
    return F.least(F.floor(F.col(u) * F.lit(buckets)), F.lit(buckets - 1))


def with_scalars(df: DataFrame, one_row: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries (no join, no extra job;
    Catalyst merges subqueries over the same plan)."""
    cols = cols or one_row.columns
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in cols])


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a per-group table (``on=[]``: one row, attached as scalar subqueries).

    The table is written first, so Spark knows its size in bytes from the files and
    broadcasts it only below its own threshold; beyond that both sides are
    shuffled and a hot group's partition can be split.
    """
    if not on:
        if how not in ("inner", "left"):
            raise ValueError("scalar attach supports inner/left only")
        return with_scalars(big, small)
    return big.join(materialize(small), on=on, how=how)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (planned as a hash/sort-merge equi-join)."""
    if not keys:
        return (left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how)
                .drop("_one"))
    r = right.select(*[F.col(k).alias(f"_ns_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_ns_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_ns_{k}" for k in keys])


def hash_rank(df: DataFrame, by, u: str = "u", tie: str = "row_id",
              out: str = "rank", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add the exact 1-based rank of each row within ``by`` ordered by ``(u, tie)``."""
    keys = _cols(by)
    b = "_rk_bucket"
    d = df.withColumn(b, _bucket(u, buckets))
    hist = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_rk_n"))
    w_off = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*keys, b, F.coalesce(F.sum("_rk_n").over(w_off), F.lit(0)).alias("_rk_off"))
    w_in = Window.partitionBy(*keys, b).orderBy(F.col(u), F.col(tie))
    ranked = d.withColumn("_rk_in", F.row_number().over(w_in))
    return (ranked.join(hist, on=[*keys, b], how="inner")
            .withColumn(out, (F.col("_rk_off") + F.col("_rk_in")).cast("long"))
            .drop(b, "_rk_off", "_rk_in"))


def boundaries(df: DataFrame, keys: list[str], quota, u: str = "u", tie: str = "row_id",
               buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Per group: quota ``_q``, size ``_gn`` and the (u, tie) of the ``_q``-th row (null if ``_gn <= _q``).

    ``df`` is read once for the histogram, which also gives the group sizes, and once for the rows of the boundary buckets.
    """
    keys = _cols(keys)
    b = "_bd_bucket"
    d = df.select(*keys, u, tie).withColumn(b, _bucket(u, buckets))
    hist = materialize(d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n")))
    groups = hist.groupBy(*keys).agg(F.sum("_n").alias("_gn"))
    if callable(quota):
        quota = quota(groups.withColumnRenamed("_gn", "n_c"))
    if isinstance(quota, DataFrame):
        q = quota.select(*keys, F.col("quota").cast("long").alias("_q"))
        groups = groups.join(q, on=keys) if keys else with_scalars(groups, q)
    else:
        groups = groups.withColumn("_q", (quota if isinstance(quota, Column) else F.lit(int(quota))).cast("long"))
    groups = materialize(groups)  # one row per group
    w_off = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0)))
    hist = hist.join(groups, on=keys) if keys else with_scalars(hist, groups)
    edge = hist.filter((F.col("_off") < F.col("_q")) & (F.col("_off") + F.col("_n") >= F.col("_q")))
    edge = edge.select(*keys, b, (F.col("_q") - F.col("_off")).alias("_need"))
    cand = d.join(edge, on=[*keys, b], how="inner")
    w_in = Window.partitionBy(*keys, b).orderBy(F.col(u), F.col(tie))
    picked = (cand.withColumn("_rn", F.row_number().over(w_in))
              .filter(F.col("_rn") == F.col("_need"))
              .select(*keys, F.col(u).alias("_bu"), F.col(tie).alias("_bt")))
    # groups present with their quota; groups with a null boundary keep every row
    if keys:
        return groups.join(picked, on=keys, how="left")
    return with_scalars(groups, picked)


def in_first(u: str = "u", tie: str = "row_id") -> Column:
    """Predicate ``(u, tie) <= (_bu, _bt)`` or no boundary (group smaller than its quota)."""
    return (F.col("_bu").isNull()
            | (F.col(u) < F.col("_bu"))
            | ((F.col(u) == F.col("_bu")) & (F.col(tie) <= F.col("_bt"))))


def mark_first(df: DataFrame, by, quota, u: str = "u", tie: str = "row_id", out: str = "selected",
               buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add boolean ``out``: rank within ``by`` (order ``u, tie``) ``<= quota``.

    ``quota`` is an int, a Column over ``by`` columns, a DataFrame keyed by
    ``by`` with a ``quota`` column (one row per group), or a function that makes such
    a table from the group sizes ``(by..., n_c)``.  Rows of groups absent
    from a quota table are not selected.
    """
    keys = _cols(by)
    bd = boundaries(df, keys, quota, u, tie, buckets).select(*keys, "_q", "_bu", "_bt")
    j = join_small(df, bd, keys, how="left")
    sel = F.coalesce(F.col("_q").isNotNull() & (F.col("_q") > 0) & in_first(u, tie), F.lit(False))
    return j.withColumn(out, sel).drop("_q", "_bu", "_bt")


def with_position(ordered: DataFrame, out: str = "pos") -> DataFrame:
    """Add the 1-based place of every row of an ordered frame; only the sizes of its partitions are summed up."""
    d = materialize(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return join_small(d, sizes, ["_part"]).withColumn(out, place.cast("long")).drop("_at", "_part", "_off")


def take_nearest(df: DataFrame, n: int, dist: str, key: str) -> DataFrame:
    """The ``n`` rows with the least ``(dist, key)``; distances are dealt to buckets of equal width."""
    finite = F.col(dist) < F.lit(float("inf"))  # false for NaN, which sorts last
    d = with_scalars(df, df.agg(F.max(F.when(finite, F.col(dist))).alias("_top")))
    u = F.when(finite & (F.col("_top") > 0), F.col(dist) / F.col("_top")).when(finite, F.lit(0.0)).otherwise(F.lit(1.0))
    d = d.withColumn("_near", u).withColumn("_order", F.struct(dist, key)).drop("_top")
    return take_first(d, None, n, "_near", "_order").drop("_near", "_order")


def take_first(df: DataFrame, by, quota, u: str = "u", tie: str = "row_id",
               buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Rows whose rank within ``by`` (order ``u, tie``) is ``<= quota``."""
    return mark_first(df, by, quota, u, tie, "_sel", buckets).filter("_sel").drop("_sel")
