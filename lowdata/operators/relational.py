"""Relational helpers of the reference's data handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowdata.operators.ranking import join_null_safe, with_scalars
from lowdata.session import materialize


def profile_table(df: DataFrame, label: str = "y") -> DataFrame:
    """G1: rows, columns, per-label counts and whether any value is null (one aggregate)."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
                  F.count_if(F.col(label) == 1).alias("n_label_1"), F.count_if(F.col(label) == 0).alias("n_label_0"),
                  F.bool_or(any_null).alias("any_null"))


RANGES = 128  # ranges of values in which a group's running sums are formed


def with_ranges(df: DataFrame, by: Sequence[str], col: str, of: DataFrame | None = None) -> DataFrame:
    """Add ``_range``: which of some ``RANGES`` value ranges of its group a row lies in.

    The cuts come from the data (approximate quantiles, a mergeable sketch per group),
    so a peaked distribution is divided too.  Only running sums are formed in the
    ranges; results don't depend on where the cuts are.
    """
    levels = F.expr("array(" + ", ".join(f"{i / RANGES!r}D" for i in range(1, RANGES)) + ")")
    cuts = (of if of is not None else df).groupBy(*by).agg(F.array_distinct(F.percentile_approx(col, levels, F.lit(1000))).alias("_cuts"))
    joined = join_null_safe(df, cuts, list(by)) if by else with_scalars(df, cuts)
    return joined.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(col)))).drop("_cuts")


def sums_before(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str], desc: bool = False) -> DataFrame:
    """Add ``{s}_before`` for each of ``sums``: its total over earlier rows of the group, by (``_range``, ``order``).

    Two levels: a window within each range, and one over the few range totals of a group.
    """
    way = (lambda c: F.col(c).desc()) if desc else (lambda c: F.col(c).asc())
    own = Window.partitionBy(*by, "_range")
    within = own.orderBy(way(order[0]), *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inner = df.select("*", *[zero(F.sum(x).over(within)).alias(f"_in_{x}") for x in sums])
    totals = df.groupBy(*by, "_range").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    over = Window.partitionBy(*by).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_range", *[zero(F.sum(f"_t_{x}").over(over)).alias(f"_off_{x}") for x in sums])
    out = join_null_safe(inner, shift, [*by, "_range"])
    for x in sums:
        out = out.withColumn(f"{x}_before", F.col(f"_in_{x}") + F.col(f"_off_{x}")).drop(f"_in_{x}", f"_off_{x}")
    return out


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float], weight: str | None = None) -> DataFrame:
    """(by, _n, _q): exact quantiles by linear interpolation, as an array in the order of ``qs``.

    From (group, value) counts; no task holds the values of a group.
    """
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    h = materialize(df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(n.cast("long").alias("_w")))
    size = h.groupBy(*by).agg(F.sum("_w").alias("_n"))
    placed = sums_before(with_ranges(h, by, "_v"), by, ["_v"], ["_w"])
    placed = join_null_safe(placed, size, by) if by else with_scalars(placed, size)
    levels = F.expr(f"transform(array({', '.join(f'{float(q)!r}D' for q in qs)}), (q, i) -> named_struct('i', i, 'q', q))")
    at = lambda x: x["q"] * (F.col("_n") - 1)
    has = lambda r: (r >= F.col("_w_before")) & (r < F.col("_w_before") + F.col("_w"))
    met = (placed.withColumn("_x", F.explode(F.filter(levels, lambda x: has(F.floor(at(x))) | has(F.ceil(at(x))))))
           .select(*by, "_n", "_v", F.col("_x.i").alias("_i"), (F.col("_x.q") * (F.col("_n") - 1)).alias("_at")))
    # one value if both neighbouring ranks have it, else the two values around the position
    one = met.groupBy(*by, "_n", "_i", "_at").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    lo, hi = F.floor("_at").cast("double"), F.ceil("_at").cast("double")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("double")).otherwise((hi - F.col("_at")) * F.col("lo") + (F.col("_at") - lo) * F.col("hi"))
    return (one.groupBy(*by, "_n").agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_a"))
            .select(*by, "_n", F.transform("_a", lambda x: x["v"]).alias("_q")))


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) per group; groups without a value are absent."""
    g = exact_quantiles(df, by, col, qs)
    return g.select(*by, *[F.col("_q")[i].alias(f"q{int(round(q * 100)):02d}") for i, q in enumerate(qs)])


def time_bounds(df: DataFrame, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Min / max timestamp per group."""
    return df.groupBy(*by).agg(F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))


def family_sizes(df: DataFrame, family: str = "family", y: str | None = "y") -> DataFrame:
    """Distinct families and their sizes (positives only when ``y`` given)."""
    d = df.filter(F.col(y) == 1) if y else df
    return d.groupBy(family).agg(F.count(F.lit(1)).alias("n"))


def align(x: DataFrame, meta: DataFrame, on: str = "row_id") -> DataFrame:
    """features/labels aligned with metadata by row id (inner equi-join)."""
    return x.join(meta, on=on, how="inner")


def members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys`` (left semi join)."""
    return df.join(keys.select(on).distinct(), on=on, how="left_semi")


def complement(df: DataFrame, other: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (left anti join)."""
    return df.join(other.select(on), on=on, how="left_anti")


def common_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values present on both sides."""
    return a.select(col).intersect(b.select(col))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str = "row_id") -> int:
    """U4: raise when the two sides share a key; returns 0 otherwise."""
    n = a.select(key).join(b.select(key), on=key, how="left_semi").limit(1).count()
    if n:
        raise AssertionError(f"sets share {key} values")
    return 0


def sort_results(df: DataFrame, cols: Sequence[str] = ("frac", "const_train_size", "seed")) -> DataFrame:
    """O1: results in display order (only where the order is the output)."""
    return df.orderBy(*[c for c in cols if c in df.columns])


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col).distinct().orderBy(col)
