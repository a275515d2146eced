"""Data half of the documented report modes.

The reference's README names these plots but ships no code for them; the
statistics below are our own choice of standard ones (means, sample std,
paired bootstrap percentiles), computed as grouped Spark aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.operators.pairing import agg_by_variant, variability


def lines(raw: DataFrame, metric: str = "auc") -> DataFrame:
    """Metric vs fraction per (prefix, const, frac, variant): mean, std."""
    return agg_by_variant(raw, [metric])


def lines_agg(raw: DataFrame, metric: str = "auc", over: str = "prefix") -> DataFrame:
    """R2: metric vs fraction aggregated over cutoffs / windows / families (``over`` dropped)."""
    return raw.groupBy("frac", "variant").agg(
        F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std"),
        F.count(metric).alias("n"), F.countDistinct(over).alias(f"n_{over}"))


#: A replicate's weight of a unit is Poisson(1): how many of these limits (of 2^32 equal steps) its 32 hash bits reach.
POISSON_LIMITS = [math.floor(2 ** 32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)]
PER_HASH = 4  # weights out of one md5


def _weights(n_boot: int, *parts):
    """Array of ``n_boot`` Poisson(1) weights from md5 hashes of ``parts`` and the number of the hash."""
    def weight(hexes):
        v = F.conv(hexes, 16, 10).cast("long")
        out = F.lit(float(len(POISSON_LIMITS)))
        for k in reversed(range(len(POISSON_LIMITS))):
            out = F.when(v < POISSON_LIMITS[k], F.lit(float(k))).otherwise(out)
        return out
    hashes = F.transform(F.sequence(F.lit(0), F.lit(-(-n_boot // PER_HASH) - 1)), lambda i: F.md5(F.concat_ws("|", *parts, i.cast("string"))))
    some = F.flatten(F.transform(hashes, lambda h: F.array(*[weight(F.substring(h, 8 * i + 1, 8)) for i in range(PER_HASH)])))
    return F.slice(some, 1, n_boot)


def _array_quantile(values, q: float):
    """Linear interpolation between the two values around ``q`` of a sorted array (null when empty)."""
    at = F.lit(q) * (F.size(values) - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(values, lo), F.get(values, F.least(lo + 1, F.size(values) - 1))
    return a + (b - a) * (at - lo)


def delta_bootstrap(paired: DataFrame, metric: str = "auc", keys: Sequence[str] = ("prefix", "variant", "frac"),
                    n_boot: int = 1000, seed: int = 42, unit: str = "pair_id") -> DataFrame:
    """Mean paired delta with a percentile bootstrap CI (2.5, 97.5) and stars.

    Poisson bootstrap over the paired units of each group: every unit carries a vector of ``n_boot``
    weights derived from a hash, and a replicate's mean is the sum of weight x delta over the sum of
    weights.  Both vectors are summed map-side into one row a group (spark.ml's ``Summarizer``): no row
    per draw is made and nothing is joined, so a group may hold any number of units.  A
    replicate that draws no unit is left out.
    """
    keys = list(keys)
    d = f"delta_{metric}"
    gid = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    w = paired.filter(F.col(d).isNotNull()).select(*keys, F.col(d).alias("_d"), _weights(n_boot, F.lit(str(seed)), gid, F.col(unit).cast("string")).alias("_w"))
    both = array_to_vector(F.concat("_w", F.transform("_w", lambda x: x * F.col("_d"))))
    g = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("delta_mean"), Summarizer.metrics("mean").summary(both).alias("_s"))
    g = g.select(*keys, "n", "delta_mean", vector_to_array("_s.mean").alias("_m"))
    pairs = F.zip_with(F.slice("_m", 1, n_boot), F.slice("_m", n_boot + 1, n_boot), lambda a, b: F.when(a > 0, b / a))
    g = g.withColumn("_r", F.array_sort(F.filter(pairs, lambda x: x.isNotNull()))).drop("_m")
    share = lambda test: F.size(F.filter("_r", test)) / F.nullif(F.size("_r"), F.lit(0))
    p = F.least(F.lit(1.0), F.lit(2.0) * F.least(share(lambda x: x <= 0), share(lambda x: x >= 0)))
    g = g.withColumn("p_boot", p)
    stars = F.when(F.col("p_boot") < 0.001, "***").when(F.col("p_boot") < 0.01, "**").when(F.col("p_boot") < 0.05, "*").otherwise("")
    return g.select(*keys, "n", "delta_mean", _array_quantile(F.col("_r"), 0.025).alias("ci_low"), _array_quantile(F.col("_r"), 0.975).alias("ci_high"),
                    "p_boot", stars.alias("stars"))


def delta_matrix(paired: DataFrame, metric: str = "auc", frac: float | None = None,
                 row: str = "prefix", colkey: str = "window_id", variant: str = "variant") -> DataFrame:
    """Mean delta per (method, cutoff) x window at one fraction (long form; pivot to display)."""
    d = paired if frac is None else paired.filter(F.col("frac") == F.lit(frac))
    return d.groupBy(variant, row, colkey).agg(F.avg(f"delta_{metric}").alias(f"delta_{metric}_mean"),
                                               F.count(f"delta_{metric}").alias("n"))


def delta_matrix_wide(paired: DataFrame, columns: Sequence, metric: str = "auc", frac: float | None = None, row: str = "prefix",
                      colkey: str = "window_id", variant: str = "variant", names: Sequence[str] | None = None) -> DataFrame:
    """R4 as a matrix: one row per (method, cutoff), one column of mean deltas per given window (null: no run).

    The windows are given, so the pivot is one aggregate and the columns don't depend on the data.
    """
    d = paired if frac is None else paired.filter(F.col("frac") == F.lit(frac))
    wide = d.groupBy(variant, row).pivot(colkey, list(columns)).agg(F.avg(f"delta_{metric}"))
    names = names or [str(c) for c in columns]
    return wide.select(variant, row, *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])


def seed_box(raw: DataFrame, metric: str = "auc") -> DataFrame:
    """Quartiles of a metric across seeds per (prefix, frac, variant)."""
    return variability(raw, metric)
