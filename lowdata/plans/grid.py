"""Experiment grid (D22 / J8) and the deterministic prediction fixture.

The grid is windows x seeds x fractions x variants.  Parameter lists are
attached with ``explode`` of literal arrays (a map-side Generate), so a table
of windows derived from the data fans out into runs without a cartesian join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.functions.columns import VARIANTS, month_tag, run_tag, to_utc
from lowdata.functions.hashing import round_half_up, sql_round_half_up, sql_uniform, uniform

# The reference's default sweep parameters.
DEFAULT_SEEDS = (42, 1337, 2025)
DEFAULT_CONST_TRAIN_SIZE = 20000
DEFAULT_FRACTIONS = (0.0005, 0.001, 0.0015, 0.002, 0.0025, 0.003, 0.0035, 0.004, 0.0045, 0.005,
                     0.0055, 0.006, 0.0065, 0.007, 0.0075, 0.008, 0.0085, 0.009, 0.0095, 0.01)
DEFAULT_CUTOFFS = ("2019-10-01", "2019-12-01", "2020-03-01", "2020-06-01", "2020-09-01")
DEFAULT_WINDOW_DAYS, DEFAULT_WINDOW_STEP, DEFAULT_N_WINDOWS = 60, 30, 6
DEFAULT_MIN_TRAIN_POS = {"cut2019_09": 5, "cut2019_10": 10, "cut2019_12": 15,
                         "cut2020_03": 25, "cut2020_06": 25, "cut2020_09": 25}
DEFAULT_MIN_TRAIN_POS_OTHER = 10


def explode_values(df: DataFrame, name: str, values: Sequence, dtype: str) -> DataFrame:
    """Fan every row out over a literal parameter list (map-side ``explode``)."""
    arr = F.array(*[F.lit(v).cast(dtype) for v in values])
    return df.withColumn(name, F.explode(arr))


def run_grid(windows: DataFrame, seeds: Sequence[int] = DEFAULT_SEEDS,
             fracs: Sequence[float] = (0.01,), variants: Sequence[str] = VARIANTS,
             prefix: str | None = "run", const_train_size: int = DEFAULT_CONST_TRAIN_SIZE) -> DataFrame:
    """One row per run with its tag (P12).  ``windows`` has ``window_id`` (null = full test) and, with
    ``prefix=None``, its own ``prefix`` column."""
    g = windows
    g = explode_values(g, "seed", seeds, "int")
    g = explode_values(g, "frac", fracs, "double")
    g = explode_values(g, "variant", variants, "string")
    const = F.when(F.col("variant") == "real", F.lit(None).cast("int")).otherwise(F.lit(const_train_size))
    g = g.withColumn("const_train_size", const)
    if prefix is not None:
        g = g.withColumn("prefix", F.lit(prefix))
    return g.withColumn("tag", run_tag(F.col("prefix"), F.col("window_id"), F.col("seed"),
                                       F.col("variant"), F.col("frac"), F.col("const_train_size")))


def batch_grid(df: DataFrame, cutoffs: Sequence[str] = DEFAULT_CUTOFFS, seeds: Sequence[int] = DEFAULT_SEEDS,
               fracs: Sequence[float] = DEFAULT_FRACTIONS, variants: Sequence[str] = VARIANTS, days: int = DEFAULT_WINDOW_DAYS,
               step: int = DEFAULT_WINDOW_STEP, n_windows: int = DEFAULT_N_WINDOWS, floors: dict[str, int] | None = None,
               other_floor: int = DEFAULT_MIN_TRAIN_POS_OTHER, const_train_size: int = DEFAULT_CONST_TRAIN_SIZE, ts: str = "ts") -> DataFrame:
    """D22 for a batch of cutoffs: each cutoff's windows (anchored at its first test row) x seeds x fractions x
    variants, with the cutoff's floor of positives ``min_pos``.  ``df`` is read once for all cutoffs."""
    floors = DEFAULT_MIN_TRAIN_POS if floors is None else floors
    cuts = [to_utc(F.lit(c)) for c in cutoffs]
    bounds = df.agg(F.array(*[F.struct(c.alias("cutoff"), F.min(F.when(F.col(ts) > c, F.col(ts))).alias("t0"),
                                       F.max(F.when(F.col(ts) > c, F.col(ts))).alias("t1")) for c in cuts]).alias("b"))
    w = bounds.select(F.inline("b")).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    w = w.withColumn("wstart", F.col("t0") + F.make_dt_interval(days=F.col("window_id") * F.lit(step))).filter(F.col("wstart") < F.col("t1"))
    w = w.select(month_tag("cutoff").alias("prefix"), "window_id", "wstart", (F.col("wstart") + F.make_dt_interval(days=F.lit(days))).alias("wend"))
    floor = F.lit(other_floor)
    for tag, least in floors.items():
        floor = F.when(F.col("prefix") == tag, F.lit(least)).otherwise(floor)
    return run_grid(w.withColumn("min_pos", floor), seeds, fracs, variants, None, const_train_size)


def fixture_score(seed_col: str = "seed", variant_col: str = "variant", key: str = "row_id", y: str = "y"):
    """Deterministic classifier stand-in: round(0.8 * u(seed|variant, key) + 0.2 * y, 2) (ties occur)."""
    u = uniform(F.concat_ws("|", F.col(seed_col).cast("string"), F.col(variant_col)), F.col(key))
    return round_half_up(F.lit(0.8) * u + F.lit(0.2) * F.col(y).cast("double"), 2)


def sql_fixture_score(seed: str = "seed", variant: str = "variant", key: str = "row_id", y: str = "y") -> str:
    u = sql_uniform(f"concat_ws('|', CAST({seed} AS VARCHAR), {variant})", key)
    return sql_round_half_up(f"0.8 * {u} + 0.2 * CAST({y} AS DOUBLE)", 2)


def fixture_preds(rows: DataFrame, seeds: Sequence[int] = DEFAULT_SEEDS,
                  variants: Sequence[str] = VARIANTS, key: str = "row_id", y: str = "y") -> DataFrame:
    """Score every test row for every (seed, variant): the long predictions table."""
    p = explode_values(rows, "seed", seeds, "int")
    p = explode_values(p, "variant", variants, "string")
    return p.withColumn("y_true", F.col(y).cast("int")).withColumn("proba", fixture_score("seed", "variant", key, y))
