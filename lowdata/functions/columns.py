"""Column-level helpers: header/schema normalisation, coercions, tags.

All are built-in ``pyspark.sql.functions`` expressions (JVM side, codegen'd);
schema checks look only at ``df.columns`` on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings accepted as "true" when normalising booleans.
TRUE_SPELLINGS = ("true", "1", "yes")

# Augmentation variants and their short tag codes.
VARIANTS = ("real", "gan", "oversample", "smote")
VARIANT_TAG_CODE = {"gan": "gan", "oversample": "os", "smote": "sm"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def norm_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail with the list of missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def to_utc(col) -> Column:
    """Parse to a UTC timestamp; unparsable -> null.

    Strings with an offset are converted, naive strings are read as UTC (the
    session time zone); timestamp columns pass through.
    """
    c = _c(col)
    return F.coalesce(F.try_to_timestamp(c.cast("string")),
                      F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def blank_to(col, default: str) -> Column:
    """Null or blank (after trim) -> ``default``; otherwise the trimmed text."""
    t = F.trim(_c(col).cast("string"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(default))


def to_bool(col, trim: bool = True) -> Column:
    """P5: lower(text) in {true, 1, yes}; ``trim`` also strips blanks first."""
    t = _c(col).cast("string")
    if trim:
        t = F.trim(t)
    return F.coalesce(F.lower(t).isin(*TRUE_SPELLINGS), F.lit(False))


def to_num(col) -> Column:
    """Numeric coercion, bad text or NaN -> null."""
    d = _c(col).cast("string").try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def positives(df: DataFrame, y: str = "y", label: int = 1, required: bool = False) -> DataFrame:
    """Class filter; ``required`` makes an empty class an error."""
    kept = df.filter(F.col(y) == F.lit(label))
    if required and kept.isEmpty():
        raise ValueError(f"no row has {y} = {label}")
    return kept


def time_filter(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Half-open ``start <= ts < end``; each bound optional, null ts dropped by either."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= to_utc(F.lit(start)))
    if end is not None:
        cond = cond & (F.col(ts) < to_utc(F.lit(end)))
    return df.filter(cond)


def variant_from_tag(tag) -> Column:
    """Gan / oversample / smote / real from substrings of the run tag."""
    t = F.lower(F.coalesce(_c(tag).cast("string"), F.lit("")))
    return (F.when(t.contains("_gan"), "gan")
            .when(t.contains("_os") | t.contains("_oversample"), "oversample")
            .when(t.contains("_sm") | t.contains("_smote"), "smote")
            .otherwise("real"))


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """P10: add a missing column with a default."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default))


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The subset of ``cols`` present in ``df`` (order kept)."""
    return [c for c in cols if c in df.columns]


def frac_code(frac) -> Column:
    """Fraction as written in run tags: shortest decimal, '.' removed (0.002 -> '0002')."""
    s = F.format_string("%.10f", _c(frac).cast("double"))
    s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")
    return F.regexp_replace(s, "\\.", "")


def run_tag(prefix, window, seed, variant, frac, const) -> Column:
    """``{prefix}[_wNN][_s{seed}]_real{f}`` or ``..._r{f}_{gan|os|sm}{const}``."""
    w = F.when(_c(window).isNull(), F.lit("")).otherwise(F.format_string("_w%02d", _c(window)))
    s = F.when(_c(seed).isNull(), F.lit("")).otherwise(F.concat(F.lit("_s"), _c(seed).cast("string")))
    code = (F.when(_c(variant) == "gan", "gan").when(_c(variant) == "oversample", "os")
            .when(_c(variant) == "smote", "sm"))
    fc = frac_code(frac)
    tail = F.when(_c(variant) == "real", F.concat(F.lit("_real"), fc)).otherwise(
        F.concat(F.lit("_r"), fc, F.lit("_"), code, _c(const).cast("string")))
    return F.concat(_c(prefix), w, s, tail)


def month_tag(ts) -> Column:
    """``cutYYYY_MM`` of a UTC timestamp."""
    return F.date_format(_c(ts), "'cut'yyyy_MM")


def spread_vector(df: DataFrame, features: str, n: int, label: str | None = None,
                  prefix: str = "feat_") -> DataFrame:
    """Explode an array column into ``feat_0 .. feat_{n-1}`` (+ label)."""
    cols = [F.col(features)[i].alias(f"{prefix}{i}") for i in range(n)]
    if label:
        cols.append(F.col(label))
    return df.select(*cols)


def suffix_cols(df: DataFrame, cols: Sequence[str], suffix: str) -> DataFrame:
    """Rename ``cols`` to ``{c}{suffix}``, keep the rest."""
    cs = set(cols)
    return df.select(*[F.col(c).alias(f"{c}{suffix}") if c in cs else F.col(c) for c in df.columns])


def keep_families(df: DataFrame, names: Sequence[str], family: str = "family") -> DataFrame:
    """Case-insensitive keep-list on the family column."""
    wanted = [n.strip().lower() for n in names]
    return df.filter(F.lower(F.trim(F.col(family))).isin(*wanted))


def results_mode(df: DataFrame) -> str:
    """P17: 'paired_cv' when ``*_real_mean`` columns exist, else 'raw'."""
    return "paired_cv" if any(c.endswith("_real_mean") for c in df.columns) else "raw"


def with_deltas(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``delta_m = m_aug - m_real``."""
    return df.select("*", *[(F.col(f"{m}_aug") - F.col(f"{m}_real")).alias(f"delta_{m}") for m in metrics])
