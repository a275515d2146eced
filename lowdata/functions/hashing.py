"""Seeded, partition-independent randomness built from ``md5``.

Every random choice in the engine (sampling, shuffles, augmentation draws,
synthetic latents) is a pure function of ``(seed, stream, key)``.  The result
therefore does not depend on partitioning, task retries or executor loss, and
each expression has a DuckDB twin (``sql_*``) that yields bit-equal doubles, so
the samplers can be checked against plain SQL.

    u(seed, stream, key) = (int(md5(seed|stream|key)[:13], 16) + 0.5) / 2**52

``u`` is uniform on (0, 1) with 52 bits, never exactly 0 or 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)
TWO_52_SQL = "4503599627370496.0"


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def _key_string(*parts) -> Column:
    return F.concat_ws("|", *[_as_col(p).cast("string") for p in parts])


def uniform(*parts) -> Column:
    """Uniform (0,1) double from the md5 of ``parts`` joined by '|'."""
    h = F.conv(F.substring(F.md5(_key_string(*parts)), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO_52)


def normal(*parts) -> Column:
    """Standard normal draw (Box-Muller on two independent uniforms)."""
    u1 = uniform(*parts, "n1")
    u2 = uniform(*parts, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def md5_bucket(col, modulo: int = 100) -> Column:
    """First 8 hex digits of md5 as an unsigned int, modulo ``modulo``."""
    h = F.conv(F.substring(F.md5(_as_col(col).cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(modulo))


def md5_unit(col) -> Column:
    """First 8 hex digits of md5 divided by 0xFFFFFFFF (in [0, 1])."""
    h = F.conv(F.substring(F.md5(_as_col(col).cast("string")), 1, 8), 16, 10).cast("double")
    return h / F.lit(float(0xFFFFFFFF))


# ---------------------------------------------------------------- SQL twins

def _sql_key(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_uniform(*parts: str) -> str:
    """DuckDB expression equal to :func:`uniform` (arguments are SQL expressions)."""
    return (f"((('0x' || substr(md5({_sql_key(*parts)}), 1, 13))::UBIGINT)::DOUBLE + 0.5)"
            f" / {TWO_52_SQL}")


def sql_normal(*parts: str) -> str:
    u1 = sql_uniform(*parts, "'n1'")
    u2 = sql_uniform(*parts, "'n2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


def sql_md5_bucket(expr: str, modulo: int = 100) -> str:
    return f"((('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::UBIGINT) % {modulo})::BIGINT"


def sql_md5_unit(expr: str) -> str:
    return f"((('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::UBIGINT)::DOUBLE / 4294967295.0)"


def sql_lit(v) -> str:
    """Render a Python scalar as a SQL literal for the twins."""
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def round_half_up(col, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, evaluated identically by Spark and DuckDB."""
    s = float(10 ** digits)
    return F.floor(_as_col(col) * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s)


def sql_round_half_up(expr: str, digits: int = 2) -> str:
    s = float(10 ** digits)
    return f"(CAST(floor(({expr}) * {s!r} + 0.5) AS DOUBLE) / {s!r})"
