"""Partition layout of fan-out operators.

Operators that multiply rows (one row per run, window or draw) do the work in the
partitions of their input, which may be a single one.  ``spread`` deals the narrow rows by
key before they are multiplied, to as many partitions as the session shuffles to: left to
itself AQE would join them again by their size before the multiplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
