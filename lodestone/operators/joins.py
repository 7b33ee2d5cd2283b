"""Joins in which NULL keys meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``, NULL equal to NULL; the left side's key columns stay."""
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(other, same, how).drop(*[f"_on_{k}" for k in keys])
