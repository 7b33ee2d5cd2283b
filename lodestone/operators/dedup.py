"""Deduplication and incremental append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import pk_key


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by a total order.

    Spark limits the group before the shuffle as well (a window group limit): each task sends one row of a key,
    so a key that holds a third of all rows does not travel row by row. NULL keys are equal.
    """
    ranks = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    place = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*ranks))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def append_unique(new: DataFrame, known: DataFrame, key: str = "_pk_hash") -> DataFrame:
    """Rows of ``new`` whose key is not among the known ones."""
    return new.join(known.select(key), key, "left_anti").select(new.columns)


def with_pk(df: DataFrame, keys: list[str], name: str = "_pk_hash") -> DataFrame:
    """Rows with a complete key, and the key's text."""
    return df.dropna(subset=keys).withColumn(name, pk_key(keys))
