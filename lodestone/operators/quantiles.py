"""Exact grouped quantiles that no group can overload.

Spark's ``percentile`` keeps all different values of a group in one buffer. Here each value falls into a bin by its
logarithm, which keeps the order. A first pass over the rows counts the bins, and tells in which of them each
quantile lies; a second one counts the different values of those bins only, which are then ranked. A group with a
third of all rows is spread over its bins, and several columns and quantiles share the two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_null_safe

STEPS = 256  # bins for each power of two
OFFSET = 1 << 20  # more than the largest logarithm times STEPS


def ordered_bin(v: Column) -> Column:
    """A bin number that never falls as the value rises; NaN sorts last."""
    size = F.floor(F.log2(F.abs(v)) * STEPS) + OFFSET
    return F.when(F.isnan(v), F.lit(4 * OFFSET)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def columns_of(wanted: dict[str, tuple[str, float]]) -> list[str]:
    return list(dict.fromkeys(c for c, _ in wanted.values()))


def cells(df: DataFrame, keys: list[str], columns: list[str], weight: str | None = None) -> DataFrame:
    """keys (and weight), the column's number _w, its value _v and bin _r; a row for each column that has a value."""
    own = [*keys, *([weight] if weight else [])]
    if len(columns) == 1:
        every = df.select(*own, F.lit(0).alias("_w"), F.col(columns[0]).cast("double").alias("_v"))
    else:
        every = df.select(*own, F.inline(F.array(*[F.struct(F.lit(i).alias("_w"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])))
    return every.filter("_v IS NOT NULL").withColumn("_r", ordered_bin(F.col("_v")))


def hit_bins(totals: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], columns: list[str]) -> DataFrame:
    """The bins (keys, _w, _r) in which a wanted quantile lies, with the values before them, _b, and the group's, _n.

    ``totals`` has keys, _w, _r and the values in the bin, _t.
    """
    group = Window.partitionBy(*keys, "_w")
    earlier = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumns({"_b": F.coalesce(F.sum("_t").over(earlier), F.lit(0)), "_n": F.sum("_t").over(group)})
    ranks = F.lit(None).cast("array<long>")
    for i, c in enumerate(columns):
        own = [f((F.col("_n") - 1) * q).cast("long") for column, q in wanted.values() if column == c for f in (F.floor, F.ceil)]
        ranks = F.when(F.col("_w") == i, F.array(*own) if own else F.array().cast("array<long>")).otherwise(ranks)
    return before.filter(F.exists(ranks, lambda p: (p >= F.col("_b")) & (p < F.col("_b") + F.col("_t")))).select(*keys, "_w", "_r", "_b", "_n")


def picked(near: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], columns: list[str]) -> DataFrame:
    """The neighbours of each quantile from the hit bins' different values _v, each with its count _c and its bin's _b, _n."""
    low = F.col("_b") + F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_w", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = near.withColumn("_low", low).withColumn("_high", F.col("_low") + F.col("_c"))
    out = [F.max(F.when(F.col("_w") == 0, F.col("_n"))).alias("_n")]
    for name, (column, q) in wanted.items():
        place, own = (F.col("_n") - 1) * F.lit(q), F.col("_w") == columns.index(column)
        at = lambda p: F.max(F.when(own & (F.col("_low") <= p) & (p < F.col("_high")), F.col("_v")))  # noqa: B023, E731
        out += [at(F.floor(place)).alias(f"{name}_x"), at(F.ceil(place)).alias(f"{name}_y"), F.max(F.when(own, place - F.floor(place))).alias(f"{name}_f")]
    return placed.groupBy(*keys).agg(*out)


def order_statistics(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """keys; _n, the values of the first column; and for each name of ``wanted`` (column, quantile) the two
    neighbouring values <name>_x and <name>_y and how far the quantile lies between them, <name>_f.

    NULL values are left out, and so are groups without any value. ``weight`` counts a row several times.
    """
    columns = columns_of(wanted)
    rows, count = cells(df, keys, columns, weight), F.sum(weight) if weight else F.count("*")
    hit = hit_bins(rows.groupBy(*keys, "_w", "_r").agg(count.alias("_t")), keys, wanted, columns)
    near = join_null_safe(rows, hit, [*keys, "_w", "_r"]).groupBy(*keys, "_w", "_r", "_v").agg(count.alias("_c"), F.max("_b").alias("_b"), F.max("_n").alias("_n"))
    return picked(near, keys, wanted, columns)


def between(name: str, hold=lambda c: c) -> Column:
    """The interpolated quantile of ``order_statistics``, its neighbours first passed through ``hold``."""
    x, y, f = hold(F.col(f"{name}_x")), hold(F.col(f"{name}_y")), F.col(f"{name}_f")
    return x + F.when(f > 0, f * (y - x)).otherwise(0.0)


def group_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys and one double for each named quantile, interpolated linearly; NULL values are left out.

    Groups without a value are not in the result.
    """
    found = order_statistics(df, keys, {n: (value, q) for n, q in quantiles.items()}, weight)
    return found.select(*keys, *[between(n).alias(n) for n in quantiles])
