"""Geohash and point-in-polygon as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def with_geohash(df: DataFrame, lon: str, lat: str, name: str = "geohash6", precision: int = 6) -> DataFrame:
    """Add the geohash of two coordinate columns: interleaved bits of the quantised coordinates, longitude first.

    The cells are columns of their own, so that the code for the characters stays small.
    """
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(value: Column, low: float, span: float, n: int) -> Column:
        raw = F.floor((value - low) / span * float(1 << n)).cast("long")
        return F.least(F.greatest(raw, F.lit(0)), F.lit((1 << n) - 1))

    # NULL unless both coordinates are there.
    x = F.when(F.col(lat).isNotNull(), cell(F.col(lon), -180.0, 360.0, lon_bits))
    y = F.when(F.col(lon).isNotNull(), cell(F.col(lat), -90.0, 180.0, lat_bits))
    placed = df.withColumns({"_gx": x, "_gy": y})
    characters = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for i in range(5):
            bit = 5 * k + i
            source, left = ("_gx", lon_bits - 1 - bit // 2) if bit % 2 == 0 else ("_gy", lat_bits - 1 - bit // 2)
            value = value + F.shiftleft(F.shiftright(F.col(source), left).bitwiseAND(F.lit(1)), 4 - i)
        characters.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return placed.withColumn(name, F.concat(*characters)).drop("_gx", "_gy")


def in_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Whether a point lies in or on a polygon given as array<struct<x1,y1,x2,y2>>; holes are edges too."""

    def on(e: Column) -> Column:
        cross = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
        return (cross == 0) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    def crosses(e: Column) -> Column:
        spans = (e.y1 > y) != (e.y2 > y)
        return F.when(spans, (x < (e.x2 - e.x1) * (y - e.y1) / F.when(spans, e.y2 - e.y1).otherwise(1.0) + e.x1).cast("int")).otherwise(0)

    crossed = F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e))
    return F.exists(edges, on) | (crossed % 2 == 1)
