"""Points in polygons by an equi-join over grid cells."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cover import join_points

EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def rings_of(geometry) -> list[list[tuple[float, float]]]:
    """Rings of WKT POLYGON or MULTIPOLYGON text, or of a GeoJSON object of these kinds."""
    if isinstance(geometry, str) and geometry.lstrip()[:1] != "{":
        if not re.match(r"\s*(MULTI)?POLYGON\b", geometry, re.I):
            raise ValueError("not a polygon")
        return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", geometry)]
    shape = json.loads(geometry) if isinstance(geometry, str) else geometry
    if shape.get("type") not in ("Polygon", "MultiPolygon"):
        raise ValueError("not a polygon")
    parts = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
    return [[tuple(p[:2]) for p in ring] for part in parts for ring in part]


def edges_of(geometry) -> list[tuple[float, float, float, float]]:
    out = []
    for ring in rings_of(geometry):
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out += [tuple(map(float, (*a, *b))) for a, b in zip(closed, closed[1:])]
    return out


def polygons(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A frame of ``names`` (text) and edges from rows that end in a geometry."""
    data = [(*r[:-1], edges_of(r[-1])) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names) + f", edges {EDGES}")


def _text_edges(geometry: Column) -> Column:
    """Edges of WKT or GeoJSON polygon text, all in the JVM; NULL for anything else."""
    number = r"([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    is_json = geometry.rlike(r"^\s*\{")
    is_polygon = F.when(is_json, geometry.rlike(r'"type"\s*:\s*"(?:Multi)?Polygon"')).otherwise(geometry.rlike(r"(?i)^\s*(?:MULTI)?POLYGON\b"))
    rings = F.when(is_json, F.regexp_extract_all(geometry, F.lit(r"\[((?:\s*\[[^\[\]]*\]\s*,?)+)\]"), F.lit(1))).otherwise(F.regexp_extract_all(geometry, F.lit(r"\(([^()]+)\)"), F.lit(1)))
    wkt = F.lit(rf"(?:^|,)\s*{number}\s+{number}")
    of = lambda ring, pattern, k: F.transform(F.regexp_extract_all(ring, pattern, F.lit(k)), lambda x: x.try_cast("double"))
    json_point = F.lit(rf"\[\s*{number}\s*,\s*{number}")

    def edges(ring):
        xs, ys = (F.when(is_json, of(ring, json_point, k)).otherwise(of(ring, wkt, k)) for k in (1, 2))
        after = lambda v: F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
        return F.transform(F.arrays_zip(xs.alias("x1"), ys.alias("y1"), after(xs).alias("x2"), after(ys).alias("y2")), lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2")))

    return F.when(is_polygon, F.flatten(F.transform(rings, edges)))


def wkb_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a WKB polygon or multipolygon, with or without further dimensions."""

    def shape(at):
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 9 if kind & 0x20000000 else 5  # an SRID may follow
        plain, high = (kind & 0x0FFFFFFF) % 1000, (kind & 0x0FFFFFFF) // 1000
        width = 2 + (bool(kind & 0x80000000) + bool(kind & 0x40000000) or (0, 1, 1, 2)[high])
        n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
        rings = []
        for _ in range(n):
            if plain == 6:
                inner, at = shape(at)
                rings += inner
            elif plain == 3:
                points, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
                values = struct.unpack_from(f"{order}{points * width}d", data, at)
                at += 8 * points * width
                rings.append(list(zip(values[::width], values[1::width])))
            else:
                raise ValueError("not a polygon")
        return rings, at

    return shape(0)[0]


def with_edges(areas: DataFrame) -> DataFrame:
    """``areas`` with the column edges, made of geom if it is not there: WKT or GeoJSON text, or WKB.

    Areas whose geometry is no polygon have NULL edges, and hold no point.
    """
    if "edges" in areas.columns:
        return areas
    if dict(areas.dtypes).get("geom") != "binary":
        return areas.withColumn("edges", _text_edges(F.col("geom").cast("string")))

    @F.pandas_udf(EDGES)
    def parsed(geometries: pd.Series) -> pd.Series:
        def one(g):
            try:
                return [dict(zip(("x1", "y1", "x2", "y2"), map(float, (*a, *b)))) for ring in wkb_rings(bytes(g)) for a, b in zip(ring, ring[1:])] if g is not None else None
            except (ValueError, struct.error, IndexError):
                return None

        return geometries.map(one)

    return areas.withColumn("edges", parsed("geom"))


def points_in_polygons(areas: DataFrame, points: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Inner join of points with the areas that hold them, borders included.

    Areas are covered by cells of several sizes (``cover``) and the join is one of equal cells, whatever their number;
    inner cells decide by themselves, border cells by the few edges that meet them.
    """
    return join_points(areas, points, x, y)
