"""Adaptive covers against the plain test of all edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.geo import in_polygon
from lodestone.operators import cover
from lodestone.operators.spatial import EDGES, points_in_polygons


def star(r, n, x, y, size):
    """A ring of n vertices with an uneven border."""
    far = [size * (0.8 + 0.15 * math.sin(10 * math.pi * i / n) + min(0.04, 4 / n) * r.random()) for i in range(n)]
    ring = [(x + far[i] * math.cos(2 * math.pi * i / n), y + far[i] * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return list(zip(ring, ring[1:] + ring[:1]))


def plain(edges, x, y):
    """The ray test over all edges, borders included."""
    odd = False
    for (x1, y1), (x2, y2) in edges:
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def frame(spark, shapes):
    return spark.createDataFrame([(k, [tuple(map(float, (*a, *b))) for a, b in edges]) for k, edges in shapes.items()], f"name string, edges {EDGES}")


def shapes():
    r = random.Random(1)
    square = lambda x0, y0, x1, y1: [((x0, y0), (x1, y0)), ((x1, y0), (x1, y1)), ((x1, y1), (x0, y1)), ((x0, y1), (x0, y0))]
    return {
        "large": star(r, 3000, 2.1, 46.3, 2.7),
        "small": star(r, 500, 2.05, 46.31, 0.004),
        "box": square(0.0, 45.0, 2.0, 46.0),
        "holed": square(3.0, 45.0, 6.0, 47.0) + star(r, 800, 4.4, 46.0, 0.7),
        "two": star(r, 60, -4.0, 42.0, 0.3) + star(r, 60, -2.0, 42.0, 0.3),
        "bow": [((7, 45), (9, 47)), ((9, 47), (9, 45)), ((9, 45), (7, 47)), ((7, 47), (7, 45))],
        "none": [],
    }


def test_equal_to_all_edges(spark):
    r, own = random.Random(2), shapes()
    spots = [(r.uniform(-5, 10), r.uniform(41, 49)) for _ in range(1500)]
    spots += [(r.uniform(2.04, 2.06), r.uniform(46.3, 46.32)) for _ in range(200)]
    spots += [(i / 4, 44.75 + j / 4) for i in range(-2, 14) for j in range(10)]  # corners and borders of boxes and cells
    for edges in own.values():  # vertices and what is beside them
        for (x, y), _ in r.sample(edges, min(len(edges), 20)):
            spots += [(x, y), (math.nextafter(x, 99), y), (x, math.nextafter(y, -99))]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(-1, None, 45.5), (-2, 1.0, None)], "id int, longitude double, latitude double")
    got = {(q["name"], q["id"]) for q in points_in_polygons(frame(spark, own), points).collect()}
    want = {(k, i) for k, edges in own.items() for i, (x, y) in enumerate(spots) if plain(edges, x, y)}
    assert got == want and len(got) == points_in_polygons(frame(spark, own), points).count()


def test_far_fewer_edges_are_tested(spark):
    """Of thousands of edges a point meets a tenth at the most, and most points none."""
    r = random.Random(3)
    areas = frame(spark, {"large": star(r, 5000, 2.1, 46.3, 2.7)})
    cells = cover.cover(areas)
    assert cells.filter("size(near) = 0").count() > 100 and cells.filter("size(near) = 0 AND NOT inside").count() == 0
    spots = spark.createDataFrame([(float(r.uniform(-1, 5)), float(r.uniform(43, 49))) for _ in range(2000)], "x double, y double")
    met = None
    for n, size in enumerate(cover.SIZES):
        at = spots.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size), "level": F.lit(n)})
        part = at.join(cells, ["level", "gx", "gy"]).select(F.size("near").alias("n"))
        met = part if met is None else met.unionByName(part)
    told = met.agg(F.sum("n").alias("edges"), F.count_if(F.col("n") == 0).alias("free"), F.count("*").alias("points")).first()
    inside = spots.crossJoin(areas).filter(in_polygon(F.col("x"), F.col("y"), F.col("edges"))).count()
    assert told["edges"] * 10 < 2000 * 5000 / 100 and told["free"] > 0.8 * inside


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_any_number_of_edges_a_cell(few):
    r = random.Random(few)
    edges = star(r, 200, 0.3, -0.2, 0.4)
    flat = np.array([(*a, *b) for a, b in edges])
    cells = {(c[0], c[1], c[2]): c for c in cover.cells_of(flat, (0.5, 0.0625), few)}
    for _ in range(500):
        x, y = r.uniform(-0.3, 0.9), r.uniform(-0.8, 0.4)
        found = [c for n, s in enumerate((0.5, 0.0625)) if (c := cells.get((n, math.floor(x / s), math.floor(y / s))))]
        assert len(found) <= 1
        inside = bool(found) and (not len(found[0][6]) or found[0][5] != cover._crossed(found[0][6], found[0][3], found[0][4], x, y))
        assert inside == plain(edges, x, y)
