"""Adaptive cell covers of polygons, for joins with points.

A polygon is cut into square cells of a coarse grid. A cell that no edge meets lies inside or outside as a whole;
one that more than a few edges meet is cut into the cells of a finer grid, with the edges that meet each, and so on. So
inner cells need no test of edges, and border cells hold only those edges that can matter there.

Every cell has a reference point, of which it is known whether it is inside. A point of the cell is inside if the way to
it, up or down and then left or right, crosses an even number of the cell's edges and the reference point is inside,
or an odd number and it is not: the way does not leave the cell, so no other edge is needed. A finer cell's
reference follows from the coarser one's in the same way. Ends of edges count as in the ray test of ``in_polygon``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

SIZES = (0.5, 0.5 / 8, 0.5 / 64, 0.5 / 512)  # cells of each level, in degrees
FEW = 6  # edges that a border cell may keep, unless it is of the finest level
AT = (0.51234567891, 0.48765432109)  # the reference point's place in its cell, where no vertex is likely to share a coordinate

CELL = "level int, gx long, gy long, cx double, cy double, inside boolean, near array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _meeting(e: np.ndarray, x0: float, y0: float, size: float) -> np.ndarray:
    """The edges (rows x1, y1, x2, y2) that may meet the closed cell: rounding may add one and not lose one."""
    more = 1e-9 * size
    x0, y0, x1, y1 = x0 - more, y0 - more, x0 + size + more, y0 + size + more
    e = e[(np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)]
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    sides = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    return e[(sides.min(0) <= 0) & (sides.max(0) >= 0)]


def _right(e: np.ndarray, x: float, y: float) -> np.ndarray:
    """A flag for each edge: a ray from the point to the right crosses it."""
    spans = (e[:, 1] > y) != (e[:, 3] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return spans & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])


def _crossed(e: np.ndarray, cx: float, cy: float, x: float, y: float) -> bool:
    """Whether the way from (cx, cy) over (cx, y) to (x, y) crosses an odd number of edges."""
    spans = (e[:, 0] > cx) != (e[:, 2] > cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        height = (e[:, 3] - e[:, 1]) * (cx - e[:, 0]) / (e[:, 2] - e[:, 0]) + e[:, 1]
    up = spans & ((height <= y) != (height <= cy))
    along = _right(e, cx, y) != _right(e, x, y)
    return bool((up.sum() + along.sum()) % 2)


def cells_of(edges: np.ndarray, sizes=SIZES, few: int = FEW) -> list[tuple]:
    """(level, gx, gy, cx, cy, inside, edges) of the cells that are not outside."""
    out: list[tuple] = []

    def visit(level: int, gx: int, gy: int, inside: bool, own: np.ndarray):
        """A cell whose reference point is inside or not, and the edges that meet it."""
        size = sizes[level]
        cx, cy = (gx + AT[0]) * size, (gy + AT[1]) * size
        if not len(own):
            if inside:
                out.append((level, gx, gy, cx, cy, True, own))
        elif len(own) <= few or level + 1 == len(sizes):
            out.append((level, gx, gy, cx, cy, inside, own))
        else:
            n, finer = round(size / sizes[level + 1]), sizes[level + 1]
            for i in range(gx * n, gx * n + n):
                column = _meeting(own, i * finer, gy * size, size) if n > 2 else own
                for j in range(gy * n, gy * n + n):
                    x, y = (i + AT[0]) * finer, (j + AT[1]) * finer
                    visit(level + 1, i, j, inside != _crossed(own, cx, cy, x, y), _meeting(column, i * finer, j * finer, finer) if len(column) else column)

    if not len(edges):
        return out
    size = sizes[0]
    low = lambda a: int(np.floor(a / size))
    for gx in range(low(edges[:, [0, 2]].min()), low(edges[:, [0, 2]].max()) + 1):
        for gy in range(low(edges[:, [1, 3]].min()), low(edges[:, [1, 3]].max()) + 1):
            cx, cy = (gx + AT[0]) * size, (gy + AT[1]) * size
            visit(0, gx, gy, bool(_right(edges, cx, cy).sum() % 2), _meeting(edges, gx * size, gy * size, size))
    return out


def cover(areas: DataFrame, sizes=SIZES, few: int = FEW) -> DataFrame:
    """The columns of ``areas`` but edges, and a row for each cell (see CELL). An area is one row and is cut by one task."""
    files.ship(areas.sparkSession)
    kept = [c for c in areas.columns if c != "edges"]
    schema = T.StructType([*[areas.schema[c] for c in kept], *T.StructType.fromDDL(CELL).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(len(kept))[i].as_py() or []
                made = cells_of(np.array([[e["x1"], e["y1"], e["x2"], e["y2"]] for e in own], np.float64).reshape(-1, 4), sizes, few)
                for at in range(0, len(made), 1024):
                    part = made[at : at + 1024]
                    near = [[dict(zip(("x1", "y1", "x2", "y2"), map(float, e))) for e in c[6]] for c in part]
                    columns = [b.column(k).take(pa.array([i] * len(part))) for k in range(len(kept))]
                    columns += [pa.array([c[k] for c in part], arrow.field(len(kept) + k).type) for k in range(6)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(near, arrow.field(len(kept) + 6).type)], schema=arrow)

    return areas.select(*kept, "edges").mapInArrow(run, schema)


def in_cell(x: Column, y: Column) -> Column:
    """Whether a point lies in or on the polygon of its cell (columns of CELL)."""
    cx, cy, near = F.col("cx"), F.col("cy"), F.col("near")

    def on(e: Column) -> Column:
        cross = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
        return (cross == 0) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    def crossings(e: Column) -> Column:
        tall, wide = (e.y1 > y) != (e.y2 > y), (e.x1 > cx) != (e.x2 > cx)
        at = (e.x2 - e.x1) * (y - e.y1) / F.when(tall, e.y2 - e.y1).otherwise(1.0) + e.x1
        height = (e.y2 - e.y1) * (cx - e.x1) / F.when(wide, e.x2 - e.x1).otherwise(1.0) + e.y1
        return F.when(tall & ((cx < at) != (x < at)), 1).otherwise(0) + F.when(wide & ((height <= y) != (height <= cy)), 1).otherwise(0)

    odd = F.aggregate(near, F.lit(0), lambda acc, e: acc + crossings(e)) % 2 == 1
    return F.when(F.size(near) == 0, F.lit(True)).otherwise((F.col("inside") != odd) | F.exists(near, on))


def join_points(areas: DataFrame, points: DataFrame, x: str, y: str, sizes=SIZES, few: int = FEW) -> DataFrame:
    """Inner join of points with the areas that hold them, borders included: equality of cells, at each level that occurs."""
    cells = files.materialize(cover(areas, sizes, few), "cover")
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # as many as there are sizes
    if not levels:
        levels = [0]
    place = lambda c, size: F.floor(F.col(c) / F.lit(size)).cast("long")
    keys = F.array(*[F.struct(F.lit(n).alias("level"), place(x, sizes[n]).alias("gx"), place(y, sizes[n]).alias("gy")) for n in sorted(levels)])
    dealt = points.withColumn("_cell", F.explode(keys))
    own = dealt.select("*", *[F.col(f"_cell.{k}").alias(f"_{k}") for k in ("level", "gx", "gy")]).drop("_cell")
    named = cells.withColumnsRenamed({"level": "_level", "gx": "_gx", "gy": "_gy"})
    near = named.join(own, ["_level", "_gx", "_gy"]).filter(in_cell(F.col(x), F.col(y)))
    return near.drop("_level", "_gx", "_gy", "cx", "cy", "inside", "near")
