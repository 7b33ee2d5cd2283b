"""Embedding whitening from an exact integer scatter (operator 12).

Entries become whole numbers, x = floor(scale * c). Of the different vectors that are left, each task subtracts a
fixed whole shift, and adds up sums and cross-products without rounding: in blocks so small that double precision
holds every partial result exactly, or with Python's integers where entries are too large for that. Totals leave a
task as limbs of 30 bits, which Spark adds up as longs; so they have as many digits as they need.

The driver gets these limbs (their number depends on the dimensions alone), forms n X'X - SS' exactly, where the shift
cancels, divides by n^2 with correct rounding, and only then decomposes by eigh. A vector's deviation and its
centred entries n x - S are whole numbers too, and are rounded once, when they are projected.

Defined results: vectors that are null, or that hold null or non-finite entries, are dropped; empty ones have no
component. Vectors of different lengths are different spaces, each with its own fit. Entries beyond the range of a long
are held at its bounds. Repeated vectors count once in the fit and are each returned; ids play no part and may be null
or repeated. Where a component has no variance (a single vector, more components than the vectors span), ``whitened`` is
null, and it is left out of ``identity_error``; ``explained`` is 0 then, or null where nothing varies.
An empty table gives no row. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, scratch, ship, slices, table, tidied

LIMB = 30
EXACT = 1 << 53
SMALL = 1 << 25  # entries below this are multiplied in double precision, a few rows at least at a time


def quantized(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``rows`` whose vector has finite entries only, with it as x, an array of longs."""
    e = F.col(vector).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.filter(e.isNotNull() & ~F.exists(e, bad)).withColumn("x", F.transform(e, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def scatter_of(x: np.ndarray, shift: np.ndarray) -> tuple[list[int], list[int]]:
    """Exact sums and upper cross-products (row by row) of whole rows less ``shift``."""
    dim = x.shape[1]
    upper = np.triu_indices(dim)
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(abs(int(shift.min(initial=0))), abs(int(shift.max(initial=0))))
    if most >= SMALL:
        y = x.astype(object) - shift.astype(object)
        return list(y.sum(0)), list(y.T.dot(y)[upper])
    sums, cross = [0] * dim, [0] * len(upper[0])
    step = max(1, (EXACT - 1) // max(1, most * most))
    y = (x - shift).astype(np.float64)
    for at in range(0, len(y), step):
        part = y[at : at + step]
        sums = [a + int(b) for a, b in zip(sums, part.sum(0))]
        cross = [a + int(b) for a, b in zip(cross, (part.T @ part)[upper])]
    return sums, cross


def limbs_of(value: int) -> list[int]:
    """Signed limbs of LIMB bits, the lowest first; none for 0."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


SCATTER = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def _scatter(shifts: dict[int, list[int]]):
    """A task's totals as limbs: place 0 the rows, 1 to dim the sums, then the upper cross-products."""

    def run(batches):
        totals: dict[int, list[int]] = {}
        for b in slices(batches, 8192, 8_000_000):
            x, lengths = b.column(1), b.column(0).to_numpy()
            for dim in np.unique(lengths).tolist():
                rows = _matrix(x.filter(pa.array(lengths == dim)), dim)
                sums, cross = scatter_of(rows, np.array(shifts[dim], np.int64))
                new = [len(rows), *sums, *cross]
                old = totals.get(dim)
                totals[dim] = [a + b for a, b in zip(old, new)] if old else new
        rows = [(dim, at, limb, v) for dim, all_ in totals.items() for at, total in enumerate(all_) for limb, v in enumerate(limbs_of(int(total)))]
        for i in range(0, len(rows), 65536):
            part = rows[i : i + 65536]
            yield batch({n: [r[k] for r in part] for k, n in enumerate(SCATTER.names)}, SCATTER)

    return run


@dataclass
class Space:
    """The fit of one vector length."""

    n: int
    sums: list[int]
    directions: np.ndarray  # dimensions x components, unit columns
    roots: np.ndarray  # square roots of the eigenvalues, 0 where there is no variance
    explained: list[float | None]
    error: float | None = None


def covariance(n: int, sums: list[int], cross: list[int]) -> np.ndarray:
    """(n X'X - SS') / n^2 from exact totals, each entry rounded once."""
    dim = len(sums)
    out = np.zeros((dim, dim))
    for (i, j), c in zip(zip(*np.triu_indices(dim)), cross):
        out[i, j] = out[j, i] = (n * c - sums[i] * sums[j]) / (n * n)
    return out


def decompose(n: int, sums: list[int], shift: list[int], cross: list[int], most: int) -> Space:
    """Components by falling eigenvalue; ``sums`` and ``cross`` are those of the shifted vectors."""
    v = covariance(n, sums, cross)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(v))
    real = values > len(sums) * np.finfo(float).eps * max(1e-300, values[0])
    return Space(n, [s + n * h for s, h in zip(sums, shift)], vectors, np.sqrt(np.where(real, values, 0.0)), [float(e) / trace if r else 0.0 if trace > 0 else None for e, r in zip(values, real)])


def fit(distinct: DataFrame, most: int) -> dict[int, Space]:
    """The fit of each vector length from rows (dim, x), every vector once."""
    shifts = {r["dim"]: list(r["x"]) for r in distinct.groupBy("dim").agg(F.first("x").alias("x")).collect()}  # a row for each length
    parts = distinct.mapInArrow(tidied(_scatter(shifts)), "dim int, at int, limb int, value long")
    totals: dict[int, dict[int, int]] = {dim: {} for dim in shifts}
    for r in parts.groupBy("dim", "at", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        held = totals[r["dim"]]
        held[r["at"]] = held.get(r["at"], 0) + (r["value"] << (LIMB * r["limb"]))
    out = {}
    for dim, held in totals.items():
        every = [held.get(i, 0) for i in range(1 + dim + dim * (dim + 1) // 2)]
        out[dim] = decompose(every[0], every[1 : dim + 1], shifts[dim], every[dim + 1 :], most)
    return out


def centred(x: np.ndarray, space: Space) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they hold it, else Python's."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if space.n * most + max(map(abs, space.sums), default=0) < 1 << 62:
        return x * np.int64(space.n) - np.array(space.sums, np.int64)
    return x.astype(object) * space.n - np.array(space.sums, object)


def projected(y: np.ndarray, space: Space) -> np.ndarray:
    """Rows of whitened values from n x - S; NaN where there is no variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(space.roots > 0, (y / space.n).astype(np.float64) @ space.directions / space.roots, np.nan)


def deviations(y: np.ndarray) -> list[int]:
    """Sums of squares over each row, exact."""
    most = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
    if y.dtype != object and most * most * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    y = y.astype(object)
    return list((y * y).sum(1))


def _moments(spaces: dict[int, Space]):
    """A task's sums and cross-products of the whitened values of the fit list."""
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches):
        totals: dict[tuple, float] = {}
        for b in slices(batches, 8192, 8_000_000):
            lengths = b.column(0).to_numpy()
            for dim in np.unique(lengths).tolist():
                w = projected(centred(_matrix(b.column(1).filter(pa.array(lengths == dim)), dim), spaces[dim]), spaces[dim])
                one = np.column_stack([np.ones(len(w)), w])
                for (i, j), v in np.ndenumerate(one.T @ one):
                    totals[dim, i, j] = totals.get((dim, i, j), 0.0) + v
        yield batch({"dim": [k[0] for k in totals], "i": [k[1] for k in totals], "j": [k[2] for k in totals], "value": list(totals.values())}, schema)

    return run


def identity_errors(distinct: DataFrame, spaces: dict[int, Space]) -> dict[int, float | None]:
    """Largest entry of the whitened fit list's covariance minus the identity, measured over its rows."""
    sums = distinct.mapInArrow(tidied(_moments(spaces)), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()  # components squared, for each length
    held: dict[Any, dict] = {}
    for r in sums:
        held.setdefault(r["dim"], {})[r["i"], r["j"]] = r["value"]
    out: dict[int, float | None] = {}
    for dim, m in held.items():
        n, real = m[0, 0], [i + 1 for i, r in enumerate(spaces[dim].roots) if r > 0]
        out[dim] = max((abs(m[i, j] / n - m[i, 0] / n * m[0, j] / n - (i == j)) for i in real for j in real), default=None)
    return out


def whiten(rows: DataFrame, vector: str = "embedding", id: str = "vec_id", components: int = 4, scale: int = 256) -> DataFrame:
    """(id, component, n, deviation as decimal(38,0), whitened, explained, identity_error) of each row and component."""
    ship(rows.sparkSession)
    made = quantized(rows, vector, scale).select(F.col(id).alias("id"), F.size("x").alias("dim"), "x").filter("dim > 0")
    # Equal vectors meet in their tasks before they are dealt out.
    distinct = scratch(made.groupBy("x").agg(F.first("dim").alias("dim")).select("dim", "x"), "vectors")
    spaces = fit(distinct, components)
    for dim, error in identity_errors(distinct, spaces).items():
        spaces[dim].error = error
    discard(distinct)
    id_type = made.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(id_type)), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        from decimal import Decimal

        for b in slices(batches, 4096, 4_000_000):
            lengths = b.column(1).to_numpy()
            for dim in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == dim))
                space = spaces[dim]
                y = centred(_matrix(own.column(2), dim), space)
                w, far, k = projected(y, space), [Decimal(v) for v in deviations(y)], len(space.roots)
                ids = own.column(0).take(pa.array(np.repeat(np.arange(len(y)), k)))
                flat = w.ravel()
                yield batch(
                    {
                        "id": ids, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)), "n": np.full(len(flat), space.n), "deviation": [d for d in far for _ in range(k)],
                        "whitened": pa.array(flat, mask=np.isnan(flat)), "explained": space.explained * len(y), "identity_error": [space.error] * len(flat),
                    },
                    schema,
                )

    out = made.mapInArrow(tidied(run), f"id {id_type.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
