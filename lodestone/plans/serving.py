"""Serving rows and the parameterised queries over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: How the serving table types the raw columns; the rest is text.
SERVING_KINDS = {
    "int": ["numero_disposition", "adresse_numero", "code_postal", "code_commune", "code_departement", "nombre_lots", "code_type_local", "surface_reelle_bati", "nombre_pieces_principales", "surface_terrain"],
    "float": ["valeur_fonciere", "longitude", "latitude", "lot1_surface_carrez", "lot2_surface_carrez", "lot3_surface_carrez", "lot4_surface_carrez", "lot5_surface_carrez"],
    "upper": ["nature_mutation", "nom_commune", "adresse_nom_voie"],
    "title": ["type_local"],
    "date": ["date_mutation"],
}
_HOW = {"int": X.norm_int, "float": X.norm_float, "upper": X.norm_upper, "title": X.norm_title, "date": X.norm_date}
_KIND = {name: kind for kind, names in SERVING_KINDS.items() for name in names}


def serving_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the raw rows that are refused.

    Refused: no date, an amount of zero or less, a negative built surface. Coordinates outside the globe are NULL.
    """
    names = [c for c in raw.columns if c != "row_number"]
    made = {n: _HOW.get(_KIND.get(n, ""), X.norm_text)(F.col(f"`{n}`")) for n in names}
    for name, limit in (("longitude", 180.0), ("latitude", 90.0)):
        if name in made:
            made[name] = F.when(F.abs(made[name]) <= limit, made[name])
    bad = made["date_mutation"].isNull() | F.coalesce(made["valeur_fonciere"] <= 0, F.lit(False)) | F.coalesce(made["surface_reelle_bati"] < 0, F.lit(False))
    marked = raw.withColumn("_bad", bad)
    good = marked.filter("NOT _bad").select(
        *[c.alias(n) for n, c in made.items()],
        F.year(made["date_mutation"]).cast("short").alias("year"),
        F.when(made["surface_reelle_bati"] > 0, made["valeur_fonciere"] / made["surface_reelle_bati"]).alias("prix_m2"),
    )
    return good, marked.filter("_bad").drop("_bad")


def write_rows(rows: DataFrame, path: str | None = None, jdbc_url: str | None = None, table: str = "dvfs", batch: int = 200, **options: str) -> None:
    """Append typed rows to the serving table: Parquet by year, a database over JDBC in batches of one statement, or both.

    JDBC writes from every task, a transaction each; ``options`` are the driver's own (user, password, driver).
    """
    if path:
        rows.hint("rebalance", "year").write.mode("append").partitionBy("year").option("compression", "zstd").parquet(path)
    if jdbc_url:
        rows.write.format("jdbc").options(url=jdbc_url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def _typed(column: str, df: DataFrame, value):
    """A literal of the column's own type, so that the comparison reaches the file scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def filter_rows(df: DataFrame, dep, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    out = df.filter(F.col("code_departement") == _typed("code_departement", df, dep))
    if date_from:
        out = out.filter(F.col("date_mutation") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.filter(F.col("date_mutation") <= F.lit(date_to).cast("date"))
    return out


@dataclass
class Page:
    rows: DataFrame
    page: int
    per_page: int
    source: DataFrame

    def total(self) -> int:
        return self.source.count()


def paginate(df: DataFrame, page: int = 1, per_page: int = 50, ties: tuple[str, ...] = ("id_mutation", "numero_disposition")) -> Page:
    """Newest first. Pages count from 1, at most 500 rows each; ties are broken, so pages never overlap."""
    page, per_page = max(1, page), max(1, min(500, per_page))
    order = [F.desc("date_mutation"), *[F.asc(c) for c in ties if c in df.columns]]
    return Page(df.orderBy(*order).offset((page - 1) * per_page).limit(per_page), page, per_page, df)


def _priced(df: DataFrame, dep, year: int) -> DataFrame:
    return df.filter((F.col("code_departement") == _typed("code_departement", df, dep)) & (F.col("year") == _typed("year", df, year)) & F.col("prix_m2").isNotNull())


def agg_commune(df: DataFrame, dep, year: int, limit: int = 100) -> DataFrame:
    """Mean, median and count of the price by commune, dearest first."""
    rows = _priced(df, dep, year)
    return rows.groupBy("nom_commune").agg(F.avg("prix_m2").alias("avg_prix_m2"), F.percentile("prix_m2", F.lit(0.5)).alias("median_prix_m2"), F.count("*").alias("n")).orderBy(F.desc("avg_prix_m2"), "nom_commune").limit(limit)


def top_n(df: DataFrame, dep, year: int, n: int = 20) -> DataFrame:
    rows = _priced(df, dep, year)
    return rows.groupBy("nom_commune").agg(F.avg("prix_m2").alias("avg_prix_m2"), F.count("*").alias("n")).orderBy(F.desc("avg_prix_m2"), "nom_commune").limit(max(1, min(200, n)))


def geo_bbox(df: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, year: int | None = None) -> DataFrame:
    out = df.filter(F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(min_lat, max_lat))
    return out.filter(F.col("year") == _typed("year", df, year)) if year is not None else out
