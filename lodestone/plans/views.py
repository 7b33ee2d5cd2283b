"""The analytic views over the latest Gold snapshot. Each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import between, group_quantiles, order_statistics
from ..operators.spatial import points_in_polygons, with_edges
from ..sources.files import materialize

GROUP = ["year_mutation", "code_departement", "type_local"]


def transaction_latest(latest: DataFrame) -> DataFrame:
    """Presentation columns with defaults; the row key stays behind."""
    return latest.select(
        "id_mutation", "numero_disposition", "nature_mutation", "date_mutation", "valeur_fonciere", "surface_reelle_bati", "nombre_pieces_principales", "code_type_local",
        F.upper(F.coalesce("type_local", F.lit("INCONNU"))).alias("type_local"), "code_postal", "code_commune", F.upper("nom_commune").alias("nom_commune"),
        F.coalesce("code_departement", F.lit("UNK")).alias("code_departement"), "longitude", "latitude", "geohash6", "prix_m2",
        F.year("date_mutation").cast("short").alias("year_mutation"), F.trunc("date_mutation", "month").alias("month_start"),
    )


def points(transactions: DataFrame) -> DataFrame:
    """Rows with both coordinates, and the point as WKT."""
    return transactions.filter("longitude IS NOT NULL AND latitude IS NOT NULL").withColumn("geom", F.concat(F.lit("POINT ("), F.col("longitude").cast("string"), F.lit(" "), F.col("latitude").cast("string"), F.lit(")")))


def points_ll(transactions: DataFrame) -> DataFrame:
    return points(transactions).select("id_mutation", "date_mutation", "year_mutation", "month_start", "code_departement", "type_local", "valeur_fonciere", "prix_m2", "latitude", "longitude")


def residential_base(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.upper("type_local").isin("APPARTEMENT", "MAISON") & (F.col("surface_reelle_bati") > 9) & (F.col("prix_m2") > 0))


def residential_latest(transactions: DataFrame) -> DataFrame:
    """Flats and houses with the price held between the group's 1st and 99th percentile."""
    base = residential_base(transactions)
    q = group_quantiles(base, GROUP, "prix_m2", {"p01": 0.01, "p99": 0.99})
    # Spark broadcasts q when its size allows; otherwise the join is skew-handled.
    return base.join(q, GROUP).withColumn("prix_m2_winsor", F.greatest(F.least("prix_m2", "p99"), "p01")).drop("p01", "p99")


def summary(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("year_mutation", "code_departement").agg(F.count("*").alias("n_rows")).orderBy("year_mutation", "code_departement")


# A residential row is a base row, its price held between two bounds of its group (year, department, type). Holding
# keeps the order of values, so within such a group, or a part of it, the median of held prices follows from the two
# middle prices: those views need the base rows alone.


def _held(c):
    return F.greatest(F.least(c, F.col("p99")), F.col("p01"))


def _whole_groups(transactions: DataFrame) -> DataFrame:
    return residential_base(transactions).dropna(subset=GROUP)


def price_metrics(transactions: DataFrame) -> DataFrame:
    """Rows and exact medians of residential transactions by year, department and type."""
    return metrics_of(order_statistics(_whole_groups(transactions), GROUP, {"p": ("prix_m2", 0.5), "v": ("valeur_fonciere", 0.5)}))


def metrics_of(found: DataFrame) -> DataFrame:
    return found.select(*GROUP, F.col("_n").alias("n"), between("v").alias("median_valeur_fonciere"), between("p").alias("median_prix_m2"))


def monthly_price(transactions: DataFrame) -> DataFrame:
    """Rows and the median of held prices by month, department and type.

    Months and years are counted in the same passes; a month's bounds are those of its year.
    """
    base = _whole_groups(transactions).select(*GROUP, "prix_m2", F.explode(F.array(F.col("month_start"), F.lit(None).cast("date"))).alias("month_start"))
    wanted = {"p01": ("prix_m2", 0.01), "p99": ("prix_m2", 0.99), "m": ("prix_m2", 0.5)}
    found = order_statistics(base, [*GROUP, "month_start"], wanted)
    year, whole = Window.partitionBy(*GROUP), F.col("month_start").isNull()
    bounded = found.select("*", *[F.max(F.when(whole, between(p))).over(year).alias(p) for p in ("p01", "p99")]).filter(~whole)
    return bounded.select("month_start", "code_departement", "type_local", F.col("_n").alias("n"), between("m", _held).alias("median_prix_m2_w"))


def price_metrics_yoy(transactions: DataFrame) -> DataFrame:
    """The median of held prices, and its change against the previous year that is there."""
    return yoy_of(order_statistics(_whole_groups(transactions), GROUP, HELD))


#: What the median of held prices of a whole group follows from.
HELD = {"p01": ("prix_m2", 0.01), "p99": ("prix_m2", 0.99), "m": ("prix_m2", 0.5)}


def yoy_of(found: DataFrame) -> DataFrame:
    y = found.select("*", between("p01").alias("p01"), between("p99").alias("p99")).select(*GROUP, between("m", _held).alias("med_p2"))
    previous = F.lag("med_p2").over(Window.partitionBy("code_departement", "type_local").orderBy("year_mutation"))
    return y.withColumn("_p", previous).select(*GROUP, "med_p2", F.when(F.col("_p").isNotNull() & (F.col("_p") != 0), F.col("med_p2") / F.col("_p") - 1.0).alias("yoy_med_p2"))


def tiles_gh64(residential: DataFrame) -> DataFrame:
    """Rows and the median of held prices by year and geohash. Its input is read twice: best a stored table."""
    keys = ["year_mutation", "geohash6"]
    found = order_statistics(residential.filter("geohash6 IS NOT NULL"), keys, {"m": ("prix_m2_winsor", 0.5)})
    return found.select(*keys, F.col("_n").alias("n"), between("m").alias("median_prix_m2_w"))


def by_dept(departments: DataFrame, located: DataFrame, residential: DataFrame) -> DataFrame:
    """Residential rows of the mutations that have a point in a department.

    A mutation with m points and n residential rows counts m n times; m travels as a weight instead of as rows.
    """
    keys = ["code_departement", "nom_departement"]
    spots = located.select("id_mutation", "longitude", "latitude")
    weights = points_in_polygons(with_edges(departments).select(*keys, "edges"), spots).groupBy(*keys, "id_mutation").agg(F.count("*").alias("m"))
    joined = weights.join(residential.select("id_mutation", "prix_m2_winsor"), "id_mutation")
    counted = materialize(joined.groupBy(*keys, "prix_m2_winsor").agg(F.sum("m").alias("m")), "by-department")
    found = order_statistics(counted, keys, {"w": ("prix_m2_winsor", 0.5)}, "m")
    return found.select(*keys, F.col("_n").alias("n"), between("w").alias("median_prix_m2_w"))


def build_all(latest: DataFrame, departments: DataFrame | None = None) -> dict[str, DataFrame]:
    """All views by name, in order of dependence."""
    t = transaction_latest(latest)
    # Several views read it, some twice: it is stored once.
    r = materialize(residential_latest(t), "residential")
    out = {
        "latest": latest,
        "transaction_latest": t,
        "points": points(t),
        "points_ll": points_ll(t),
        "residential_latest": r,
        "summary": summary(t),
        "price_metrics": price_metrics(t),
        "monthly_price": monthly_price(t),
        "price_metrics_yoy": price_metrics_yoy(t),
        "tiles_gh64": tiles_gh64(r),
    }
    if departments is not None:
        out["by_dept"] = by_dept(departments, points(t), r)
    return out
