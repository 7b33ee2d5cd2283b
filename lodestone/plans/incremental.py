"""The price views kept up to date by snapshots, without reading earlier rows again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orderindex import OrderIndex
from ..operators.quantiles import between
from . import views
from .views import GROUP


@dataclass
class IncrementalViews:
    """Views over all snapshots that were added; ``root`` holds their indexes.

    Months and years share one index, since a year's counts are the sum of its months'. Tiles have their own, by group
    and geohash, because held prices depend on bounds that move as rows come in.
    """

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.months = OrderIndex(self.spark, f"{self.root}/months", [*GROUP, "month_start"], ["prix_m2", "valeur_fonciere"])
        self.tiles = OrderIndex(self.spark, f"{self.root}/tiles", [*GROUP, "geohash6"], ["prix_m2"])

    def add(self, transactions: DataFrame, snapshot: str, only: tuple[str, ...] = ()) -> None:
        """Count in the transactions of a snapshot, in the indexes named or in all. A repeated call changes nothing."""
        base = views.residential_base(transactions).dropna(subset=GROUP)
        if not only or "months" in only:
            self.months.add(base, snapshot)
        if not only or "tiles" in only:
            self.tiles.add(base.filter("geohash6 IS NOT NULL"), snapshot)

    def bounds(self) -> DataFrame:
        """The group's 1st and 99th percentile as _low and _high."""
        found = self.months.statistics(GROUP, {"a": ("prix_m2", 0.01), "b": ("prix_m2", 0.99)})
        return found.select(*GROUP, between("a").alias("_low"), between("b").alias("_high"))

    def price_metrics(self) -> DataFrame:
        return views.metrics_of(self.months.statistics(GROUP, {"p": ("prix_m2", 0.5), "v": ("valeur_fonciere", 0.5)}))

    def price_metrics_yoy(self) -> DataFrame:
        return views.yoy_of(self.months.statistics(GROUP, views.HELD))

    def monthly_price(self) -> DataFrame:
        keys = [*GROUP, "month_start"]
        found = self.months.statistics(keys, {"m": ("prix_m2", 0.5)}).join(self.bounds().withColumnsRenamed({"_low": "p01", "_high": "p99"}), GROUP)
        return found.select("month_start", "code_departement", "type_local", F.col("_n").alias("n"), between("m", views._held).alias("median_prix_m2_w"))

    def tiles_gh64(self) -> DataFrame:
        found = self.tiles.held_statistics(["year_mutation", "geohash6"], self.bounds(), GROUP, "m", 0.5)
        return found.select("year_mutation", "geohash6", F.col("_n").alias("n"), between("m").alias("median_prix_m2_w"))
