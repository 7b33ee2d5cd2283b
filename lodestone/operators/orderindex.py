"""Grouped quantiles kept up to date: a mergeable index of counted values.

Each snapshot leaves two tables: how many values each group has in each bin (``counts``), and the different values with
their counts (``values``), in folders by zones of neighbouring bins. Counts of snapshots add up, so a refresh counts the new
rows only, tells from all counts in which bins the quantiles lie, and reads just those zones' values. Nothing is
read of rows that are already in, and no group is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits, files
from .joins import join_null_safe
from .quantiles import cells, hit_bins, ordered_bin, picked

ZONE = 64  # bins in a folder: a quarter of a doubling


@dataclass
class OrderIndex:
    """An index of ``columns`` by ``keys`` in a folder of its own."""

    spark: SparkSession
    root: str
    keys: list[str]
    columns: list[str]

    def add(self, rows: DataFrame, snapshot: str) -> bool:
        """Count a snapshot's rows in. One that is in already is left alone, so that a refresh can be repeated."""
        commits.begin(self.spark, self.root)
        state = commits.replay(self.spark, self.root)
        if any(s["snapshot"] == snapshot for s in state.snapshots):
            return False
        counted = cells(rows, self.keys, self.columns).groupBy(*self.keys, "_w", "_r", "_v").agg(F.count("*").alias("_c")).withColumn("_zone", F.floor(F.col("_r") / ZONE).cast("int"))
        name = files.unique(snapshot)
        folder = f"values/part={name}"
        counted.repartition("_zone").sortWithinPartitions("_zone", *self.keys).write.partitionBy("_zone").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        if not any(n.startswith("_zone=") for n in files.children(self.spark, f"{self.root}/{folder}")):
            return True  # no value to count
        own = self.spark.read.schema(counted.schema).parquet(f"{self.root}/{folder}")
        own.groupBy(*self.keys, "_w", "_r").agg(F.sum("_c").alias("_t")).write.option("compression", "zstd").parquet(f"{self.root}/counts/part={name}")
        entry = {"snapshot": snapshot, "files": name, "rows": own.count(), "scope": snapshot, "schema": counted.schema.jsonValue()}
        commits.commit(self.spark, self.root, entry, state.version)
        return True

    def _parts(self) -> list[str]:
        return [s["files"] for s in commits.replay(self.spark, self.root).snapshots]

    def counts(self) -> DataFrame:
        """keys, _w, _r and _t, which still has a row for each snapshot."""
        return self.spark.read.parquet(*[f"{self.root}/counts/part={p}" for p in self._parts()])

    def values(self, zones: list[int]) -> DataFrame:
        """keys, _w, _r, _v, _c of the zones; other folders are not opened."""
        rows = self.spark.read.option("basePath", f"{self.root}/values").parquet(*[f"{self.root}/values/part={p}" for p in self._parts()])
        return rows.filter(F.col("_zone").cast("int").isin(zones)).drop("_zone", "part")

    def statistics(self, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
        """As ``order_statistics`` over all rows that were added, for these keys or some of them."""
        totals = self.counts().groupBy(*keys, "_w", "_r").agg(F.sum("_t").alias("_t"))
        hit = files.materialize(hit_bins(totals, keys, wanted, self.columns), "hit-bins")
        return picked(self._near(hit, keys, F.col("_v")), keys, wanted, self.columns)

    def _near(self, hit: DataFrame, keys: list[str], value) -> DataFrame:
        zones = [r["z"] for r in hit.select(F.floor(F.col("_r") / ZONE).cast("int").alias("z")).distinct().collect()]  # as many as there are zones
        joined = join_null_safe(self.values(zones), hit, [*keys, "_w", "_r"]).withColumn("_v", value)
        return joined.groupBy(*keys, "_w", "_r", "_v").agg(F.sum("_c").alias("_c"), F.max("_b").alias("_b"), F.max("_n").alias("_n"))

    def held_statistics(self, keys: list[str], bounds: DataFrame, of: list[str], name: str, quantile: float) -> DataFrame:
        """Like ``statistics`` for one quantile of the first column, each value first held between _low and _high of its
        group ``of`` (a subset of the index's keys; groups without bounds are left out).

        A bin below a group's lower bound counts as the bound's own, so held bins follow from the counts; only values
        in hit bins are read, and the bounds themselves stand for all values beyond them.
        """
        edges = bounds.withColumns({"_lr": ordered_bin(F.col("_low")), "_hr": ordered_bin(F.col("_high"))})
        raw = join_null_safe(self.counts().filter("_w = 0"), edges, of)
        held = F.greatest(F.least(F.col("_r"), F.col("_hr")), F.col("_lr"))
        # Values of whole bins beyond a bound are that bound.
        moved = files.materialize(raw.withColumn("_v", F.when(F.col("_r") < F.col("_lr"), F.col("_low")).when(F.col("_r") > F.col("_hr"), F.col("_high"))).withColumn("_r", held).groupBy(*keys, "_w", "_r", "_v").agg(F.sum("_t").alias("_t")), "held-bins")
        hit = files.materialize(hit_bins(moved.groupBy(*keys, "_w", "_r").agg(F.sum("_t").alias("_t")), keys, {name: (self.columns[0], quantile)}, self.columns), "hit-bins")
        beyond = join_null_safe(moved.filter("_v IS NOT NULL").withColumnRenamed("_t", "_c"), hit, [*keys, "_w", "_r"]).select(*keys, "_w", "_r", "_v", "_c", "_b", "_n")
        zones = [r["z"] for r in hit.select(F.floor(F.col("_r") / ZONE).cast("int").alias("z")).distinct().collect()]
        inside = join_null_safe(self.values(zones).filter("_w = 0"), edges, of).filter("_r BETWEEN _lr AND _hr").withColumn("_v", F.greatest(F.least("_v", "_high"), "_low"))
        near = join_null_safe(inside, hit, [*keys, "_w", "_r"]).select(*keys, "_w", "_r", "_v", "_c", "_b", "_n").unionByName(beyond)
        return picked(near.groupBy(*keys, "_w", "_r", "_v").agg(F.sum("_c").alias("_c"), F.max("_b").alias("_b"), F.max("_n").alias("_n")), keys, {name: (self.columns[0], quantile)}, self.columns)
