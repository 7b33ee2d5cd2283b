"""Serving tables laid out for their queries: by place and day for boxes, in page order for pages.

``write_by_place`` orders rows along a Z-curve of longitude, latitude and day, in range-partitioned files of small row
groups, so that a box meets few of them by their statistics; a Bloom filter on the department serves that filter.

``PagedTable`` keeps rows in the order of their pages: department, newest day first, ties. The rows of a filter are
then one run of that order, and a page is a place in it. A small table counts the rows of each department and day in
each file and tells where they begin there; sums over it give a page's files and row numbers, and the totals. No page
is sorted or skipped over: page 10,000 reads what page 1 reads, the one or two files that it lies in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 16
TASK_ROWS = 500_000  # rows that one task sorts and writes, about 200 MB of them


def z_order(*places: Column, bits: int = BITS) -> Column:
    """Whole numbers below 2^bits interleaved bit by bit; NULL counts as 0."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, place in enumerate(places):
            bit = F.shiftright(F.coalesce(place, F.lit(0)).cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            out = out + F.shiftleft(bit, len(places) * i + k)
    return out


def place_key() -> Column:
    """The Z-curve's place of a row: 182 steps a degree of longitude, 364 of latitude, one a day."""
    step = lambda c, low, span: F.least(F.greatest(F.floor((F.col(c) - low) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1))
    days = F.least(F.greatest(F.datediff("date_mutation", F.lit("1900-01-01").cast("date")), F.lit(0)), F.lit((1 << BITS) - 1))
    return z_order(step("longitude", -180.0, 360.0), step("latitude", -90.0, 180.0), days)


def dealt_over(rows: DataFrame, partitions: int | None) -> int:
    """How many tasks sort the rows: ``partitions`` at least, and as many as TASK_ROWS asks for, so that none grows with the table."""
    return max(partitions or 1, -(-rows.count() // TASK_ROWS))


def write_by_place(rows: DataFrame, path: str, partitions: int | None = None, group_bytes: int = 1 << 23) -> None:
    """Write the rows along the curve by ``partitions`` tasks or more. Rows of one place are told apart by a hash, so a hot one spreads over files."""
    keyed = rows.withColumns({"_z": place_key(), "_tie": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])})
    dealt = keyed.repartitionByRange(dealt_over(rows, partitions), "_z", "_tie").sortWithinPartitions("_z")
    writer = dealt.drop("_z", "_tie").write.mode("overwrite").option("compression", "zstd")
    writer.option("parquet.block.size", group_bytes).option("parquet.bloom.filter.enabled#code_departement", "true").parquet(path)


@dataclass
class PagedTable:
    """Rows in page order below ``path``, and their counts. ``ties`` break the order of a day's rows."""

    spark: SparkSession
    path: str
    ties: tuple[str, ...] = ("id_mutation", "numero_disposition")

    def write(self, rows: DataFrame, partitions: int | None = None, file_rows: int = 1_000_000) -> None:
        """Write the rows by ``partitions`` tasks or more, and count them."""
        order = [F.asc("code_departement"), F.desc("date_mutation"), *[F.asc(c) for c in self.ties]]
        dealt = rows.repartitionByRange(dealt_over(rows, partitions), *order).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(f"{self.path}/rows")
        # Files are named in the order of their ranges, and rows are numbered in them.
        placed = self._rows().select("code_departement", "date_mutation", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        counted = placed.groupBy("code_departement", "date_mutation", "file").agg(F.count("*").alias("n"), F.min("row").alias("first"))
        counted.repartitionByRange("code_departement", "date_mutation").sortWithinPartitions("code_departement", "date_mutation").write.mode("overwrite").parquet(f"{self.path}/counts")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _counts(self, dep, date_from: str | None, date_to: str | None) -> DataFrame:
        counts = self.spark.read.parquet(f"{self.path}/counts")
        out = counts.filter(F.col("code_departement") == F.lit(dep).cast(counts.schema["code_departement"].dataType))
        if date_from:
            out = out.filter(F.col("date_mutation") >= F.lit(date_from).cast("date"))
        if date_to:
            out = out.filter(F.col("date_mutation") <= F.lit(date_to).cast("date"))
        return out

    def total(self, dep, date_from: str | None = None, date_to: str | None = None) -> int:
        return self._counts(dep, date_from, date_to).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def _run(self, dep, date_from, date_to) -> DataFrame:
        """The filter's counts with the rows before each, _before: one department's days."""
        order = Window.partitionBy("code_departement").orderBy(F.desc("date_mutation"), "file").rowsBetween(Window.unboundedPreceding, -1)
        return self._counts(dep, date_from, date_to).withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0)))

    def at(self, dep, offset: int, per_page: int = 50, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The ``per_page`` rows (500 at most) from a place in the filter's order on, with _file and _row, newest first."""
        per_page = max(1, min(500, per_page))
        low, high = F.greatest(F.lit(offset) - F.col("_before"), F.lit(0)), F.least(F.lit(offset + per_page) - F.col("_before"), F.col("n"))
        parts = self._run(dep, date_from, date_to).select("file", (F.col("first") + low).alias("low"), (F.col("first") + high).alias("high")).filter("low < high")
        found = parts.groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a page's files: no more than its rows
        rows = self._rows().withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
        here = F.lit(False)
        for r in found:
            here = here | ((F.col("_metadata.file_name") == r["file"]) & F.col("_row").between(r["low"], r["high"] - 1))
        return rows.filter(F.col("_metadata.file_name").isin([r["file"] for r in found])).filter(here).orderBy("_file", "_row")

    def page(self, dep, page: int = 1, per_page: int = 50, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """A page's rows; pages count from 1."""
        per_page = max(1, min(500, per_page))
        return self.at(dep, (max(1, page) - 1) * per_page, per_page, date_from, date_to).drop("_file", "_row")

    def after(self, cursor: tuple[str, int], dep, per_page: int = 50, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The rows that follow the one whose (_file, _row) is the cursor."""
        file, row = cursor
        place = F.col("_before") + F.lit(row + 1) - F.col("first")
        own = self._run(dep, date_from, date_to).filter((F.col("file") == file) & (F.col("first") <= row) & (row < F.col("first") + F.col("n"))).select(place.alias("at")).first()
        if own is None:
            raise ValueError("the cursor is not a row of this filter")
        return self.at(dep, own["at"], per_page, date_from, date_to)
