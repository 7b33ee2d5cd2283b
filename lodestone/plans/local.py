"""The file pipeline: ingest, validate, curate, refresh. Stages meet only through files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import commits, files, tables
from ..sources.delimited import read_bronze
from . import validate as V
from . import views


@dataclass
class IngestStats:
    rows: int
    bytes: int
    parts: int


@dataclass
class ValidateStats:
    rows_in: int
    rows_out: int
    rejects: int
    duplicates: int


@dataclass
class CurateStats:
    files: int
    rows: int


def stage_path(root: str, stage: str, dataset: str, ingest_date: str) -> str:
    return f"{root}/{stage}/{dataset}/ingest_date={ingest_date}"


def ingest(spark: SparkSession, dataset: str, source: str, ingest_date: str, root: str, multiline: bool | None = None) -> IngestStats:
    """Delimited text to Bronze; a date's rows are replaced."""
    path = stage_path(root, "bronze", dataset, ingest_date)
    read_bronze(spark, files.resolve_uri(source), ingest_date, multiline=multiline).drop("ingest_date").write.mode("overwrite").option("compression", "zstd").parquet(path)
    parts = [p for p in files.walk(spark, path) if p.endswith(".parquet")]
    fs, target = files._fs(spark, path)
    return IngestStats(spark.read.parquet(path).count(), fs.getContentSummary(target).getLength(), len(parts))


def bronze_of(spark: SparkSession, dataset: str, ingest_date: str, root: str) -> DataFrame:
    df = tables.scan_stage(spark, stage_path(root, "bronze", dataset, ingest_date))
    return df.withColumn("ingest_date", F.lit(ingest_date))


def validate(spark: SparkSession, dataset: str, ingest_date: str, root: str, **options) -> ValidateStats:
    """Bronze to Silver and Rejects. rows_in = rows_out + rejects + duplicates."""
    bronze = bronze_of(spark, dataset, ingest_date, root)
    # Judging a row takes a few of its columns; doing so for Silver and for Rejects costs less than storing all rows between.
    made = V.validate(bronze, **options)
    silver, rejects = stage_path(root, "silver", dataset, ingest_date), stage_path(root, "rejects", dataset, ingest_date)
    made.silver.write.mode("overwrite").option("compression", "zstd").parquet(silver)
    made.rejects.drop("ingest_date").write.mode("overwrite").option("compression", "zstd").parquet(rejects)
    rows_in, rows_out, bad = (spark.read.parquet(p).count() for p in (stage_path(root, "bronze", dataset, ingest_date), silver, rejects))
    return ValidateStats(rows_in, rows_out, bad, rows_in - rows_out - bad)


def curate(spark: SparkSession, dataset: str, ingest_date: str, snapshot_date: str, root: str, keep_others: bool = False) -> CurateStats:
    """Silver to a Gold snapshot by year and department, then the manifests."""
    silver = tables.scan_stage(spark, stage_path(root, "silver", dataset, ingest_date))
    path = f"{root}/gold/{dataset}/snapshot_date={snapshot_date}"
    dept = F.coalesce(F.nullif(F.trim("code_departement"), F.lit("")), F.lit("UNK"))
    tables.write_partitioned(silver.withColumn("year", F.col("year_mutation")).withColumn("dept", dept), path, ["year", "dept"], keep_others, sort=["date_mutation"])
    schema = T.StructType([*silver.schema.fields, T.StructField("year", silver.schema["year_mutation"].dataType), T.StructField("dept", T.StringType())])
    return CurateStats(*tables.publish(spark, root, dataset, snapshot_date, schema))


def gold(spark: SparkSession, dataset: str, root: str, snapshot_date: str | None = None) -> DataFrame:
    """The latest Gold snapshot with its partition columns year and dept, of the files that its commit lists."""
    date = tables.latest_snapshot(spark, root, dataset, snapshot_date)
    if commits.exists(spark, f"{root}/gold/{dataset}"):
        return commits.scan(spark, f"{root}/gold/{dataset}", base=f"snapshot_date={date}", scope=date)
    return tables.scan_partitioned(spark, f"{root}/gold/{dataset}/snapshot_date={date}")


def sanitize(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def refresh(spark: SparkSession, dataset: str, root: str, snapshot_date: str | None = None, departments: DataFrame | None = None) -> list[str]:
    """Register the views of a dataset as temporary views <dataset>_<view>; returns their names."""
    latest = gold(spark, dataset, root, snapshot_date).drop("year", "dept")
    ref = f"{root}/gold/ref/departements.parquet"
    if departments is None and files.exists(spark, ref):
        departments = spark.read.parquet(ref)
    names = []
    for view, df in views.build_all(latest, departments).items():
        name = f"{sanitize(dataset)}_{view}"
        df.createOrReplaceTempView(name)
        names.append(name)
    if departments is not None:
        departments.createOrReplaceTempView("ref_departements")
        names.append("ref_departements")
    return names
