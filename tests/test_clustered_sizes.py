"""Tasks that lay a table out do not grow with it."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import clustered


@pytest.fixture
def rows(spark):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    return spark.range(8000).select(F.format_string("m%05d", "id").alias("id_mutation"), F.lit("0").alias("numero_disposition"), F.lit("75").alias("code_departement"), day.alias("date_mutation"), (F.col("id") % 90 / 10).alias("longitude"), (F.col("id") % 70 / 10 + 42).alias("latitude"))


def largest(spark, path):
    return max(r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect())


def test_more_rows_are_dealt_to_more_tasks(spark, rows, tmp_path, monkeypatch):
    """A number of partitions is the least one; files have a task's rows each."""
    monkeypatch.setattr(clustered, "TASK_ROWS", 1000, raising=False)
    kept = clustered.PagedTable(spark, str(tmp_path / "p"))
    kept.write(rows, 2)
    clustered.write_by_place(rows, str(tmp_path / "z"), 2)
    assert largest(spark, str(tmp_path / "p/rows")) < 2000 and largest(spark, str(tmp_path / "z")) < 2000
    assert kept.total("75") == 8000 and spark.read.parquet(str(tmp_path / "z")).count() == 8000
    assert [r["id_mutation"] for r in kept.page("75", 2, 3).collect()] == ["m00159", "m00199", "m00239"]
