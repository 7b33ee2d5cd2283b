"""Parquet tables: scans, snapshots, partitioned writes and manifests."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits, files


def scan(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The union of a table's snapshots under data/; an error if there is none.

    A table with a commit log is what the log lists, at a version if one is asked for.
    """
    if version is not None or commits.exists(spark, root):
        return commits.scan(spark, root, version)
    path = f"{root}/data"
    if not files.children(spark, path):
        raise FileNotFoundError(f"no parquet files under {path}")
    return spark.read.parquet(path)


def scan_or_empty(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    if commits.exists(spark, root):
        return commits.scan(spark, root, schema=schema)
    path = f"{root}/data"
    return spark.read.schema(schema).parquet(path) if files.children(spark, path) else spark.createDataFrame([], schema)


def scan_stage(spark: SparkSession, path: str) -> DataFrame:
    """A stage's output; an error that names it if the stage has not run."""
    if not files.exists(spark, path):
        raise FileNotFoundError(f"missing input: {path}")
    return spark.read.parquet(path)


def scan_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Hive-style folders, columns united by name. Partition values stay text ('01' is no number)."""
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    return spark.read.option("mergeSchema", True).parquet(path)


def snapshot_id() -> str:
    now = datetime.now(timezone.utc)
    return now.strftime("%Y%m%dT%H%M%S") + f"{now.microsecond // 1000:03d}Z" + uuid.uuid4().hex[:4]  # writers may begin at once


def append_snapshot(df: DataFrame, root: str) -> str:
    """Append and commit rows under a snapshot id of their own and return it."""
    made = snapshot_id()
    commits.append(df, root, made)
    return made


def scan_snapshots(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All snapshots of a table without their ids."""
    return scan(spark, root, version).drop("snapshot")


def write_partitioned(df: DataFrame, path: str, columns: list[str], keep_others: bool = False, sort: list[str] | None = None) -> None:
    """One folder for each partition value.

    Rows of a partition are rebalanced, so that a partition with a third of all rows is split between tasks and
    small ones are merged. ``keep_others`` leaves partitions that this run does not touch.
    """
    even = df.hint("rebalance", *columns)
    if sort:
        even = even.sortWithinPartitions(*columns, *sort)
    writer = even.write.mode("overwrite").partitionBy(*columns).option("compression", "zstd")
    if keep_others:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def manifest_path(root: str, dataset: str, name: str) -> str:
    return f"{root}/manifests/{dataset}/{name}"


def publish(spark: SparkSession, root: str, dataset: str, snapshot_date: str, schema: T.StructType) -> tuple[int, int]:
    """Commit a Gold snapshot that has been written: the log, commit.json with each file's rows, and latest.json.

    Executors list the files. Returns how many there are, and their rows.
    """
    gold, folder = f"{root}/gold/{dataset}", f"snapshot_date={snapshot_date}"
    commits.begin(spark, gold)
    read = commits.replay(spark, gold).version
    listing, rows = commits.list_files(spark, gold, folder)
    count = write_commit(spark, root, dataset, snapshot_date, f"{gold}/_log/{listing}", folder)
    commits.commit(spark, gold, {"snapshot": snapshot_date, "files": listing, "rows": rows, "scope": snapshot_date, "schema": schema.jsonValue()}, read)
    files.write_json(spark, manifest_path(root, dataset, "latest.json"), {"snapshot_date": snapshot_date})
    return count, rows


def write_commit(spark: SparkSession, root: str, dataset: str, snapshot_date: str, listing: str, folder: str) -> int:
    """commit.json from a stored list of files, of which the driver holds a part at a time; their number."""
    listed = spark.read.parquet(listing).select(F.substring_index("path", f"{folder}/", -1).alias("path"), "rows").orderBy("path")
    count = 0

    def text():
        nonlocal count
        yield f'{{"dataset": {json.dumps(dataset)}, "snapshot_date": {json.dumps(snapshot_date)}, "files": ['
        for r in listed.toLocalIterator():
            yield ("," if count else "") + json.dumps({"path": unquote(r["path"]), "rows": r["rows"]}, ensure_ascii=False)
            count += 1
        yield "]}"

    files.write_pieces(spark, manifest_path(root, dataset, f"{snapshot_date}/commit.json"), text())
    return count


def latest_snapshot(spark: SparkSession, root: str, dataset: str, snapshot_date: str | None = None) -> str:
    """The date asked for, or the one that latest.json points to."""
    if snapshot_date:
        return snapshot_date
    path = manifest_path(root, dataset, "latest.json")
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no published snapshot: {path}")
    return files.read_json(spark, path)["snapshot_date"]
