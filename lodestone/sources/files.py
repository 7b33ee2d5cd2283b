"""Paths and small documents, through the file systems that Spark knows."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def unique(name: str) -> str:
    """``name`` with an ending that no other call gives."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def resolve_uri(uri: str) -> str:
    """A file:// URI as a plain, percent-decoded path; other schemes stay."""
    return unquote(uri[len("file://") :]) if uri.startswith("file://") else uri


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def walk(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files under a folder."""
    fs, target = _fs(spark, path)
    out, files = [], fs.listFiles(target, True)
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_pieces(spark, path, [text])


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[str]) -> None:
    """Write to a file beside ``path`` and move it there, so that readers see the old or the new text."""
    fs, target = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs.mkdirs(target.getParent())
    stream = fs.create(beside, True)
    try:
        for text in pieces:
            stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(beside, target):  # some file systems do not replace
        fs.delete(target, False)
        if not fs.rename(beside, target):
            raise OSError(f"cannot publish {path}")


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; removed at the end.

    Where that is unset it is a temporary one, on a single machine only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'lodestone-checkpoints')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    fs.deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for plans that use it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
