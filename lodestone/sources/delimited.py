"""Delimited text: the all-text scan with lineage, and the typed scan with inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, norm_text
from . import files, quoted


def with_row_numbers(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Number the rows of a file scan from 1, in file order, without leaving the JVM.

    A split's rows are consecutive in its task, so a row's place there follows from the monotonic id; a table
    with one row for each split gives how many rows come before it. It is broadcast unless there are very many splits, so
    that the text itself is not shuffled.
    """
    held = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = held.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = files.materialize(splits.withColumn("_before", before).drop("_n"), "row-splits")
    placed = held.join(F.broadcast(table) if table.count() <= quoted.BROADCAST_SPLITS else table, ["_path", "_start"])
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_path", "_start", "_at", "_first", "_before")


def read_numbered(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool | None = None, name: str = "row_number") -> tuple[list[str], DataFrame]:
    """The header's names, and every column as text with the row's number. Short rows are padded, further fields dropped.

    By default a pass over the lines looks for one that leaves a quoted field open. Without any the lines are read as they
    are, else records are put together over lines and splits (``quoted``); large files are split between tasks
    either way. ``multiline=False`` skips that pass, and ``True`` leaves the files to Spark's reader, a task for each.
    """
    delimiter = delimiter[:1]
    options = {"header": True, "sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "inferSchema": False, "enforceSchema": True}
    joined = multiline is None and quoted.has_open_lines(spark, path, delimiter)
    df = spark.read.options(**options, multiLine=bool(multiline or joined)).csv(path)
    if not df.columns or all(not c.strip() or c.startswith("_c") and c[2:].isdigit() for c in df.columns):
        raise ValueError(f"empty header in {path}")
    return df.columns, quoted.read(spark, path, df.columns, delimiter, name) if joined else with_row_numbers(df, name)


def clean_text_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trim the columns and their names; blanks become NULL."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c.strip()) for c in columns], *others)


def read_bronze(spark: SparkSession, path: str, ingest_date: str, delimiter: str = ",", multiline: bool | None = None) -> DataFrame:
    """All-text rows with ingest_date, source_file and row_number."""
    names, numbered = read_numbered(spark, path, delimiter, multiline)
    clean = clean_text_columns(numbered, names)
    return clean.select(*[c.strip() for c in names], F.lit(ingest_date).alias("ingest_date"), F.lit(path).alias("source_file"), "row_number")


def read_typed(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, encoding: str = "utf-8", infer_rows: int | None = None) -> DataFrame:
    """A scan with inferred types; cells that do not parse are NULL."""
    if not delimiter:
        raise ValueError("empty delimiter")
    charset = "UTF-8" if encoding.lower() in ("utf-8", "utf8", "utf8-lossy", "lossy") else encoding
    options = {"header": has_header, "sep": delimiter[:1], "escape": '"', "encoding": charset, "mode": "PERMISSIVE"}
    text = spark.read.options(**options, inferSchema=False).csv(path)
    if infer_rows is None:
        return text
    head = [",".join(_quoted(v) for v in r) for r in text.limit(infer_rows).collect()]  # a bounded sample
    schema = spark.read.options(header=False, escape='"', inferSchema=True, mode="PERMISSIVE").csv(spark.sparkContext.parallelize(head or [""], 1)).schema
    kinds = {name: f.dataType.simpleString() for name, f in zip(text.columns, schema.fields)}
    return text.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, "string")).alias(c) for c in text.columns])


def _quoted(v) -> str:
    return "" if v is None else '"' + str(v).replace('"', '""') + '"'


def read_serving_rows(spark: SparkSession, path: str, n: int = 0, multiline: bool | None = None) -> DataFrame:
    """Raw rows for the serving table: at least ten header columns, blank rows skipped, the first n (0: all)."""
    header, raw = read_numbered(spark, path, multiline=multiline)
    if len(header) < 10:
        raise ValueError("the header has fewer than ten columns")
    names = [c.strip() for c in header]
    rows = raw.toDF(*names, "row_number")
    rows = rows.filter(F.coalesce(*[norm_text(F.col(f"`{c}`")) for c in names]).isNotNull())
    return rows.orderBy("row_number").limit(n) if n else rows
