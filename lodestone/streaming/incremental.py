"""Idempotent incremental append as a stream: each micro-batch keeps first rows and skips known keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import pk_key
from ..operators import keyindex
from ..operators.dedup import keep_first
from ..sources import commits, files


def append_batch(batch: DataFrame, batch_id: int, root: str, keys: list[str], order: list[str], buckets: int = keyindex.BUCKETS) -> int:
    """Append a batch's new rows in a commit under its number; how many they are.

    Known keys come from the table's bucketed index, so that a batch costs what it brings, however many came before.
    A batch that is run again finds its commit and adds nothing.
    """
    spark, own = batch.sparkSession, f"batch-{batch_id:010d}"
    if commits.exists(spark, root) and any(s["snapshot"].startswith(own) for s in commits.replay(spark, root).snapshots):
        return 0
    complete = batch.dropna(subset=keys).withColumn(keyindex.KEY, pk_key(keys))
    return keyindex.append_new(keep_first(complete, [keyindex.KEY], order), root, keys, files.unique(own), buckets)


def stream_append(spark: SparkSession, source: str, schema: T.StructType, root: str, keys: list[str], order: list[str], checkpoint: str, fmt: str = "parquet", buckets: int = keyindex.BUCKETS) -> StreamingQuery:
    """Load new files of a folder until there are none left."""
    rows = spark.readStream.format(fmt).schema(schema).load(source)
    return rows.writeStream.foreachBatch(lambda df, n: append_batch(df, n, root, keys, order, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of a value by tumbling window and group; rows later than the watermark are left out of streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), group, "n", "total")
