"""Keyed state in streams: first rows, restarts, forgetting."""

from pyspark.sql import functions as F

from lodestone.streaming.keyed import first_of_keys

SCHEMA = "k long, g string, o long, v long, t timestamp"


def feed(spark, folder, rows, **options):
    """Put rows into the source and run the stream until they are read; what its sink then holds."""
    df = spark.createDataFrame(rows, "k long, g string, o long, v long, t string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    made = first_of_keys(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), ["k", "g"], ["o"], "t", **options)
    made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted((r["k"], r["g"], r["o"], r["v"]) for r in spark.read.schema(SCHEMA).parquet(f"{folder}/out").collect())


def test_first_rows_over_restarts(spark, tmp_path):
    big = (1 << 60) + 1
    first = feed(spark, tmp_path, [(1, "a", 10, 1, "2024-01-01"), (1, "a", 9, big, "2024-01-01"), (big, "a", 5, None, "2024-01-01"), (None, "a", 1, 1, "2024-01-01"), (1, None, 1, 1, "2024-01-01"), (2, "a", 1, 1, None)])
    assert first == [(1, "a", 9, big), (big, "a", 5, None)]
    assert feed(spark, tmp_path, [(1, "a", 1, 7, "2024-01-01"), (1, "b", 3, 8, "2024-01-02"), (1, "b", 3, 8, "2024-01-02")]) == sorted([*first, (1, "b", 3, 8)])


def test_keys_are_forgotten(spark, tmp_path):
    options = {"ttl_seconds": 3600, "late": "0 seconds"}
    assert feed(spark, tmp_path, [(1, "a", 1, 1, "2024-01-01 00:00:00")], **options) == [(1, "a", 1, 1)]
    assert feed(spark, tmp_path, [(1, "a", 2, 2, "2024-01-01 00:30:00"), (2, "a", 2, 2, "2024-01-01 05:00:00")], **options) == [(1, "a", 1, 1), (2, "a", 2, 2)]
    # The first key's time is over; a row behind the watermark is late.
    got = feed(spark, tmp_path, [(1, "a", 3, 3, "2024-01-01 05:10:00"), (3, "a", 3, 3, "2024-01-01 01:00:00")], **options)
    assert got == [(1, "a", 1, 1), (1, "a", 3, 3), (2, "a", 2, 2)]
