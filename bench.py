"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["summary", "price_metrics", "residential_winsor", "monthly_price", "price_yoy", "geohash_tiles", "by_dept", "filter_page", "agg_commune", "topn", "geo_bbox", "dq_summary", "dedup_first", "append_unique_orders", "silver_typed"]


def ingest_rate(spark, work: str) -> tuple[float, int]:
    """CSV to typed, deduplicated, partitioned Parquet: seconds and rows."""
    from pyspark.sql import functions as F

    from lodestone.operators.dedup import keep_first
    from lodestone.sources import tables

    line = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    line.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")).write.mode("overwrite").option("header", True).csv(f"{work}/csv")
    kinds = {f.name: f.dataType.simpleString() for f in line.schema} | {"l_shipdate": "date"}
    began = time.time()
    text = spark.read.option("header", True).csv(f"{work}/csv")
    typed = text.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()]).withColumn("year", F.year("l_shipdate"))
    tables.write_partitioned(keep_first(typed, list(kinds), ["l_orderkey"]), f"{work}/gold", ["year", "l_returnflag"])
    took = time.time() - began
    return took, spark.read.parquet(f"{work}/gold").count()


def layered_rate(spark, work: str) -> tuple[float, int]:
    """Raw text with faults through the engine's own ingest, validate and curate: seconds and rows read."""
    from lodestone import queries as Q
    from lodestone.plans import local
    from lodestone.schemas import RAW_COLUMNS

    if not os.path.isdir(f"{work}/raw"):
        Q._bronze(spark, SF_DIR).select(*RAW_COLUMNS).write.option("header", True).csv(f"{work}/raw")
    shutil.rmtree(f"{work}/layers", ignore_errors=True)
    began = time.time()
    rows = local.ingest(spark, "dvf", f"{work}/raw", "2024-01-01", f"{work}/layers").rows
    local.validate(spark, "dvf", "2024-01-01", f"{work}/layers")
    local.curate(spark, "dvf", "2024-01-01", "2024-02-01", f"{work}/layers")
    return time.time() - began, rows


def main() -> None:
    from lodestone import queries as Q
    from lodestone.session import session

    spark = session("bench", **{"spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles
            began = time.time()
            Q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs), 3)
    work = tempfile.mkdtemp()
    try:
        runs = [ingest_rate(spark, work) for _ in range(3)]
        layered = sorted(layered_rate(spark, work) for _ in range(3))[1]
    finally:
        shutil.rmtree(work, ignore_errors=True)
    seconds, rows = sorted(runs)[1]
    times["ingest_csv_to_gold"] = round(seconds, 3)
    times["ingest_validate_curate"] = round(layered[0], 3)
    print(json.dumps({"metric": "sum of medians over headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "ingest_rows_per_sec": round(rows / seconds), "layered_rows_per_sec": round(layered[1] / layered[0]), "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
