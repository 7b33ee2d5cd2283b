"""Transactions made of the TPC-H-like tables, in Spark and in SQL, on which the views are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import with_geohash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer and nation, one row for each line."""
    line, orders, customer, nation = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    surface, value = F.col("l_quantity").cast("int"), F.col("l_extendedprice").cast("double")
    lon = (F.lit(-5.5) + ((F.col("c_custkey") * 7919) % 1540) / F.lit(100.0)).cast("double")
    lat = (F.lit(41.0) + ((F.col("c_custkey") * 104729) % 1050) / F.lit(100.0)).cast("double")
    day = F.col("l_shipdate").cast("date")
    kind = F.when(F.col("l_returnflag") == "A", "APPARTEMENT").when(F.col("l_returnflag") == "R", "MAISON").otherwise("DEPENDANCE")
    return with_geohash(rows.select(
        F.col("l_orderkey").cast("string").alias("id_mutation"), F.col("l_linenumber").cast("string").alias("numero_disposition"), F.upper("l_linestatus").alias("nature_mutation"),
        day.alias("date_mutation"), value.alias("valeur_fonciere"), surface.alias("surface_reelle_bati"), F.col("l_linenumber").cast("int").alias("nombre_pieces_principales"),
        F.col("l_returnflag").alias("code_type_local"), kind.alias("type_local"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("code_postal"), F.col("n_name").alias("code_commune"),
        F.upper("c_mktsegment").alias("nom_commune"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("code_departement"),
        lon.alias("longitude"), lat.alias("latitude"), F.when(surface > 9, value / surface).alias("prix_m2"),
        F.year(day).cast("short").alias("year"), F.year(day).cast("short").alias("year_mutation"), F.trunc(day, "month").alias("month_start"),
        "l_partkey", "l_suppkey", "l_discount", "l_tax",
    ), "longitude", "latitude")


def geohash_sql(lon: str, lat: str) -> str:
    """The geohash of two SQL expressions as bit arithmetic."""
    x, y = f"CAST(floor(({lon} + 180.0) / 360.0 * 32768.0) AS BIGINT)", f"CAST(floor(({lat} + 90.0) / 180.0 * 32768.0) AS BIGINT)"
    out = []
    for k in range(6):
        bits = []
        for i in range(5):
            b = 5 * k + i
            source, left = (x, 14 - b // 2) if b % 2 == 0 else (y, 14 - b // 2)
            bits.append(f"((({source} >> {left}) & 1) << {4 - i})")
        out.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} AS INTEGER) + 1, 1)")
    return " || ".join(out)


TX_SQL = f"""
tx0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation, CAST(l_linenumber AS VARCHAR) AS numero_disposition, upper(l_linestatus) AS nature_mutation,
    CAST(l_shipdate AS DATE) AS date_mutation, CAST(l_extendedprice AS DOUBLE) AS valeur_fonciere, CAST(l_quantity AS INTEGER) AS surface_reelle_bati,
    CAST(l_linenumber AS INTEGER) AS nombre_pieces_principales, l_returnflag AS code_type_local,
    CASE l_returnflag WHEN 'A' THEN 'APPARTEMENT' WHEN 'R' THEN 'MAISON' ELSE 'DEPENDANCE' END AS type_local,
    lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS code_postal, n_name AS code_commune, upper(c_mktsegment) AS nom_commune,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code_departement,
    -5.5 :: DOUBLE + ((c_custkey * 7919) % 1540) / 100.0 :: DOUBLE AS longitude, 41.0 :: DOUBLE + ((c_custkey * 104729) % 1050) / 100.0 :: DOUBLE AS latitude,
    l_partkey, l_suppkey, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), tx AS (
  SELECT *, {geohash_sql("longitude", "latitude")} AS geohash6, CASE WHEN surface_reelle_bati > 9 THEN valeur_fonciere / surface_reelle_bati END AS prix_m2,
    CAST(year(date_mutation) AS SMALLINT) AS year, CAST(year(date_mutation) AS SMALLINT) AS year_mutation, CAST(date_trunc('month', date_mutation) AS DATE) AS month_start
  FROM tx0
)"""
