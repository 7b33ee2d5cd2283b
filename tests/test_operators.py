"""Quantiles, geometry, deduplication, serving rows, streams."""

import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.geo import with_geohash
from lodestone.operators.dedup import keep_first
from lodestone.operators.quantiles import between, group_quantiles, order_statistics
from lodestone.operators.spatial import edges_of, points_in_polygons, polygons, rings_of, with_edges
from lodestone.plans import serving
from lodestone.sources import tables
from lodestone.sources.delimited import read_serving_rows
from lodestone.sources.files import resolve_uri, scratch_path
from lodestone.streaming.incremental import append_batch, stream_append, windowed_counts


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 50).map(float))), max_size=60))
def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}).collect()}
    groups = {k: [v for q, v in rows if q == k and v is not None] for k in {k for k, _ in rows}}
    assert set(got) == {k for k, v in groups.items() if v}
    for k, r in got.items():
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(groups[k], [0.01, 0.5, 0.99]))


def bisect_hash(lon, lat, n=6):
    out, bits, even = "", 0, True
    box, ch = [[-180.0, 180.0], [-90.0, 90.0]], 0
    while len(out) < n:
        side, v = (box[0], lon) if even else (box[1], lat)
        mid = sum(side) / 2
        ch = ch * 2 + (v >= mid)
        side[0 if v >= mid else 1] = mid
        even, bits = not even, bits + 1
        if bits == 5:
            out, bits, ch = out + "0123456789bcdefghjkmnpqrstuvwxyz"[ch], 0, 0
    return out


def test_geohash(spark):
    r = np.random.default_rng(0)
    points = [(2.3522, 48.8566), (-180.0, -90.0), *zip(r.uniform(-180, 180, 200).tolist(), r.uniform(-90, 90, 200).tolist())]
    got = with_geohash(spark.createDataFrame([*points, (None, 1.0)], "x double, y double"), "x", "y").collect()
    assert [g["geohash6"] for g in got] == [*(bisect_hash(*p) for p in points), None]


def test_points_in_polygons(spark):
    areas = polygons(spark, [("sq", "POLYGON((0 0,2 0,2 2,0 2,0 0),(0.5 0.5,1 0.5,1 1,0.5 1,0.5 0.5))"), ("tri", {"type": "Polygon", "coordinates": [[[1, 1], [3, 1], [3, 3]]]})], ["name"])
    pts = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.0, 1.0), (3, 2.0, 2.0), (4, 0.7, 0.7), (5, 2.5, 1.2), (6, 9.0, 9.0), (7, None, 1.0), (8, 1.5, 1.2)], "id int, longitude double, latitude double")
    got = {(r["name"], r["id"]) for r in points_in_polygons(areas, pts).collect()}
    assert got == {("sq", 1), ("sq", 2), ("sq", 3), ("tri", 3), ("tri", 5), ("sq", 8), ("tri", 8)}
    assert len(edges_of("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))")) == 6
    with pytest.raises(ValueError):
        edges_of("POINT(1 2)")


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "c", 3), (None, "d", 4), (2, "e", 5)], "k int, v string, o int")
    out = keep_first(df, ["k"], ["o"])
    assert sorted((r["v"] for r in out.collect())) == ["a", "c", "e"]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_serving(spark, tmp_path):
    names = ["id_mutation", "date_mutation", "numero_disposition", "nature_mutation", "valeur_fonciere", "nom_commune", "code_departement", "type_local", "surface_reelle_bati", "longitude", "latitude"]
    rows = [
        "a,17-05-2023,1,vente,\"100,5\",saint  denis,75,MAISON,10,2.0,48.0",
        "b,2023/05/17,1,N/A,50,x,2A,local,0,200,48.0",
        "c,2023-05-17,1,v,0,x,75,,1,2,48",
        "d,2023-05-17,1,v,5,x,75,,-1,2,48",
        "e,2023-13-17,1,v,5,x,75,,1,2,48",
        ",,,,,,,,,,",
    ]
    path = tmp_path / "s.csv"
    path.write_text(",".join(names) + "\n" + "\n".join(rows) + "\n")
    raw = read_serving_rows(spark, str(path))
    assert raw.count() == 5 and read_serving_rows(spark, str(path), 2).count() == 2
    good, bad = serving.serving_rows(raw)
    got = {r["id_mutation"]: r for r in good.collect()}
    assert set(got) == {"a", "b"} and bad.count() == 3
    assert got["a"]["nom_commune"] == "SAINT DENIS" and got["a"]["prix_m2"] == 10.05 and got["a"]["type_local"] == "Maison" and got["a"]["year"] == 2023
    assert got["b"]["nature_mutation"] is None and got["b"]["code_departement"] is None and got["b"]["longitude"] is None and got["b"]["prix_m2"] is None
    (tmp_path / "few.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_serving_rows(spark, str(tmp_path / "few.csv"))


def test_pages(spark):
    df = spark.range(120).select(F.col("id").cast("string").alias("id_mutation"), F.lit("1").alias("numero_disposition"), F.lit("2024-01-01").cast("date").alias("date_mutation"))
    first, second = serving.paginate(df, 0, 50), serving.paginate(df, 2, 50)
    a, b = ({r["id_mutation"] for r in p.rows.collect()} for p in (first, second))
    assert len(a) == len(b) == 50 and not a & b and first.total() == 120 and serving.paginate(df, 1, 9999).per_page == 500


def test_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("o", T.LongType())])
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    for rows in ([(1, "a", 2), (1, "b", 1), (None, "n", 1)], [(1, "c", 1), (2, "d", 1)], [(2, "d", 1)]):
        put(rows)
        stream_append(spark, source, schema, root, ["k"], ["o"], str(tmp_path / "cp"), buckets=4).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in tables.scan_snapshots(spark, root).collect()) == [(1, "b"), (2, "d")]


def test_batch_run_again(spark, tmp_path):
    """A batch whose commit was made, but not noted by the stream, adds nothing; nor does one that stopped before it count."""
    root = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k long, o long")
    df([(9, 9)]).write.parquet(f"{root}/data/snapshot=batch-0000000000-lost")
    assert [append_batch(df([(1, 1), (1, 2), (None, 3)]), 0, f"{root}2", ["k"], ["o"], 4) for _ in range(2)] == [1, 0]
    assert append_batch(df([(1, 5), (2, 5)]), 1, f"{root}2", ["k"], ["o"], 4) == 1
    assert sorted(tuple(r) for r in tables.scan_snapshots(spark, f"{root}2").collect()) == [(1, 1), (2, 5)]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "t string, g string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted((r["n"], r["total"]) for r in windowed_counts(df, "t", "g", "v").collect()) == [(1, 4.0), (2, 3.0)]


def test_uri():
    assert resolve_uri("file:///a%20b") == "/a b" and resolve_uri("hdfs://x/y") == "hdfs://x/y" and math.isfinite(1.0)


WKT = ["POLYGON((0 0,2 0,2 2,0 2,0 0),(0.5 0.5,1 0.5,1 1,0.5 1,0.5 0.5))", "MULTIPOLYGON (((1 1, 3 1, 3 3, 1 1)), ((5 5, 6 5, 6 6, 5 5)))", "POINT (1 2)", None]


def wkb(rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def test_edges_of_geom_columns(spark):
    """Text, GeoJSON and WKB geometries hold the same points; other shapes hold none."""
    json_of = lambda w: json.dumps({"type": "MultiPolygon", "coordinates": [[[list(p) for p in r]] for r in rings_of(w)]})
    frames = [
        spark.createDataFrame([(str(i), w) for i, w in enumerate(WKT)], "name string, geom string"),
        spark.createDataFrame([(str(i), json_of(w) if i < 2 else "{}") for i, w in enumerate(WKT)], "name string, geom string"),
        spark.createDataFrame([(str(i), wkb(rings_of(w)) if i < 2 else b"\x01\x01") for i, w in enumerate(WKT)], "name string, geom binary"),
    ]
    pts = spark.createDataFrame([(i, x / 4, y / 4) for i, (x, y) in enumerate((x, y) for x in range(28) for y in range(28))], "id int, longitude double, latitude double")
    areas = polygons(spark, [(str(i), w) for i, w in enumerate(WKT[:2])], ["name"])
    want = {(r["name"], r["id"]) for r in points_in_polygons(areas, pts).collect()}
    assert len(want) > 50
    for df in frames:
        assert {(r["name"], r["id"]) for r in points_in_polygons(with_edges(df).drop("geom"), pts).collect()} == want


def test_refresh_with_departments(spark, tmp_path):
    """The views that need no department survive a file of bad geometries; good ones give by_dept."""
    from lodestone.plans import local, views

    rows = [("m", "1", "V", "2023-01-05", 1000.0 * i, 50, 2, "1", "Maison", "01000", "01001", "x", "01", 2.0, 48.0, "u0", 20.0 * i) for i in range(1, 8)]
    latest = spark.createDataFrame(rows, "id_mutation string, numero_disposition string, nature_mutation string, date_mutation string, valeur_fonciere double, surface_reelle_bati int, nombre_pieces_principales int, code_type_local string, type_local string, code_postal string, code_commune string, nom_commune string, code_departement string, longitude double, latitude double, geohash6 string, prix_m2 double").withColumn("date_mutation", F.col("date_mutation").cast("date"))
    for geom, found in (("POLYGON((0 40,5 40,5 50,0 50,0 40))", 1), ("LINESTRING(0 0,1 1)", 0)):
        made = views.build_all(latest, spark.createDataFrame([("01", "Ain", geom)], "code_departement string, nom_departement string, geom string"))
        assert made["price_metrics"].first()["median_prix_m2"] == 80.0 and made["summary"].count() == 1
        got = made["by_dept"].collect()
        assert len(got) == found and (not found or (got[0]["n"], got[0]["median_prix_m2_w"]) == (49, 80.0))
    latest.write.parquet(str(tmp_path / "gold/dvf/snapshot_date=d/year=2023/dept=01"))
    spark.createDataFrame([("01", "Ain", "POLYGON((0 40,5 40,5 50,0 50,0 40))")], "code_departement string, nom_departement string, geom string").write.parquet(str(tmp_path / "gold/ref/departements.parquet"))
    assert {"dvf_by_dept", "dvf_price_metrics", "ref_departements"} <= set(local.refresh(spark, "dvf", str(tmp_path), "d"))
    assert spark.table("dvf_by_dept").first()["n"] == 49


def test_quantiles_of_several_columns_with_weights(spark):
    rows = [(i % 3, float(i * 7 % 11), float(-i) if i % 5 else None, i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, w long")
    got = {r["k"]: r for r in order_statistics(df, ["k"], {"m": ("a", 0.5), "q": ("b", 0.25)}).select("k", "_n", between("m").alias("m"), between("q").alias("q")).collect()}
    for k in range(3):
        a, b = [x[1] for x in rows if x[0] == k], [x[2] for x in rows if x[0] == k and x[2] is not None]
        assert got[k]["_n"] == len(a) and np.allclose([got[k]["m"], got[k]["q"]], [np.quantile(a, 0.5), np.quantile(b, 0.25)])
    for r in group_quantiles(df, ["k"], "a", {"m": 0.5}, "w").collect():
        assert np.isclose(r["m"], np.quantile([x[1] for x in rows if x[0] == r["k"] for _ in range(x[3])], 0.5))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
