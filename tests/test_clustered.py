"""Layouts of serving tables: same rows as without them, and little is read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_commits import metric

from lodestone.plans import clustered, serving


@pytest.fixture(scope="module")
def served(spark):
    r = random.Random(4)
    rows = [(f"m{i:05d}", str(r.randrange(3)), r.choice(["01", "75", "75", "75", None]), dt.date(2020, 1, 1) + dt.timedelta(r.choice([7, 7, r.randrange(900)])), round(r.uniform(-5, 9), 4), round(r.uniform(41, 51), 4), r.randrange(10**6)) for i in range(20000)]
    rows += [("null", "0", "75", None, None, None, 1), *rows[:3]]
    return spark.createDataFrame(rows, "id_mutation string, numero_disposition string, code_departement string, date_mutation date, longitude double, latitude double, price long").cache()


def test_pages_equal_the_sorted_ones(spark, served, tmp_path):
    """Also over a hot day, ties, rows without a day, the last page and beyond; a cursor goes on where a page ends."""
    kept = clustered.PagedTable(spark, str(tmp_path / "p"), ("id_mutation", "numero_disposition", "price"))
    kept.write(served, 5, 1500)
    for dep, low, high, pages in (("75", None, None, (1, 2, 150, 240, 999)), ("75", "2020-01-05", "2020-01-20", (1, 100)), ("01", "2021-01-01", None, (1, 3)), ("none", None, None, (1,))):
        plain = serving.filter_rows(served, dep, low, high)
        assert kept.total(dep, low, high) == plain.count()
        for page in pages:
            want = serving.paginate(plain, page, 50, kept.ties).rows.collect()
            assert [tuple(x) for x in kept.page(dep, page, 50, low, high).collect()] == [tuple(x) for x in want]
    first = kept.at("75", 4990, 20).collect()
    then = kept.after((first[-1]["_file"], first[-1]["_row"]), "75", 20).collect()
    assert [r["id_mutation"] for r in first + then] == [r["id_mutation"] for r in kept.at("75", 4990, 40).collect()]
    with pytest.raises(ValueError):
        kept.after((first[0]["_file"], 10**9), "75")


def test_a_late_page_reads_what_the_first_reads(spark, served, tmp_path):
    kept = clustered.PagedTable(spark, str(tmp_path / "p"), ("id_mutation", "numero_disposition", "price"))
    kept.write(served, 5, 1000)
    read = []
    for page in (1, 100, 230):
        kept.page("75", page, 50).write.format("noop").mode("overwrite").save()
        read.append(max(metric(spark, "number of files read")))
    assert max(read) <= 2 and len(kept._rows().inputFiles()) >= 20
    assert "Exchange" not in kept.page("75", 200)._jdf.queryExecution().sparkPlan().toString() and "offset" not in str(kept.page("75", 200)._jdf.queryExecution().optimizedPlan()).lower()


def test_boxes_read_few_rows(spark, served, tmp_path):
    path = str(tmp_path / "z")
    clustered.write_by_place(served, path, 40, 1 << 14)
    laid = spark.read.parquet(path)
    assert laid.count() == served.count() and laid.columns == served.columns
    box = serving.geo_bbox(laid, 1.0, 44.0, 2.0, 45.0)
    want = serving.geo_bbox(served, 1.0, 44.0, 2.0, 45.0)
    assert sorted(map(tuple, box.collect())) == sorted(map(tuple, want.collect()))
    box.write.format("noop").mode("overwrite").save()
    assert max(metric(spark, "number of output rows")) < served.count() / 10


def test_z_order(spark):
    x, y = F.col("x"), F.col("y")
    got = spark.createDataFrame([(0b101, 0b011), (None, 1)], "x long, y long").select(clustered.z_order(x, y, bits=3).alias("z")).collect()
    assert [r["z"] for r in got] == [0b011011, 0b000010]
