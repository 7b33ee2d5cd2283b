"""Loads over JDBC into the Derby database that Spark brings."""

import uuid

import pytest

from lodestone.plans import jdbc


@pytest.fixture()
def url(spark, tmp_path):
    spark.sparkContext._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def content(spark, url, table="dvfs"):
    return sorted(tuple(r) for r in spark.read.format("jdbc").options(url=url, dbtable=table).load().collect())


def rows(spark, data):
    return spark.createDataFrame(data, "id long, price double").repartition(3)


def test_a_load_comes_in_once(spark, url):
    first = [(1, 1.5), (2, None), (2, None), (3, 3.0)]
    assert jdbc.load_once(rows(spark, first), url, "dvfs", "monday") == 4
    assert jdbc.load_once(rows(spark, first), url, "dvfs", "monday") is None
    assert jdbc.load_once(rows(spark, [(9, 9.0)]), url, "dvfs", "tuesday") == 1
    assert jdbc.load_once(rows(spark, []), url, "dvfs", "empty") == 0
    assert sorted(content(spark, url), key=repr) == sorted([*first, (9, 9.0)], key=repr)
    assert content(spark, url, "dvfs_loads") == [("empty", 0), ("monday", 4), ("tuesday", 1)] and content(spark, url, "dvfs_staging") == []


def test_a_task_that_is_run_again_leaves_no_row_twice(spark, url, monkeypatch):
    """Partitions whose transaction was committed before the task was lost are in the staging table twice."""
    real = jdbc._stage

    def again(staged, url_, table, batch, options):
        real(staged, url_, table, batch, options)
        real(staged.filter("id % 2 = 0"), url_, table, batch, options)

    monkeypatch.setattr(jdbc, "_stage", again)
    data = [(i, float(i)) for i in range(50)]
    assert jdbc.load_once(rows(spark, data), url, "dvfs", "x") == 50
    assert content(spark, url) == data


def test_a_run_that_fails_changes_nothing(spark, url, monkeypatch):
    data = [(i, float(i)) for i in range(20)]
    real = jdbc._stage
    monkeypatch.setattr(jdbc, "_stage", lambda staged, *a: real(staged.filter("id < 7"), *a))
    with pytest.raises(jdbc.LoadError):
        jdbc.load_once(rows(spark, data), url, "dvfs", "x")
    assert content(spark, url) == [] and content(spark, url, "dvfs_loads") == []
    monkeypatch.setattr(jdbc, "_stage", real)
    assert jdbc.load_once(rows(spark, data), url, "dvfs", "x") == 20
    assert content(spark, url) == data


def test_two_runs_of_one_load(spark, url, monkeypatch):
    """Another run commits the load between this one's staging and its own commit."""
    data, real, done = [(1, 1.0), (2, 2.0)], jdbc._stage, []

    def late(*a):
        real(*a)
        if not done:
            done.append(1)
            assert jdbc.load_once(rows(spark, data), url, "dvfs", "x") == 2

    monkeypatch.setattr(jdbc, "_stage", late)
    assert jdbc.load_once(rows(spark, data), url, "dvfs", "x") is None
    assert content(spark, url) == data
