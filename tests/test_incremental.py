"""The views kept by snapshots against the full ones, after every append."""

import random

from lodestone.operators.orderindex import OrderIndex
from lodestone.operators.quantiles import order_statistics
from lodestone.plans import views
from lodestone.plans.incremental import IncrementalViews
from lodestone.sources import commits
from test_commits import metric

SCHEMA = "year_mutation short, code_departement string, type_local string, month_start date, geohash6 string, prix_m2 double, valeur_fonciere decimal(12,2), surface_reelle_bati int"


def transactions(spark, seed, n):
    import datetime as dt
    from decimal import Decimal

    r = random.Random(seed)
    rows = []
    for _ in range(n):
        year, price = r.choice([2020, 2021]), r.choice([None, 0.0, 1500.0, round(r.lognormvariate(8, 1.2), 2)])
        rows.append((year, r.choice(["01", "75", None]), r.choice(["APPARTEMENT", "MAISON", "LOCAL", None]), dt.date(year, r.randrange(1, 5), 1), r.choice(["u09tvw", "u09tvx", "u0", None]), price, r.choice([None, Decimal(r.randrange(1, 900000))]), r.choice([None, 5, 50])))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_equal_after_every_append(spark, tmp_path):
    kept, every = IncrementalViews(spark, str(tmp_path / "v")), None
    for k in range(5):
        delta = transactions(spark, k, 400 if k < 4 else 3)
        every = delta if every is None else every.unionByName(delta)
        kept.add(delta, f"s{k}")
        kept.add(delta, f"s{k}")  # repeated: nothing changes
        assert rows_of(kept.price_metrics()) == rows_of(views.price_metrics(every))
        assert rows_of(kept.tiles_gh64()) == rows_of(views.tiles_gh64(views.residential_latest(every)))
        if k < 4:
            continue
        assert rows_of(kept.price_metrics_yoy()) == rows_of(views.price_metrics_yoy(every))
        assert rows_of(kept.monthly_price().select("month_start", "code_departement", "type_local", "n", "median_prix_m2_w")) == rows_of(views.monthly_price(every))


def test_reads_hit_zones_only(spark, tmp_path):
    """A quantile of many values in many zones opens the folders of one or two of them."""
    index = OrderIndex(spark, str(tmp_path / "i"), ["g"], ["v"])
    for k in range(3):
        index.add(spark.range(20000).selectExpr("CAST(id % 2 AS string) AS g", f"exp(CAST(id % 4000 AS double) / 300 + {k}) AS v"), f"s{k}")
    zones = index.values([r["z"] for r in index.counts().selectExpr("CAST(floor(_r / 64) AS int) AS z").distinct().collect()])
    assert len(zones.inputFiles()) > 100
    found = index.statistics(["g"], {"m": ("v", 0.5)})
    every = spark.range(20000).selectExpr("CAST(id % 2 AS string) AS g", "explode(array(0, 1, 2)) AS k", "id").selectExpr("g", "exp(CAST(id % 4000 AS double) / 300 + k) AS v")
    assert rows_of(found) == rows_of(order_statistics(every, ["g"], {"m": ("v", 0.5)}))
    found.write.format("noop").mode("overwrite").save()
    assert 0 < max(metric(spark, "number of files read")) <= 12


def test_groups_with_nulls_and_empty_snapshots(spark, tmp_path):
    index = OrderIndex(spark, str(tmp_path / "i"), ["g"], ["v", "w"])
    index.add(spark.createDataFrame([], "g string, v double, w double"), "empty")
    data = [(None, 1.0, None), (None, 3.0, 5.0), ("a", -2.0, 0.0), ("a", float("nan"), 1.0)]
    index.add(spark.createDataFrame(data, "g string, v double, w double"), "s")
    wanted = {"m": ("v", 0.5), "x": ("w", 0.25)}
    got = rows_of(index.statistics(["g"], wanted))
    assert repr(got) == repr(rows_of(order_statistics(spark.createDataFrame(data, "g string, v double, w double"), ["g"], wanted)))
    assert len(commits.replay(spark, index.root).snapshots) == 1
