"""Each registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone import queries as Q
from lodestone.operators.dedup import append_unique

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    if name not in Q.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_whole_table_comes_in(spark, monkeypatch):
    """Every order is in the incoming batch, and is either known or appended."""
    seen = []
    monkeypatch.setattr(Q, "append_unique", lambda new, known: seen.append((new, known)) or append_unique(new, known))
    added = Q.append_unique_orders(spark, DATA)
    keys = lambda df: {r["o_orderkey"] for r in df.select("o_orderkey").collect()}
    (new, known), every = seen[0], keys(spark.read.parquet(f"{DATA}/orders.parquet"))
    assert keys(new) == every and keys(known) | keys(added) == every and not keys(known) & keys(added)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries()) and set(Q.QUERIES) <= set(E.queries())
