"""Text and keys are not shuffled more often than they have to be."""

import pytest

from lodestone import queries
from lodestone.plans import validate
from lodestone.sources import delimited

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def large(spark):
    """Joins as over large tables: nothing is broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered_text_is_not_shuffled(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(500)))
    _, rows = delimited.read_numbered(spark, str(tmp_path / "in.csv"), multiline=False)
    assert "hashpartitioning" not in plan(rows) and "SortMergeJoin" not in plan(rows)
    assert sorted((r["row_number"], r["a"]) for r in rows.collect()) == [(i + 1, str(i)) for i in range(500)]


def test_raw_rows_are_shuffled_once(spark):
    assert plan(queries._bronze(spark, SF)).count("Exchange hashpartitioning") == 2  # a side of the join each


def test_digests_are_made_after_the_shuffle(spark):
    made = plan(validate.validate(queries._bronze(spark, SF)).silver)
    assert "hashpartitioning(_key" in made and "hashpartitioning(mutation_key" not in made
