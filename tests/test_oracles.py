"""Every registered query that SQL can express equals its SQL twin, value by value."""

import pytest

import __spark_entry__ as entry
import oracle

SQL = entry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) or name == "unmapped_names"  # every name is known there; club_unmapped has some that are not
    assert oracle.compare(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", ["peek_features", "name_candidates", "training_export", "parameter_sweep", "fixture_predictions"])
def test_query_without_sql_runs(spark, sf, name):
    assert not entry.queries()[name](spark, sf).isEmpty()


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 64 and df.limit(1).count() == 1
