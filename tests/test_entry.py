"""Every registered query runs on the smallest tables; those with SQL are held against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from textquarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


def test_names_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(registry.queries()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        with duckdb.connect() as db:
            for t in TABLES:
                db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
            want = db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
