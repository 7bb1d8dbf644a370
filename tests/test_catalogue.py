"""Every registered query that has SQL gives DuckDB's rows over the smallest tables."""

import os

import duckdb
import pytest

from meshlark.plans import catalogue


@pytest.fixture(scope="module")
def oracle(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalogue.CATALOGUE.items() if sql])
def test_query_matches_sql(spark, sf_dir, oracle, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    found = oracle.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry_and_registry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.queries()["reading_orders"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
