"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from fieldstone.plans import queries as plans
from fieldstone.plans import session_queries  # noqa: F401 (registers its queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(frame, columns):
    def cell(v):
        if pd.isna(v):
            return ""
        return f"{v:.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


def same(spark, duck, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, plans.QUERIES[name], plans.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
