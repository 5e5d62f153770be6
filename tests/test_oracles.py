"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from tessera.sources.tables import TABLES

from conftest import SF_SMALL

from tessera.plans import catalog

E.queries()
QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if v != v else repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "query", "positive_ids", "n_positive_ids", "positive", "n_positive"]


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    exp = con.sql(ORACLE[key]).df()
    assert _rows(got) == _rows(exp)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() > 0
