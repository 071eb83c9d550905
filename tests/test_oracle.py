"""Every registered query against its DuckDB oracle on the same tables:
same columns, same row count, same multiset of rows (doubles exact)."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL
from waterbook import catalog

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _key(v):
    return (v is None, repr(v))


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(_key(x) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_oracle_sql():
    assert set(catalog.QUERIES) <= set(E.oracle_sql())
    assert set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_CHECK)
    cols = df.columns
    got = _rows([tuple(r) for r in df.collect()], cols)
    tbl = duck.sql(E.oracle_sql()[name]).to_arrow_table()
    dcols = tbl.column_names
    want = _rows([tuple(r.values()) for r in tbl.to_pylist()], dcols)
    assert sorted(cols) == sorted(dcols)
    spark_types = {f.name: str(f.type) for f in to_arrow_schema(df.schema)}
    duck_types = {f.name: str(f.type) for f in tbl.schema}
    assert spark_types == duck_types
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns
    assert {"section", "label", "base", "cmp", "diff", "growth_pct", "is_total"} <= set(df.columns)


def test_small_scale_runs(spark):
    # every query also runs on the smallest tables
    for fn in catalog.QUERIES.values():
        fn(spark, SF_SMALL).write.format("noop").mode("overwrite").save()
