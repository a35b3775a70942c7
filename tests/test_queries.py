"""Every registered query of the record model against its SQL on the smallest tables."""

import math

import __spark_entry__ as entry
import pytest
from wayfold.plans import catalog, general, history, live, rebuild, records, reports, traces, writers  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>", "nan"):
            return None
        if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return round(float(x), 6)
        return bool(x) if hasattr(x, "dtype") and x.dtype.kind == "b" else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_says_what_its_sql_says(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE:
        got.collect()
        return
    expect = db.execute(catalog.ORACLE[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(expect.columns)
    order = sorted(got.columns)
    assert plain(got[order].itertuples(index=False)) == plain(expect[order].itertuples(index=False))


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
