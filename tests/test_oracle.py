"""Registered queries against their DuckDB SQL on the smallest driver tables."""
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUICK = ["lines_slice", "lines_source", "turns_slice", "url_parts", "url_resolve", "url_valid",
         "manifest", "page_items", "scrape_page", "detect_chapters"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    c = duckdb.connect()
    for t in ["region", "nation", "supplier", "part", "lineitem", "documents", "pages", "conversations"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("\x00" if r[i] is None else str(int(r[i]) if isinstance(r[i], bool) else r[i])
                        for i in order) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), ocols)


def test_every_query_has_sql():
    from quire.plans.queries import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql())
