"""Registered queries against their SQL, on the smallest data folder."""

import os
import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "median_length" in df.columns


def test_every_section_is_registered():
    ids = {found.group() for name in entry.queries() if (found := re.match(r"[a-g]\d\d", name))}
    ids.add("e18")  # shares a query with e17
    expected = {f"{s}{i:02d}" for s, n in dict(a=18, b=26, c=18, d=13, e=22, f=15, g=13).items() for i in range(1, n + 1)}
    # e09 and e21 are plain Python values without rows of their own.
    assert expected - ids == {"e09", "e21"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


# Queries that fit models with full settings take minutes; test_models covers what they call.
FITTING = re.compile(r"e(10|11|12|13|14|15|16|17|19|20|22)_|g0(1|2|3|4|5|7|9)_")


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not FITTING.match(n)))
def test_query_equals_sql(spark, con, name):
    from tools.compare import compare

    status, *_ = compare(spark, con, name, FOLDER)
    assert status == "ok", status
