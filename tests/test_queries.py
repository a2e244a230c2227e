"""Every query against its SQL, over the smallest tables."""

import os
import time

import pytest
from compare import connect, differences

import __spark_entry__ as entry

os.environ["TZ"] = "UTC"
time.tzset()
CORE = [n for n in entry.queries() if not (n[0] == "p" and n.split("_")[0] in ("p3", "p4", "p6", "p7", "p8", "p9", "p10"))]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert differences(df, sql, con) == ""


def test_entry(spark):
    assert entry.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
