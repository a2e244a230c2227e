"""The subpackage's queries, against their SQL where they have one."""

import os
import time

import pytest
from compare import connect, differences

from sextant.llm.queries import ORACLE, QUERIES

os.environ["TZ"] = "UTC"
time.tzset()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert differences(df, ORACLE[name], connect(data)) == ""
    else:
        assert df.count() > 0


@pytest.mark.parametrize(("name", "columns"), [("p3_found", ["query_id", "node_id"]), ("p4_found", ["node_a", "node_b"]), ("p6_found", ["node_id"]), ("p7_found", ["node_id", "term"]), ("p8_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id", "reading_level"])])
def test_columns(spark, data, name, columns):
    assert QUERIES[name](spark, data).columns == columns
