import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
