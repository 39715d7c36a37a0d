import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["request_id", "layer", "level", "action", "score", "flags"] and df.count() > 0
