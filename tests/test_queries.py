"""Every registered query against its oracle, on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from tabwarden.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, SF, name)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["col_idx", "col_name", "reason_code", "reason", "is_candidate"] and df.count() == 18


def test_oracle_covers_all_queries_of_the_engine():
    from tabwarden.workload.oracle import ORACLE

    assert set(QUERIES) == set(ORACLE)
