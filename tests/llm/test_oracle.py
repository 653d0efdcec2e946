"""The operators that SQL can express, against DuckDB on the driver's tables."""

import pytest
from check_oracle import compare, connect

from tabwarden.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, name):
    verdict = compare(spark, connect(SF), SF, name)
    assert verdict.startswith("ok"), verdict
