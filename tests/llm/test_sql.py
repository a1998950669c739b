"""Queries of the training-data operators that SQL can express give the SQL's rows."""

import pytest

from tests.compare import connected, differences
from tidewater.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF), connected(SF), ORACLE_SQL[name]) == []
