"""Every registered query with SQL gives the SQL's rows; the rest run. Those of optional subpackages are tested there."""

import pytest

from tests.compare import connected, differences
from tidewater.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert differences(frame, con, ORACLE_SQL[name]) == []
    else:
        assert frame.count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_no_python_in_plans(spark):
    for name in ("a6_storage_by_format", "a10_dashboard", "t10_clean_chain", "h2_dedup_exact", "m1_upsert_catalog", "d6_typed_tables"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
