"""Plan shape of every registered analytics query: one pass over each large table, no cross joins."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

# the vectors behind K-Means are cached; its plan prints the cached plan more than once
KEYS = sorted(set(E.QUERIES) - {"kmeans_segments", "segmented_client_record"})


@pytest.mark.parametrize("key", KEYS)
def test_plan_shape(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1, "the order lines are read more than once"
    assert plan.count("events.parquet") <= 1, "the visits are read more than once"
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
