"""What the plans of the problems' queries may not have: joins of every row with every row, single-task windows."""

import pytest

from tokensift.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in llm.QUERIES if n.endswith("_found")])
def test_no_product(spark, name):
    plan = llm.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan and "Coalesce 1" not in plan
