"""Plan checks over every query of the library's own catalog: no Python evaluation, no
cartesian products, no windows without a partition; the contract functions are
consistent."""
import pytest

import __spark_entry__ as E
from helpers import SF_SMALL
from edcohort.plans.catalog import REGISTRY

NAMES = sorted(REGISTRY)


def test_contract_keys():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert set(REGISTRY) <= set(sql)
    assert len(REGISTRY) >= 90


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 882 and "age_group" in df.columns


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    logical = df._jdf.queryExecution().optimizedPlan()
    assert not [n for n in nodes(logical) if n.nodeName() == "Window" and n.partitionSpec().isEmpty()]


def test_window_check_sees_one(spark):
    plan = spark.range(9).selectExpr("row_number() OVER (ORDER BY id) AS r")._jdf.queryExecution().optimizedPlan()
    assert [n for n in nodes(plan) if n.nodeName() == "Window" and n.partitionSpec().isEmpty()]
