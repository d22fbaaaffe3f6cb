"""The driver contract, and plan rules every registered query must keep."""

import __spark_entry__ as contract
from erario.plans import catalog

FOLDER = "/root/testdata/sf0.001"
MAY_USE_PYTHON = ("v4_embed_plugged_encoder", "v12_")


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0
    assert {"partido", "source_url"} <= set(rows.columns)


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_plans(spark):
    for name, fn in catalog.QUERIES.items():
        plan = fn(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        if not name.startswith(MAY_USE_PYTHON):
            assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
