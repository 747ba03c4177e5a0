"""Every query beside its SQL, on the smallest tables, and what its plan must not hold."""

import re

import pytest
from check_oracles import compare, open_tables

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SMALL
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return open_tables(SMALL)


#: Fits and matrix products run on Arrow batches inside tasks; all else is built-in expressions.
IN_PYTHON = ("forecast", "forecast_fit", "forecast_request", "forecast_segments", "correlation_matrix")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    python_nodes = re.findall(r"FlatMap\w+InPandas|ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow", plan)
    assert bool(python_nodes) == (name in IN_PYTHON)
    assert compare(name, spark, con, SMALL, df) == ""


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[-1] == "gdp_ppp_per_capita"
    assert df.count() > 0
