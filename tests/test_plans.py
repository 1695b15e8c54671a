"""Plan guards: no query plans a cartesian product or a nested-loop join, Python
runs only where declared, scans are pruned, the flagship hashes its input map-side."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


# queries of the library that run Python on the executors (Arrow batches only); the training-data operators do so freely
PYTHON_OK = {"fuzzy_join_ratio", "unified_training_fuzzy", "knn_regress", "knn_ties", "select_model"}
PYTHON_NODES = re.compile(r"\w*(?:InPandas|InArrow|EvalPython|PythonUDTF|PythonMapInArrow)\w*")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_products_and_python_only_where_declared(spark, name):
    plan = plan_text(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan, name
    assert "BatchEvalPython" not in plan  # never row-at-a-time Python UDFs
    if name not in PYTHON_OK and not re.match(r"op\d+_|pipeline$", name):
        assert not PYTHON_NODES.findall(plan), name


def test_flagship_plan_shape(spark):
    plan = plan_text(E.queries()["corrosion_scores"](spark, SF))
    small, large = plan.split("HashAggregate", 1)
    assert "Scan" not in small and "Sort" not in large.split("Scan")[0].replace("SortMergeJoin", "")  # the input is hashed, not sorted
    assert large.count("Exchange hashpartitioning") == 1  # one shuffle of it, on (clean name, UNS)
    assert "partial_min" in large and "partial_var_pop" in large  # map-side combine
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan  # pruned scan


def test_scans_stay_under_the_size_the_jvm_compiles(spark):
    """Generated methods of over 8000 bytes are interpreted."""
    for name in ("corrosion_scores", "corrosion_row_scores", "assay_measurements", "unified_materials"):
        df = E.queries()[name](spark, SF)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
        assert not sizes or max(sizes) < 8000, (name, sizes)


def test_search_filters_reach_the_scan(spark):
    plan = plan_text(E.queries()["search_range"](spark, SF))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(p_retailprice,920.0)" in plan
