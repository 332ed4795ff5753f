import re

import pytest

from cepage.plans import analytics, curation, evaluation

#: Queries whose definition is a grid or compares with one row of bounds; one side is a bounded literal or aggregate.
GRIDS = {"j13_run_grid", "w12_min_max_scores", "f20_binomial_tail", "j03_match_indicator"}
QUERIES = {k: f for m in (analytics, curation, evaluation) for k, f in m.QUERIES.items()}


def plan_of(spark, name, data):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, data, name):
    plan = plan_of(spark, name, data)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in GRIDS


@pytest.mark.parametrize(("name", "columns"), [("a01_class_counts", 1), ("a11_confusion", 7), ("a17_ece", 7), ("a08_seed_summary", 6), ("u01_union_all", 1), ("w08_trapezoid_area", 4), ("p04_partition_filter", 3)])
def test_scans_read_what_is_needed(spark, data, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, name, data))
    assert read and all(len(r.split(",")) <= columns for r in read)


def test_filters_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey")
    assert "GreaterThan(l_quantity,49.0)" in df._jdf.queryExecution().executedPlan().toString()
