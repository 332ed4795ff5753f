import random

import numpy as np
import pytest

from cepage.llm import components as C


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def run(spark, edges, **options):
    rows = [(a, b, "x", 1) for a, b in edges]
    df = spark.createDataFrame(rows, "a string, b string, node string, component int").repartition(5)
    found = C.group_links(df, **options).collect()
    assert len(found) == len({r["node"] for r in found})
    return {r["node"]: r["component"] for r in found}


def test_spanning_forest_links_each_node_to_the_smallest():
    child, root = C.spanning_forest(np.array([5, 3, 9, 3]), np.array([3, 1, 8, 3]))
    assert dict(zip(child.tolist(), root.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}


@pytest.mark.parametrize("limit", [10, 60, 10_000])
def test_chains_stars_and_random_links_in_bounded_partitions(spark, limit):
    random.seed(limit)
    name = lambda k: f"n{k:04d}"
    chain = [(name(k + 1), name(k)) for k in range(120)]
    star = [(name(1999), name(k)) for k in range(1000, 1060)]
    some = [(name(random.randrange(2000, 2100)), name(random.randrange(2000, 2100))) for _ in range(60)]
    edges = chain + star + some + [(b, a) for a, b in some] + chain[:10]
    random.shuffle(edges)
    assert run(spark, edges, limit=limit, fan_in=2) == brute(edges)
    assert run(spark, edges, limit=limit, fan_in=2, hot_rows=9) == brute(edges)


def test_nulls_loops_repeats_and_empty(spark):
    edges = [(None, "a"), ("a", None), ("z", "z"), ("b", "a"), ("a", "b"), ("b", "a")]
    assert run(spark, edges) == {"a": "a", "b": "a"}
    empty = spark.createDataFrame([], "a string, b string")
    assert C.group_links(empty).collect() == []


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="b"):
        C.group_links(spark.createDataFrame([("x",)], "a string"))


def test_pieces_of_a_single_partition_are_merged(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        chain = [(k, k + 1) for k in range(12)]
        links = spark.createDataFrame(chain + chain[:8] + [(12, 100), (100, 101)], "u bigint, v bigint").coalesce(1)
        found = C.merge_forests(links, limit=20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, found)) == [(k, 0) for k in [*range(1, 13), 100, 101]]
