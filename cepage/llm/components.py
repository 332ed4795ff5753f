"""Consolidating pairwise matches into groups by hierarchical merging of spanning forests.

Union-find runs inside each edge partition and keeps only a spanning forest: every node but a root, linked to its
root. Forests are merged level by level, ``fan_in`` partitions into one, each task bounded by ``limit`` links. As
long as all forests together exceed one task's bound, a contraction comes between: every linked node points at its
smallest neighbour root, nodes are replaced by what they point at, and the (smaller) graph of what remains is cut
into bounded partitions again. Node keys are 64-bit hashes, so pointers follow a random order and chains stay short
whatever the order of the ids; a collision is found by a check and answered by another seed.

Every contraction and the merged forest are written to the shared folder, so a lost executor costs one of them at
most. No task and no driver ever holds more than ``limit`` links; a component may be of any size: links are cut
into partitions by both ends, so those of a hub are spread, and whatever is looked up by root (a pointer, a group's
smallest id) is sent to all tasks for the few roots of more than ``hot_rows`` nodes, and joined for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.operators.joins import skewed_lookup
from cepage.session import cut

FOREST = "child bigint, root bigint"


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) links of the components of the edges u-v; the root is a component's smallest key.

    Union-find on arrays: roots of both ends are looked up, the larger hooks on the smaller, paths are compressed.
    """
    keys, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(keys))
    while True:
        ra, rb = parent[a], parent[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (jumped := parent[parent]).tobytes() != parent.tobytes():
            parent = jumped
    child = np.flatnonzero(parent != np.arange(len(keys)))
    return keys[child], keys[parent[child]]


def _forests(limit: int):
    """A mapInPandas function: links of a partition to its spanning forest, never holding much over ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v, held = [], [], 0
        for batch in batches:
            u.append(batch.iloc[:, 0].to_numpy())
            v.append(batch.iloc[:, 1].to_numpy())
            held += len(batch)
            if held >= limit:
                child, root = spanning_forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [child], [root], len(child)
                if held > limit // 2:
                    yield pd.DataFrame({"child": child, "root": root})
                    u, v, held = [], [], 0
        if held:
            child, root = spanning_forest(np.concatenate(u), np.concatenate(v))
            yield pd.DataFrame({"child": child, "root": root})

    return run


def _end_of(rows: DataFrame, key: str, table: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` with ``key`` replaced by what ``table`` (key, end) has for it, if anything; keys of many rows are no hot spots."""
    counted = rows.groupBy(key).agg(F.count("*").alias("__n"))
    ends = cut(counted.join(table, key, "left").select(key, F.coalesce("end", key).alias("__end"), "__n"))
    found = skewed_lookup(rows, ends, key, "__n", hot_rows)
    return found.withColumn(key, F.col("__end")).select(*rows.columns)


def merge_forests(links: DataFrame, limit: int = 2_000_000, fan_in: int = 8, hot_rows: int = 1_000_000) -> DataFrame:
    """(child, root) of every node that is not its component's root, for links (two bigint columns)."""
    run = _forests(limit)
    forest = cut(links.mapInPandas(run, FOREST))
    pointers: list[DataFrame] = []
    while (held := forest.count()) > limit:
        to = cut(forest.groupBy("child").agg(F.min("root").alias("parent")))
        pointers.append(to)
        moved = forest.join(to, "child").select(F.col("parent").alias("child"), "root")
        moved = _end_of(moved, "root", to.select(F.col("child").alias("root"), F.col("parent").alias("end")), hot_rows)
        moved = moved.where("child <> root").repartition(max(2, math.ceil(held / limit)), "child", "root")
        forest = cut(moved.mapInPandas(run, FOREST))
    # A partition may have flushed several pieces, so even a single one is merged once more.
    parts, merged = forest.rdd.getNumPartitions(), False
    while not merged:
        parts = max(1, math.ceil(parts / fan_in))
        merged = parts == 1
        forest = forest.repartition(parts, "child" if parts > 1 else F.lit(0)).mapInPandas(run, FOREST)
    forest = cut(forest)
    for to in reversed(pointers):
        ends = forest.select(F.col("child").alias("parent"), F.col("root").alias("end"))
        below = _end_of(to, "parent", ends, hot_rows).select("child", F.col("parent").alias("root"))
        above = forest.join(to, "child", "left_anti")
        forest = cut(below.unionByName(above).where("child <> root"))
    return forest


def group_links(links: DataFrame, a: str = "a", b: str = "b", limit: int = 2_000_000, fan_in: int = 8, hot_rows: int = 1_000_000) -> DataFrame:
    """One row per linked record: node, and as component the smallest node of all that it is linked to.

    Links with a null end or two equal ends are passed over, repeated and turned links change nothing, further
    columns are ignored, and an empty table gives no rows.
    """
    require_columns(links, (a, b))
    ends = links.select(F.col(f"`{a}`").cast("string").alias("__a"), F.col(f"`{b}`").cast("string").alias("__b")).where("__a <> __b")
    ends = cut(ends)
    names = ends.select(F.explode(F.array("__a", "__b")).alias("node"))
    for seed in range(16):
        key = lambda c, seed=seed: F.xxhash64(F.lit(seed), c)
        nodes = cut(names.distinct().withColumn("key", key(F.col("node"))))
        if nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("the hashes of the nodes collide under every seed")
    keyed = ends.select(key(F.col("__a")).alias("u"), key(F.col("__b")).alias("v"))
    forest = merge_forests(keyed, limit, fan_in, hot_rows)
    rooted = cut(nodes.join(forest.select(F.col("child").alias("key"), "root"), "key", "left").select("node", F.coalesce("root", "key").alias("root")))
    first = cut(rooted.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")))
    return skewed_lookup(rooted, first, "root", "n", hot_rows).select("node", "component")
