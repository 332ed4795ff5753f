"""Connected components by hooking and pointer doubling, and what is said about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions import scalars as S
from cepage.session import Rounds


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest names of a whole small graph."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    links = pd.concat(frames, ignore_index=True)
    names, at = np.unique(np.concatenate([links["a"], links["b"]]).astype(object), return_inverse=True)
    a, b = at[: len(links)], at[len(links) :]
    root = np.arange(len(names))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    yield pd.DataFrame({"node": names[moved], "root": names[root[moved]]})


def merged_names(links: DataFrame, in_one_task: int = 500_000) -> DataFrame:
    """(node, root) of every node of the links (a, b) that is not the smallest of its component.

    Each round hooks every node on its smallest neighbour, follows these pointers to their ends by doubling them,
    and replaces nodes by ends, which leaves a graph of at most half the nodes. Once no more than ``in_one_task``
    edges are left, one task ends the work. Null ends and loops are passed over.
    """
    rounds = Rounds(links.sparkSession, "components")
    edges = rounds.table("edges", links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    moves: list[DataFrame] = []
    while (left := edges.count()) > 0:
        if left <= in_one_task:
            moves.append(rounds.table(f"hooks{len(moves)}", edges.coalesce(1).mapInPandas(_in_one_task, f"node {dict(edges.dtypes)['a']}, root {dict(edges.dtypes)['a']}")))
            break
        key = f"hooks{len(moves)}"
        hooks = rounds.table(key, edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("__above"))
            doubled = hooks.join(up, "root", "left").select("node", F.coalesce("__above", "root").alias("root"), F.col("__above").isNotNull().alias("moved"))
            hooks = rounds.table(key, doubled)
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("node", "root")
        moves.append(hooks)
        for end in ("a", "b"):
            to = hooks.select(F.col("node").alias(end), F.col("root").alias("__end"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("__end", end)).drop("__end")
        edges = rounds.table("edges", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = moves[0]
    for hooks in moves[1:]:
        later = hooks.select(F.col("node").alias("root"), F.col("root").alias("__end"))
        moved = named.join(later, "root", "left").select("node", F.coalesce("__end", "root").alias("root"))
        named = moved.unionByName(hooks)
    return rounds.table("named", named)


def smallest_labels(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b", in_one_task: int = 500_000) -> DataFrame:
    """(node, root) for all nodes, singletons included; the root is the smallest node of the component.

    Edges with an end that is no node are passed over; null nodes name nothing; repeated nodes and edges count once.
    """
    known = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct()
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for end in ("a", "b"):
        links = links.join(known.withColumnRenamed("node", end), end, "left_semi")
    named = merged_names(links, in_one_task)
    return known.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def component_table(labels: DataFrame, attributes: DataFrame, node: str, attribute: str, namespace: str) -> DataFrame:
    """Per component: an identifier from its members, size, and its distinct attribute values in order."""
    joined = labels.join(attributes.select(F.col(node).alias("node"), F.col(attribute).alias("__attribute")), "node", "left")
    sums = joined.groupBy("root").agg(F.collect_set("node").alias("members"), F.array_sort(F.collect_set("__attribute")).alias("classes"))
    return sums.select("root", S.group_id(namespace, F.col("members")).alias("group_id"), F.size("members").alias("size"), F.array_join("classes", "|").alias("classes"))
