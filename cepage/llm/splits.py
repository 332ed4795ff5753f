"""Splits that keep related records together, kept up over time.

Records that share any of the given keys (author, source, group, ...) form a component. A persisted table holds
the component and split of every key seen; new links between components are merged by hooking the larger name on
the smaller and pointer jumping. A component is

* kept, if it has one earlier split: it stays there;
* new, if it has none, or torn, if its records were given several before any table knew it: it fills, as a whole,
  the deficits of the proportions;
* quarantined, if components of several splits in the table were merged: it is set aside without a split, its keys
  keep theirs in the table, and so it stays until ``release`` says where it goes.

Deficits are filled by class. The largest components (``greedy``, a bounded number) are placed one by one where
they overfill least; all others are laid out by hash within their most frequent class, by prefix sums over hash
buckets, and cut where the class's remaining deficits end, so the work is spread and no list of components or
records is gathered anywhere. A component of a third of all records is one row here, and what is looked up by its
name is sent to all tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.operators.components import merged_names
from cepage.operators.joins import skewed_lookup
from cepage.operators.splitting import deficits, lay_out
from cepage.session import cut

PROPORTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def merge_components(ledger: DataFrame | None, links: DataFrame, in_one_task: int = 500_000, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of all nodes of ``ledger`` (node, component), ``links`` (a, b) and ``nodes`` after merging the links.

    A node that the ledger lacks begins as a component of its own name.
    """
    if nodes is None:
        nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    between = links.where("a <> b")
    if ledger is not None:
        for end in ("a", "b"):
            known = ledger.select(F.col("node").alias(end), F.col("component").alias("__c"))
            between = between.join(known, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
        nodes = nodes.join(ledger, "node", "left_anti")
    state = nodes.select("node", F.col("node").alias("component"))
    if ledger is not None:
        state = ledger.select("node", "component").unionByName(state)
    moved = merged_names(between.select("a", "b"), in_one_task).select(F.col("node").alias("component"), "root")
    return state.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def component_records(records: DataFrame, record: str, keys: list[str], class_name: str, split: str, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with component, keys with component): columns id, component, class_name, split; node, component.

    A record with no key is a component by itself. Null and repeated record ids are passed over.
    """
    named = F.filter(F.array(*(F.concat(F.lit(f"{k}:"), F.col(f"`{k}`").cast("string")) for k in keys)), lambda x: x.isNotNull())
    rows = records.where(F.col(f"`{record}`").isNotNull()).select(
        F.col(f"`{record}`").alias("id"), named.alias("nodes"), F.coalesce(F.col(f"`{class_name}`"), F.lit("")).alias("class_name"), F.col(f"`{split}`").alias("split")
    )
    rows = rows.withColumn("nodes", F.when(F.size("nodes") > 0, F.col("nodes")).otherwise(F.array(F.concat(F.lit("record:"), F.col("id").cast("string")))))
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("nodes", "class_name")).alias("x"), F.min("split").alias("split")).select("id", "x.*", "split"))
    first = F.element_at("nodes", 1)
    links = rows.where(F.size("nodes") > 1).select(first.alias("a"), F.explode(F.slice("nodes", 2, len(keys))).alias("b")).distinct()
    seen = rows.select(F.explode("nodes").alias("node")).distinct()
    nodes = cut(merge_components(ledger if ledger is None else ledger.select("node", "component"), links, nodes=seen))
    counted = cut(rows.groupBy(first.alias("node")).agg(F.count("*").alias("n")).join(nodes, "node"))
    joined = skewed_lookup(rows.withColumn("node", first), counted, "node", "n").select("id", "component", "class_name", "split")
    return joined, nodes


def judge_components(rows: DataFrame, nodes: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """component, its size, its earlier splits and status: kept, new, torn or quarantined."""
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"), F.collect_set("split").alias("own"))
    if ledger is not None:
        earlier = ledger.where("split is not null").select("node", F.col("split").alias("s")).join(nodes, "node")
        sizes = sizes.join(earlier.groupBy("component").agg(F.collect_set("s").alias("old")), "component", "left")
    else:
        sizes = sizes.withColumn("old", F.array().cast("array<string>"))
    # What the table says goes before what the records say.
    old = F.coalesce("old", F.array().cast("array<string>"))
    status = F.when(F.size(old) > 1, "quarantined").when(F.size(old) == 1, "kept").when(F.size("own") > 1, "torn").when(F.size("own") == 1, "kept").otherwise("new")
    return sizes.select("component", "n", F.array_sort(F.when(F.size(old) > 0, old).otherwise(F.col("own"))).alias("earlier"), status.alias("status"))


def _place(groups: dict[str, dict[str, int]], lack: dict[str, np.ndarray]) -> dict[str, int]:
    """Greedy placement, largest first, where squared deficits (by class and in all) fall most; updates ``lack``."""
    placed = {}
    total = sum(lack.values())
    for name, classes in sorted(groups.items(), key=lambda g: (-sum(g[1].values()), g[0])):
        n = sum(classes.values())
        gain = n * n - 2 * n * total
        for c, k in classes.items():
            gain = gain + 2.0 * (k * k - 2 * k * lack[c])
        s = int(np.argmin(gain))
        placed[name] = s
        total[s] -= n
        for c, k in classes.items():
            lack[c][s] -= k
    return placed


def assign_splits(records: DataFrame, record: str, keys: list[str], class_name: str, split: str, ledger: DataFrame | None = None, proportions: dict[str, float] = PROPORTIONS, greedy: int = 5_000, max_classes: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(assignments, ledger): id, component, class_name, split, status; and node, component, split to persist.

    ``split`` holds earlier splits of records (null for none); ``ledger`` is the table a former call returned. Nodes of
    it that no record names any more stay in the new one. Records of quarantined components have a null split.
    Null classes form a class of their own; there may be up to ``max_classes``. An empty table gives two empty tables.
    """
    require_columns(records, (record, *keys, class_name, split))
    spark, names = records.sparkSession, list(proportions)
    rows, nodes = component_records(records, record, keys, class_name, split, ledger)
    rows = cut(rows)
    judged = cut(judge_components(rows, nodes, ledger))
    counts = cut(rows.groupBy("component", "class_name").agg(F.count("*").alias("k")).join(judged, "component"))
    kept = counts.where("status = 'kept'").groupBy("class_name", F.element_at("earlier", 1).alias("s")).agg(F.sum("k").alias("k")).collect()
    free_counts = counts.where("status in ('new', 'torn')")
    free_rows = free_counts.groupBy("class_name").agg(F.sum("k").alias("k")).limit(max_classes + 1).collect()
    free = {r[0]: r[1] for r in free_rows}
    if len(free) > max_classes:
        raise ValueError(f"{len(free)} classes; deficits are kept for at most max_classes = {max_classes}")
    lack = deficits({(r[0], r[1]): r[2] for r in kept}, free, proportions)
    top = judged.where("status in ('new', 'torn')").orderBy(F.desc("n"), "component").limit(greedy).select("component")
    groups: dict[str, dict[str, int]] = {}
    for r in free_counts.join(F.broadcast(top), "component", "left_semi").select("component", "class_name", "k").toLocalIterator():
        groups.setdefault(r[0], {})[r[1]] = r[2]
    placed = _place(groups, lack)
    large = spark.createDataFrame([(g, names[s]) for g, s in placed.items()], "component string, placed string")

    # The others: by hash within their most frequent class, up to where each split's share of the class ends.
    main = free_counts.groupBy("component", "n").agg(F.max_by("class_name", F.struct("k", "class_name")).alias("class_name"))
    small = main.join(F.broadcast(large), "component", "left_anti")
    filled = lay_out(small, lack, proportions).unionByName(large)
    chosen = F.when(F.col("status") == "kept", F.element_at("earlier", 1)).otherwise(F.col("placed"))
    decided = cut(judged.join(filled, "component", "left").select("component", "n", "status", chosen.alias("split")))
    assigned = skewed_lookup(rows.drop("split"), decided, "component", "n").select("id", "component", "class_name", "split", "status")
    named = nodes.join(decided.select("component", "split"), "component", "left")
    if ledger is not None:
        named = named.join(ledger.select("node", F.col("split").alias("__old")), "node", "left").withColumn("split", F.coalesce("split", "__old"))
    return assigned, named.select("node", "component", "split")


def release(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ledger with quarantined components put where ``decisions`` (component, split) says; others stay as they are."""
    require_columns(decisions, ("component", "split"))
    said = decisions.groupBy("component").agg(F.min("split").alias("__said"))
    return ledger.join(said, "component", "left").select("node", "component", F.coalesce("__said", "split").alias("split"))


def torn_components(records: DataFrame, record: str, keys: list[str], class_name: str, split: str, ledger: DataFrame | None = None) -> DataFrame:
    """Components whose records, or merged parts, have several earlier splits (component, n, earlier)."""
    rows, nodes = component_records(records, record, keys, class_name, split, ledger)
    return judge_components(rows, nodes, ledger).where("status in ('torn', 'quarantined')").drop("status")
