"""Grouped stratified splits by restarts of a randomised greedy placement, and their evaluation.

Restarts are independent: each has a random stream of its own, keyed by seed and restart number, so they run as
tasks in any partitioning and the best is found by one ordered minimum. (One shared stream over all restarts, as a
sequential program would use, cannot be split; results are of the same law but not of the same bits.) The table of
groups is what the optimiser works on; it is sent to the tasks, and ``max_groups`` bounds it. Of larger collections
the largest groups are searched, and the others are laid out by hash to fill what their class lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cepage.session import cut


@dataclass(frozen=True)
class SplitGoal:
    """Proportions, tolerances (percentage points) and weights of the search."""

    names: tuple[str, ...] = ("train", "validation", "test")
    shares: tuple[float, ...] = (0.70, 0.15, 0.15)
    overall_tolerance: float = 0.5
    class_tolerance: float = 2.0
    preferred_tolerance: float = 1.0
    total_weight: float = 1.0
    class_weight: float = 2.0
    violation_weight: float = 1000.0


def cell_sums(assigned: np.ndarray, sizes: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Records and groups by class and split."""
    c = int(classes.max()) + 1
    at = classes * k + assigned
    return np.bincount(at, weights=sizes, minlength=c * k).reshape(c, k), np.bincount(at, minlength=c * k).reshape(c, k)


def deviations(cells: np.ndarray, goal: SplitGoal) -> tuple[np.ndarray, np.ndarray]:
    """Overall and per-class deviations from the shares in percentage points, of records by class and split."""
    shares = np.array(goal.shares)
    overall = np.abs(cells.sum(axis=-2) / cells.sum(axis=(-2, -1))[..., None] - shares) * 100
    return overall, np.abs(cells / cells.sum(axis=-1, keepdims=True) - shares) * 100


def judge(cells: np.ndarray, groups: np.ndarray, goal: SplitGoal) -> tuple[int, int, float]:
    """(violations, exceeded preferences, cost) of records and groups by class and split; smaller is better."""
    overall, by_class = deviations(cells, goal)
    violations = int((overall > goal.overall_tolerance).sum() + (by_class > goal.class_tolerance).sum() + (groups == 0).sum())
    cost = goal.total_weight * overall.sum() + goal.class_weight * by_class.sum() + goal.violation_weight * violations
    return violations, int((by_class > goal.preferred_tolerance).sum()), round(float(cost), 12)


def place(rngs: list[np.random.Generator], kinds: np.ndarray, sizes: np.ndarray, classes: np.ndarray, goal: SplitGoal) -> tuple[np.ndarray, np.ndarray]:
    """Candidates side by side: (kind, split) of the groups in each candidate's order, one row per generator.

    Groups come in random order and go where squared relative gaps (all, and twice its class) end lowest. Groups of
    equal size and class are one kind; ``sizes`` and ``classes`` are of the kinds. Ties are broken by noise far
    below the effect of one record.
    """
    k, c, r, n = len(goal.shares), int(classes.max()) + 1, len(rngs), len(kinds)
    shares = np.array(goal.shares)[:, None]
    per_class = np.bincount(classes[kinds], weights=sizes[kinds], minlength=c)[None, :]
    want_all, want = shares * per_class.sum(), shares * per_class
    scale_all, scale = 2.0 / np.maximum(want_all, 1.0) ** 2, 4.0 / np.maximum(want, 1.0) ** 2
    # Half the changed term of each sum of squares, over the size: what is there, and what the group itself adds.
    there_all, there = np.repeat(-want_all * scale_all, r, axis=1), np.repeat(-want * scale, r, axis=1)
    flat_all, flat = there_all.reshape(-1), there.reshape(-1)
    added = sizes / 2 * (scale_all + scale[:, classes])
    grown_all, grown = sizes[None, :] * scale_all, sizes[None, :] * scale[:, classes]
    flat_grown_all, flat_grown = grown_all.reshape(-1), grown.reshape(-1)
    noise = np.float32(1e-12 * np.abs(want_all * scale_all).max())
    order = np.empty((r, n), kinds.dtype)
    for row, rng in zip(order, rngs, strict=True):
        row[:] = kinds[rng.permutation(n)]
    chosen = np.empty((r, n), np.int8)
    step, at = max(1, 65_536 // r), np.arange(r)
    gain, split = np.empty((k, r)), np.empty(r, np.intp)
    for first in range(0, n, step):
        kind = np.ascontiguousarray(order[:, first : first + step].T).astype(np.intp)
        m = len(kind)
        cell = classes[kind] * r + at
        own = added.take(kind, axis=1)
        ties = np.empty((r, k, m), np.float32)
        for row, rng in zip(ties, rngs, strict=True):
            rng.random(out=row, dtype=np.float32)
        own += ties.transpose(1, 2, 0) * noise
        done = np.empty((m, r), np.int8)
        for j in range(m):
            there.take(cell[j], axis=1, out=gain, mode="clip")
            np.add(gain, there_all, out=gain)
            np.add(gain, own[:, j], out=gain)
            np.less(gain[1], gain[0], out=split, casting="unsafe")
            low = np.minimum(gain[0], gain[1])
            for s in range(2, k):
                split[gain[s] < low] = s
                np.minimum(low, gain[s], out=low)
            done[j] = split
            grow = split * len(sizes) + kind[j]
            flat_all[split * r + at] += flat_grown_all.take(grow)
            flat[split * (c * r) + cell[j]] += flat_grown.take(grow)
        chosen[:, first : first + step] = done.T
    return order, chosen


def deficits(counts: dict[tuple[str, str], int], free: dict[str, int], proportions: dict[str, float]) -> dict[str, np.ndarray]:
    """Per class, the records that each split still lacks, scaled to those that are free."""
    out = {}
    for c, n in free.items():
        kept = np.array([counts.get((c, s), 0) for s in proportions], float)
        lack = np.maximum(np.array(list(proportions.values())) * (kept.sum() + n) - kept, 0)
        out[c] = lack * (n / lack.sum()) if lack.sum() else np.array(list(proportions.values())) * n
    return out


def lay_out(small: DataFrame, lack: dict[str, np.ndarray], proportions: dict[str, float]) -> DataFrame:
    """(component, placed) of components (component, class_name, n): by hash within the class, up to where each split's share of the class ends.

    Sums are taken per class and hash bucket (1,024 a class) in SQL; only the shares of each class are sent to the tasks.
    """
    spark, names = small.sparkSession, list(proportions)
    small = cut(small.withColumns({"h": F.xxhash64("component"), "bucket": F.pmod(F.xxhash64(F.lit(3), "component"), F.lit(1024))}))
    own = Window.partitionBy("class_name")
    sums = small.groupBy("class_name", "bucket").agg(F.sum("n").alias("__n"))
    sums = sums.select("class_name", "bucket", F.coalesce(F.sum("__n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("__n").over(own).alias("__all"))
    shares = []
    for c, free in lack.items():
        share = np.maximum(free, 0)
        share = share / share.sum() if share.sum() else np.array(list(proportions.values()))
        shares.append((c, *(float(x) for x in np.cumsum(share)[:-1])))
    shape = ", ".join(f"share{k} double" for k in range(len(names) - 1))
    limits = spark.createDataFrame(shares, f"class_name string, {shape}")
    within = F.sum("n").over(Window.partitionBy("class_name", "bucket").orderBy("h", "component")) - F.col("n") / 2
    laid = small.withColumn("__within", within).join(sums, ["class_name", "bucket"]).join(F.broadcast(limits), "class_name")
    at = F.col("before") + F.col("__within")
    chosen = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        chosen = F.when(at < F.col(f"share{k}") * F.col("__all"), names[k]).otherwise(chosen)
    return laid.select("component", chosen.alias("placed"))


def optimise_split(groups: DataFrame, restarts: int, seed: int = 1729, goal: SplitGoal | None = None, max_groups: int = 200_000) -> tuple[DataFrame, dict]:
    """(group_id, class_name, size, split) of the best candidate, and a report. groups: group_id, class_name, size.

    Only the ``max_groups`` largest groups are searched; the others fill by hash what their class lacks after that.
    """
    spark, goal = groups.sparkSession, goal or SplitGoal()
    groups = cut(groups.select("group_id", "class_name", "size"))
    table = groups.orderBy(F.desc("size"), "group_id").limit(max_groups).toPandas().sort_values("group_id", ignore_index=True)
    if not len(table):
        raise ValueError("the optimiser takes at least one group")
    sizes = table["size"].to_numpy(float)
    classes, names = pd.factorize(table["class_name"], sort=True)
    k = len(goal.shares)
    pairs, kinds = np.unique(np.stack([classes, sizes]), axis=1, return_inverse=True)
    kinds = kinds.reshape(-1).astype(np.uint16 if pairs.shape[1] <= 65_536 else np.uint32)
    sent = spark.sparkContext.broadcast((kinds, pairs[1], pairs[0].astype(np.intp)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, sizes, classes = sent.value
        most = max(1, min(512, 120_000_000 // len(kinds)))
        best = None
        accepted = 0
        for batch in batches:
            for part in np.array_split(batch["id"].to_numpy(), -(-len(batch) // most)):
                order, chosen = place([np.random.default_rng([seed, int(x)]) for x in part], kinds, sizes, classes, goal)
                for restart, kind, split in zip(part.tolist(), order, chosen, strict=True):
                    many = np.bincount(kind.astype(np.intp) * k + split, minlength=len(sizes) * k).reshape(-1, k)
                    cells, parts = np.zeros((int(classes.max()) + 1, k)), np.zeros((int(classes.max()) + 1, k))
                    np.add.at(cells, classes, many * sizes[:, None])
                    np.add.at(parts, classes, many)
                    key = judge(cells, parts, goal)
                    accepted += key[0] == 0
                    if best is None or key <= best[:3]:
                        assigned = np.empty(len(kinds), np.int8)
                        assigned[np.random.default_rng([seed, restart]).permutation(len(kinds))] = split
                        found = (*key, assigned.tobytes())
                        best = found if best is None else min(best, found)
        if best is not None:
            yield pd.DataFrame([[*best, accepted]], columns=["violations", "exceeded", "cost", "assigned", "accepted"])

    found = spark.range(restarts).mapInPandas(run, "violations int, exceeded int, cost double, assigned binary, accepted bigint")
    best = found.agg(F.min(F.struct("violations", "exceeded", "cost", "assigned")).alias("b"), F.sum("accepted").alias("accepted")).first()
    assigned = np.frombuffer(best["b"]["assigned"], np.int8).astype(np.intp)
    table["split"] = [goal.names[s] for s in assigned]
    split = spark.createDataFrame(table, f"{groups._jdf.schema().toDDL()}, split string")
    cells, parts = cell_sums(assigned, sizes, classes, k)
    by = {(c, s): (cells[i, j], parts[i, j]) for i, c in enumerate(names) for j, s in enumerate(goal.names)}
    searched = len(table)
    if (beyond := groups.count() - searched) > 0:
        rest = groups.join(F.broadcast(split.select("group_id")), "group_id", "left_anti")
        free = {r[0]: r[1] for r in rest.groupBy("class_name").agg(F.sum("size")).collect()}
        shares = dict(zip(goal.names, goal.shares, strict=True))
        lack = deficits({at: x[0] for at, x in by.items()}, free, shares)
        placed = lay_out(rest.select(F.col("group_id").alias("component"), "class_name", F.col("size").alias("n")), lack, shares)
        rest = cut(rest.join(placed.toDF("group_id", "split"), "group_id").select(*split.columns))
        for r in rest.groupBy("class_name", "split").agg(F.sum("size"), F.count("*")).collect():
            x, y = by.get((r[0], r[1]), (0, 0))
            by[r[0], r[1]] = (x + r[2], y + r[3])
        split = split.unionByName(rest)
    names = sorted({c for c, _ in by})
    cells, parts = (np.array([[by.get((c, s), (0, 0))[i] for s in goal.names] for c in names], float) for i in (0, 1))
    violations, exceeded, cost = judge(cells, parts, goal)
    overall, by_class = deviations(cells, goal)
    report = {
        "restarts": restarts, "accepted": best["accepted"], "searched": searched, "laid_out": beyond, "violations": violations, "exceeded": exceeded, "cost": cost,
        "overall_deviation": dict(zip(goal.names, overall.tolist(), strict=True)), "class_deviation": {n: dict(zip(goal.names, d, strict=True)) for n, d in zip(names, by_class.tolist(), strict=True)},
    }
    return split, report


def write_split(groups: DataFrame, path: str, restarts: int, seed: int = 1729, goal: SplitGoal | None = None, **options) -> tuple[DataFrame | None, dict]:
    """(split as written, report): search, check and write a grouped split; where none is feasible only the report is given.

    Feasible is a split without violations in which no group has two splits. An existing ``path`` raises.
    """
    split, report = optimise_split(groups, restarts, seed, goal, **options)
    split = cut(split)
    leaks = split.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    report |= {"torn_groups": leaks, "feasible": report["violations"] == 0 and leaks == 0}
    if not report["feasible"]:
        return None, report
    split.write.mode("errorifexists").parquet(path)
    return split.sparkSession.read.parquet(path), report
