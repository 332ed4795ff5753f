"""Comparisons of systems: crossed paired bootstrap, exact McNemar, Holm adjustment and families of comparisons."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cepage.functions import scalars as S
from cepage.operators.joins import require_unique
from cepage.session import cut


def holm(df: DataFrame, family: list[str], p: str, key: list[str], out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjusted p values per family; ``key`` breaks ties. Null p values get null."""
    given = F.col(p).isNotNull()
    w = Window.partitionBy(*family, given).orderBy(p, *key)
    n = F.count("*").over(Window.partitionBy(*family, given))
    scaled = (n - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("__scaled", scaled).withColumn(out, F.when(given, F.least(F.lit(1.0), F.max("__scaled").over(w)))).drop("__scaled")


def paired(df: DataFrame, system: str, comparisons: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """For each comparison (left, right and any further columns), the outcomes of both systems by key.

    A side that lacks an observation is null, which ``unmatched`` reports; of repeated observations the greatest
    outcome counts; null keys are observations too. Outcomes of all systems are gathered in one row per key, from which
    all comparisons are read, so the table is shuffled once. Comparisons (at most 10,000) are part of the plan.
    """
    asked = [r.asDict() for r in comparisons.limit(10_001).collect()]
    if len(asked) > 10_000:
        raise ValueError("at most 10,000 comparisons")
    names = comparisons.columns
    systems = sorted({c[side] for c in asked for side in ("left", "right")})
    at = {s: f"__s{k}" for k, s in enumerate(systems)}
    wide = df.where(F.col(system).isin(*systems)).groupBy(*keys).agg(*(F.max(F.when(F.col(system) == s, F.col(outcome))).alias(c) for s, c in at.items()))
    types = dict(comparisons.dtypes)
    sides = [F.struct(*(F.lit(c[n]).cast(types[n]).alias(n) for n in names), F.col(at[c["left"]]).alias(f"{outcome}_left"), F.col(at[c["right"]]).alias(f"{outcome}_right")) for c in asked]
    long = wide.select(*keys, F.inline(F.array(*sides)))
    return long.where(F.col(f"{outcome}_left").isNotNull() | F.col(f"{outcome}_right").isNotNull()).select(*names, *keys, f"{outcome}_left", f"{outcome}_right")


def matched(pairs: DataFrame, by: list[str], keys: list[str], outcome: str) -> DataFrame:
    """Pairs that have both sides, after a check that (by, keys) is unique; repeated ones raise."""
    whole = pairs.where(F.col(f"{outcome}_left").isNotNull() & F.col(f"{outcome}_right").isNotNull())
    return require_unique(whole, [*by, *keys], "pairs")


def unmatched(pairs: DataFrame, outcome: str, by: list[str]) -> DataFrame:
    """Observations per comparison that only one system has."""
    lacking = lambda side: F.count_if(F.col(f"{outcome}_{side}").isNull()).alias(f"missing_{side}")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), lacking("left"), lacking("right"))


def mcnemar(pairs: DataFrame, by: list[str], outcome: str = "correct") -> DataFrame:
    """Discordant counts and the exact two-sided p value per comparison; pairs with a null side are left out."""
    left, right = F.col(f"{outcome}_left"), F.col(f"{outcome}_right")
    counts = pairs.groupBy(*by).agg(F.count_if(left & ~right).alias("left_only"), F.count_if(~left & right).alias("right_only"))
    return counts.select(*by, "left_only", "right_only", (F.col("left_only") + F.col("right_only")).alias("discordant"), S.mcnemar_p(F.col("left_only"), F.col("right_only")).alias("p_value"))


def macro_f1_of(counts: np.ndarray) -> np.ndarray:
    """Macro F1 of confusion matrices (..., true, predicted)."""
    hits = np.diagonal(counts, axis1=-2, axis2=-1)
    both = counts.sum(axis=-1) + counts.sum(axis=-2)
    return np.divide(2 * hits, both, out=np.zeros(hits.shape), where=both > 0).mean(axis=-1)


def crossed_bootstrap(pairs: DataFrame, by: list[str], seed_column: str, group_column: str, classes: int, resamples: int = 5000, seed: int = 424242, confidence: float = 0.95, block: int = 250, buckets: int = 16, task_groups: int = 20_000) -> DataFrame:
    """Paired bootstrap over seeds and groups: difference of mean macro F1, interval and p value per comparison.

    pairs: true_class, predicted_class_left and predicted_class_right. Observations are first summed to one count
    per comparison, seed, group, true and predicted class; a resample is then a weighting of groups, shared by
    all its drawn seeds, so a block of resamples is one matrix product. Groups lie in ``buckets`` by hash: a
    resample first draws how many groups each bucket gives, then the groups within it, from streams keyed by block of
    resamples and bucket. So results depend on parameters and data only, never on partitions or on how many tasks share
    the buckets: one task has all of a comparison's buckets up to ``task_groups`` groups, beyond which they are
    spread over several, each with all resamples of its buckets, and their counts are summed. For collections of more
    than ``buckets`` times ``task_groups`` groups, raise ``buckets``.
    """
    cells = pairs.groupBy(*by, F.col(seed_column).cast("string").alias("s"), F.col(group_column).cast("string").alias("g"), F.col("true_class").alias("t"), F.col("predicted_class_left").alias("l"), F.col("predicted_class_right").alias("r")).agg(F.count("*").alias("n"))
    cells = cut(cells.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")))
    # Bounded by comparisons times buckets, and comparisons times seeds.
    counted = cells.select(*by, "bucket", "g").distinct().groupBy(*by, "bucket").agg(F.count("*").alias("k"))
    sizes = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "k"))).alias("sizes"), F.sum("k").alias("groups"))
    names = cells.groupBy(*by).agg(F.array_sort(F.collect_set("s")).alias("names"))
    known = cut(sizes.join(names, by).withColumn("tasks", F.least(F.lit(buckets), F.ceil(F.col("groups") / task_groups)).cast("int")))
    facts = {tuple(str(r[c]) for c in by): (r["sizes"], r["names"], r["tasks"]) for r in known.collect()}
    sent = pairs.sparkSession.sparkContext.broadcast(facts)
    k2 = classes * classes

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sizes, seeds, tasks = sent.value[tuple(str(v) for v in key[:-1])]
        order = sorted(sizes)
        shares = np.array([sizes[b] for b in order], float)
        blocks = -(-resamples // block)
        # Resample -1, the first row, is the data itself: every group and seed once.
        sums = np.zeros((2, resamples + 1, len(seeds) * k2))
        drawn = np.ones((resamples + 1, len(seeds)))
        given = np.empty((resamples, len(order)), np.int64)
        for n in range(blocks):
            at = slice(n * block, min((n + 1) * block, resamples))
            rng = np.random.default_rng([seed, n])
            rows = at.stop - at.start
            drawn[at.start + 1 : at.stop + 1] = rng.multinomial(np.full(rows, len(seeds)), np.full(len(seeds), 1 / len(seeds)))
            given[at] = rng.multinomial(np.full(rows, int(shares.sum())), shares / shares.sum())
        for bucket, part in frame.groupby("bucket"):
            groups, g = np.unique(part.g, return_inverse=True)
            s = part.s.map({v: k for k, v in enumerate(seeds)}).to_numpy()
            tables = np.zeros((2, len(groups), len(seeds) * k2))
            for side, c in enumerate("lr"):
                np.add.at(tables[side], (g, s * k2 + part.t.to_numpy(int) * classes + part[c].to_numpy(int)), part.n.to_numpy(float))
            sums[:, 0] += tables.sum(axis=1)
            for n in range(blocks):
                at = slice(n * block, min((n + 1) * block, resamples))
                many = given[at, order.index(bucket)]
                rows = np.repeat(np.arange(len(many)), many)
                picked = np.random.default_rng([seed, n, int(bucket)]).integers(0, len(groups), len(rows))
                weights = np.bincount(rows * len(groups) + picked, minlength=len(many) * len(groups)).reshape(len(many), -1).astype(float)
                for side in (0, 1):
                    sums[side, at.start + 1 : at.stop + 1] += weights @ tables[side]
        head = dict(zip(by, key[:-1], strict=True))
        number = np.arange(-1, resamples)
        if tasks == 1:
            scores = [macro_f1_of(m.reshape(resamples + 1, len(seeds), classes, classes)) for m in sums]
            return pd.DataFrame({**head, "number": number, "d": ((scores[0] - scores[1]) * drawn).sum(axis=1) / len(seeds), "counts": None, "drawn": None})
        return pd.DataFrame({**head, "number": number, "d": np.nan, "counts": list(np.concatenate(list(sums), axis=1)), "drawn": list(drawn)})

    types = dict(pairs.dtypes)
    shape = ", ".join([*(f"`{c}` {types[c]}" for c in by), "number int, d double, counts array<double>, drawn array<double>"])
    parts = cells.join(F.broadcast(known.select(*by, "tasks")), by).withColumn("task", F.col("bucket") % F.col("tasks")).drop("tasks").groupBy(*by, "task").applyInPandas(run, shape)
    if any(tasks > 1 for _, _, tasks in facts.values()):
        parts = _summed(parts, by, classes)
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    resampled = F.when(F.col("number") >= 0, F.col("d"))
    tail = lambda c: (F.count_if(c) + 1) / (F.count(resampled) + 1)
    p = F.least(F.lit(1.0), 2.0 * F.least(tail(resampled <= 0), tail(resampled >= 0)))
    return parts.groupBy(*by).agg(F.max(F.when(F.col("number") < 0, F.col("d"))).alias("difference"), F.percentile(resampled, F.lit(low)).alias("ci_low"), F.percentile(resampled, F.lit(high)).alias("ci_high"), p.alias("p_value"), F.count(resampled).alias("resamples"))


def _summed(parts: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Differences of mean macro F1 per resample, of comparisons whose counts come from several tasks."""
    split = parts.where("counts is not null")
    sums = split.select(*by, "number", "drawn", F.posexplode("counts").alias("k", "n")).groupBy(*by, "number", "k").agg(F.sum("n").alias("n"), F.max("drawn").alias("drawn"))
    rows = sums.groupBy(*by, "number").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("x"), F.max("drawn").alias("drawn"))

    @F.pandas_udf("double")
    def scored(x: pd.Series, drawn: pd.Series) -> pd.Series:
        out = []
        for counts, weight in zip(x, drawn, strict=True):
            both = np.array(counts).reshape(2, len(weight), classes, classes)
            left, right = macro_f1_of(both)
            out.append(float(((left - right) * np.array(weight)).sum() / len(weight)))
        return pd.Series(out)

    each = rows.select(*by, "number", scored(F.transform("x", lambda e: e["n"]), F.col("drawn")).alias("d"))
    return parts.where("counts is null").select(*by, "number", "d").unionByName(each)


def comparison_grid(spark, systems: list[str], scopes: list[str]) -> DataFrame:
    """All pairs of systems (earlier first) within every scope, with a task index in that order."""
    rows, index = [], 0
    for scope in scopes:
        for i, left in enumerate(systems):
            for right in systems[i + 1 :]:
                rows.append((index, scope, left, right))
                index += 1
    return spark.createDataFrame(rows, "task_index int, family string, `left` string, `right` string")


def assembled(results: DataFrame, index: str, family: str, p: str, key: list[str]) -> DataFrame:
    """Results of separate tasks in the order of their index, with families numbered as first seen and Holm's p values.

    The order is kept in the columns ``position`` and ``family_position``; index must be unique.
    """
    require_unique(results, [index], "results")
    seen = results.groupBy(family).agg(F.min(index).alias("__first"))
    numbered = seen.select(family, F.row_number().over(Window.orderBy("__first")).alias("family_position"))
    adjusted = holm(results, [family], p, [index, *key])
    return adjusted.join(F.broadcast(numbered), family).withColumn("position", F.row_number().over(Window.orderBy(index)))
