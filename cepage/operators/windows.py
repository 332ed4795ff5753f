"""Rankings, running values and ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cepage.functions import scalars as S
from cepage.operators.joins import skewed_lookup
from cepage.session import cut


def global_row_number(df: DataFrame, order: list, name: str) -> DataFrame:
    """Row numbers over the whole table without gathering it: a distributed sort, then offsets of its partitions.

    ``order`` must be total. The sorted table is written once, so that partitions and offsets belong together.
    """
    low = (1 << 33) - 1
    rows = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(low)) + 1).drop("__part", "__before", "__at")


def sums_before(df: DataFrame, by: list[str], key: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over rows of the group with a smaller key; (group, key) must be unique.

    Ranges of (group, key) are cut wherever rows are, also within a group, so a group of a third of all rows is
    spread over a third of the tasks; each range sums its own rows and gets the totals of the ranges before it.
    """
    ranged = df.repartitionByRange(*by, key).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged)
    own = Window.partitionBy("__range", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    totals = ranged.groupBy("__range", *by).agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.col(c).alias(f"__by_{c}") for c in by), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = local.join(offsets.withColumnRenamed("__range", "__at"), same)
    return joined.select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


def first_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; ``order`` must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def last_row(df: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The last row of each group by the given columns, as an aggregate: no sort, and combined before the shuffle."""
    best = df.groupBy(*by).agg(F.max(F.struct(*order, *(f for f in fields if f not in order))).alias("x"))
    return best.select(*by, *(F.col(f"x.{f}").alias(f) for f in dict.fromkeys([*order, *fields])))


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "mean_rank") -> DataFrame:
    """Adds the rank within the group, ties averaged: counts per value are summed before each value and looked up.

    No group is gathered, and a value of very many rows is sent to all tasks. Null values rank first, as one tie.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = sums_before(counts, by, value, "__n", "__before")
    key = F.struct(*(F.col(c).alias(f"k{k}") for k, c in enumerate([*by, value])))
    table = cut(before.select(F.xxhash64(key).alias("__key"), key.alias("__k"), "__n", (F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)).alias(name)))
    rows = df.withColumns({"__key": F.xxhash64(key), "__k": key})
    hot = table.where(F.col("__n") > 1_000_000).select("__key").distinct()
    if hot.isEmpty():
        joined = rows.join(table.withColumnRenamed("__k", "__t"), "__key")
    else:
        cold = rows.join(F.broadcast(hot), "__key", "left_anti").join(table.withColumnRenamed("__k", "__t"), "__key")
        joined = rows.join(F.broadcast(table.join(hot, "__key", "left_semi").withColumnRenamed("__k", "__t")), "__key").unionByName(cold)
    return joined.where(F.col("__k").eqNullSafe(F.col("__t"))).select(*df.columns, name)


def ordinal_rank(df: DataFrame, by: list[str], order: Column, name: str) -> DataFrame:
    """Adds row numbers within groups by ``order``, which must be total; groups are cut into ranges, none is gathered."""
    return sums_before(df.withColumns({"__order": order, "__one": F.lit(1)}), by, "__order", "__one", name).select(*df.columns, (F.col(name) + 1).alias(name))


def ordinal_correlation(df: DataFrame, by: list[str], a: str, b: str, position: str) -> DataFrame:
    """Correlation of ordinal ranks (ties by position); 0 if a rank is constant."""
    ranked = df.select(*dict.fromkeys([*by, a, b, position]))
    for c, name in ((a, "ra"), (b, "rb")):
        ranked = ordinal_rank(ranked, by, F.struct(F.col(c).alias("v"), F.col(position).alias("p")), name)
    as_double = lambda c: F.col(c).cast("double")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.coalesce(F.corr(as_double("ra"), as_double("rb")), F.lit(0.0))).otherwise(0.0).alias("spearman"))


def top_overlap(df: DataFrame, by: list[str], a: str, b: str, position: str, fraction: float) -> DataFrame:
    """Jaccard overlap of the top fraction by two scores (numbers; the highest first, nulls last, ties by position)."""
    ranked = df.select(*dict.fromkeys([*by, a, b, position]))
    for c, name in ((a, "ra"), (b, "rb")):
        ranked = ordinal_rank(ranked, by, F.struct(F.col(c).isNull().alias("none"), (-F.col(c)).alias("v"), F.col(position).alias("p")), name)
    ranked = cut(ranked)
    sizes = ranked.groupBy(*by).agg(S.top_count(F.count("*"), fraction).alias("k"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # Only rows in some top fraction go on, so no group's rest is shuffled.
    marked = ranked.join(sizes.select(*(F.col(c).alias(f"__{c}") for c in by), "k"), same).where("ra <= k or rb <= k").groupBy(*by)
    both = F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k")))
    return marked.agg(both.alias("shared"), F.try_divide(both.cast("double"), F.count("*").cast("double")).alias("jaccard"))


def interpolated_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation, from counts per value; nulls and NaN are left out.

    Values are counted, then summed in ranges; no group is held in one buffer. A group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = cut(sums_before(counts, by, value, "__n", "__before"))
    totals = before.groupBy(*by).agg(F.sum("__n").alias("__total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = before.join(totals.select(*(F.col(c).alias(f"__{c}") for c in by), "__total"), same)
    out = {}
    for name, p in points.items():
        at = F.lit(p) * (F.col("__total") - 1)
        low = F.floor(at)
        within = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))
        share = at - low
        out[name] = F.coalesce(F.sum(F.when(within(low), F.col(value) * (1 - share))), F.lit(0.0)) + F.coalesce(F.sum(F.when(within(low + 1), F.col(value) * share)), F.lit(0.0))
    return joined.groupBy(*by).agg(*(c.alias(k) for k, c in out.items()))


def trapezoid_area(df: DataFrame, by: list[str], x: str, y: str, tie: str, allow_empty: bool = False) -> DataFrame:
    """Area under y over ordered x, divided by the length of x. Where x has no length this raises, or gives null if
    ``allow_empty``."""
    w = Window.partitionBy(*by).orderBy(x, tie)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    areas = df.withColumn("__a", step).groupBy(*by).agg(F.sum("__a").alias("area"), (F.max(x) - F.min(x)).alias("length"))
    length = F.col("length") if allow_empty else F.when(F.col("length") > 0, F.col("length")).otherwise(F.raise_error(F.lit("a curve has no length")).cast("double"))
    return areas.select(*by, F.try_divide(F.col("area"), length).alias("auc"))


def best_so_far(df: DataFrame, by: list[str], epoch: str, score: str, loss: str, minimum: float, patience: int) -> DataFrame:
    """Scan of scored epochs: an epoch is accepted if it betters the last accepted score by more than ``minimum``,
    or comes within it and has a higher score or, at the same score, a lower loss. Stops after ``patience``
    epochs in a row without acceptance. Returns the best epoch, its score, the accepted number and the last epoch.

    A group's epochs (a training run) are gathered in one row; groups are as long as runs have epochs.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(score).cast("double").alias("s"), F.col(loss).cast("double").alias("l"))))
    start = F.struct(
        F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("l"), F.lit(None).cast(dict(df.dtypes)[epoch]).alias("best"),
        F.lit(0).alias("accepted"), F.lit(0).alias("waited"), F.lit(None).cast(dict(df.dtypes)[epoch]).alias("last"),
    )

    def step(a: Column, x: Column) -> Column:
        near = F.abs(x["s"] - a["s"]) <= minimum
        ahead = (x["s"] > a["s"]) | ((x["s"] == a["s"]) & (x["l"] < a["l"]))
        good = a["s"].isNull() | (x["s"] > a["s"] + minimum) | (near & ahead)
        pick = lambda new, old: F.when(good, new).otherwise(old)
        moved = F.struct(
            pick(x["s"], a["s"]).alias("s"), pick(x["l"], a["l"]).alias("l"), pick(x["e"], a["best"]).alias("best"),
            (a["accepted"] + good.cast("int")).alias("accepted"), pick(F.lit(0), a["waited"] + 1).alias("waited"), x["e"].alias("last"),
        )
        return F.when(a["waited"] >= patience, a).otherwise(moved)

    scanned = df.groupBy(*by).agg(F.aggregate(steps, start, step).alias("x"))
    return scanned.select(*by, F.col("x.best").alias("best_epoch"), F.col("x.s").alias("best_score"), F.col("x.accepted").alias("accepted"), F.col("x.last").alias("last_epoch"))


def min_max_scores(df: DataFrame, key: str, axes: dict[str, bool]) -> DataFrame:
    """Each axis scaled to [0, 1] over all rows (value true: higher is better), and their mean.

    The bounds are one aggregated row that is sent to all tasks.
    """
    bounds = df.agg(*(f(c).alias(f"__{n}_{c}") for c in axes for n, f in (("low", F.min), ("high", F.max))))
    joined = df.crossJoin(F.broadcast(bounds))
    scaled = {f"{c}_score": S.min_max(F.col(c), F.col(f"__low_{c}"), F.col(f"__high_{c}"), up) for c, up in axes.items()}
    out = joined.select(key, *(v.alias(k) for k, v in scaled.items()))
    return out.withColumn("score", sum((F.col(k) for k in scaled), F.lit(0.0)) / len(axes))


def inverse_frequency(df: DataFrame, by: str, hot_rows: int = 1_000_000) -> DataFrame:
    """The rows with weight one over their class's count; weights of classes of many rows are sent to all tasks, the
    others are joined. Rows of no class are left out."""
    counts = df.groupBy(by).agg((F.lit(1.0) / F.count("*")).alias("weight"), F.count("*").alias("__n"))
    return skewed_lookup(df, counts, by, "__n", hot_rows)


def reindexed(df: DataFrame, key: str, order: list, fill: dict) -> DataFrame:
    """Exactly the rows of the keys in ``order``, with their place; what is not there gets the values of ``fill``."""
    spark = df.sparkSession
    places = spark.createDataFrame([(v, k) for k, v in enumerate(order)], f"`{key}` {dict(df.dtypes)[key]}, place int")
    return F.broadcast(places).join(df, key, "left").fillna(fill)


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows with replacement, by weight: (draw, key). Draw k is a number keyed by seed and k, looked up in the
    running sum of weights over ``key`` (unique), so results depend on neither order nor partitions. No rows give none."""
    spark = df.sparkSession
    summed = cut(sums_before(df.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("__w")).withColumn("__all", F.lit(0)), ["__all"], key, "__w", "__from"))
    total = summed.agg(F.sum("__w")).first()[0]
    if total is None:
        return summed.select(F.lit(0).cast("bigint").alias("draw"), key).limit(0)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) * F.lit(2.0**-53)).alias("__at")
    asked = spark.range(draws).select(F.col("id").alias("draw"), (uniform * total).alias("__at"))
    # As-of match: in one order of places, each draw takes the last running sum at or before it.
    both = summed.select(F.col("__from").alias("__at"), F.col(key).alias("__key"), F.lit(None).cast("bigint").alias("draw")).unionByName(asked.withColumn("__key", F.lit(None).cast(dict(df.dtypes)[key])).select("__at", "__key", "draw"))
    ranged = cut(both.repartitionByRange("__at").withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy("__range").orderBy("__at", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__here", F.last("__key", ignorenulls=True).over(w))
    ends = ranged.groupBy("__range").agg(F.max_by("__key", F.when(F.col("__key").isNotNull(), F.col("__at"))).alias("__end"))
    earlier = ends.select("__range", F.last("__end", ignorenulls=True).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    drawn = local.where("draw is not null").join(F.broadcast(earlier), "__range")
    return drawn.select("draw", F.coalesce("__here", "__before").alias(key))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int, allow_short: bool = False) -> DataFrame:
    """n rows of each stratum by a hash of seed and key, with their order over all strata.

    Only the n smallest hashes of each partition are kept before the shuffle. A stratum with fewer rows raises when
    rows are read, or gives all it has if ``allow_short``.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    rows = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull()).select(stratum, key, h.alias("h"))
    ranked = first_rows(rows, [stratum], ["h", key], n).drop("position")
    if not allow_short:
        have = F.count("*").over(Window.partitionBy(stratum))
        ranked = ranked.withColumn("__have", have).where(F.when(F.col("__have") >= n, True).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {n} rows in "), F.col(stratum).cast("string"))).cast("boolean"))).drop("__have")
    return ranked.withColumn("selection_order", F.row_number().over(Window.orderBy(stratum, "h", key)))
