"""Aggregations: seed summaries, moments, latency tables, duplicates, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cepage.operators.windows import interpolated_quantiles

def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 for one value) and the normal 95 % interval of the mean; nulls are dropped.

    Null group keys form groups of their own; a group without values has no row.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    half = 1.96 * F.col("std") / F.sqrt("n")
    return sums.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def population_moments(df: DataFrame, by: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """Count, mean and population deviation in one pass from sums and sums of squares, the variance at least 0."""
    w = F.lit(1.0) if weight is None else weight
    sums = df.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * value).alias("s"), F.sum(w * value * value).alias("q"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    variance = F.greatest(F.lit(0.0), F.try_divide(F.col("q"), F.col("n")) - mean * mean)
    return sums.select(*by, F.col("n").cast("double").alias("n"), mean.alias("mean"), F.sqrt(variance).alias("std"))


def require_spread(moments: DataFrame) -> DataFrame:
    """``moments``, raising when a deviation of zero is read, since nothing can be scaled by it."""
    return moments.where(F.when(F.col("std") > 0, True).otherwise(F.raise_error(F.lit("a channel has no deviation")).cast("boolean")))


def channel_moments(df: DataFrame, by: list[str], channels: Column) -> DataFrame:
    """Population moments of every element of an array column; a channel without deviation raises."""
    moments = population_moments(df.select(*by, F.posexplode(channels).alias("channel", "__v")).withColumn("__v", F.col("__v").cast("double")), [*by, "channel"], F.col("__v"))
    return require_spread(moments)


def latency_summary(df: DataFrame, by: list[str], repetition: str, latency: str, batch: int) -> DataFrame:
    """Mean, deviations (over all and between repetition means), percentiles by interpolation, throughput, peak.

    Null group keys and groups without values have no row.
    """
    each = df.groupBy(*by, repetition).agg(F.avg(latency).alias("rep_mean"), F.max(latency).alias("peak"))
    between = each.groupBy(*by).agg(F.coalesce(F.stddev_samp("rep_mean"), F.lit(0.0)).alias("std_between"), F.max("peak").alias("peak"), F.count("*").alias("repetitions"))
    over = df.groupBy(*by).agg(
        F.count(latency).alias("n"),
        F.avg(latency).alias("mean"),
        F.coalesce(F.stddev_samp(latency), F.lit(0.0)).alias("std"),
    )
    quantiles = interpolated_quantiles(df, by, latency, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    joined = over.join(between, by).join(quantiles, by)
    return joined.select(*by, "n", "mean", "std", "std_between", "median", "p95", "p99", F.try_divide(F.lit(batch * 1000.0), F.col("mean")).alias("throughput"), "peak", "repetitions")


def mark_duplicates(df: DataFrame, key: str, value: Column, code: str, errors: str) -> DataFrame:
    """(key, value) of every row whose value (not null, not empty) occurs more than once, with ``code`` added to the
    row's sorted distinct errors. Counts are joined back, so a value of a third of all rows is one row to join."""
    rows = df.select(F.col(key), value.alias("__value"), F.col(errors).alias("__errors"))
    repeated = rows.where("__value <> ''").groupBy("__value").agg(F.count("*").alias("n")).where("n > 1")
    codes = F.array_sort(F.array_distinct(F.array_append(F.filter(F.split(F.coalesce("__errors", F.lit("")), ";"), lambda e: e != ""), F.lit(code))))
    return rows.join(repeated, "__value").select(key, F.col("__value").alias("value"), F.array_join(codes, ";").alias("errors"))


def duplicate_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per field: distinct values, rows of repeated values, and rows beyond the first of each; empty values aside."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in values.items()))))
    counts = long.where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("field").agg(F.count("*").alias("distinct_values"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("all_members"), F.sum(F.col("n") - 1).alias("extra_members"))


def reconcile(counts: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """Differences between counted and expected n, with a text for each; missing sides count as 0."""
    both = counts.withColumnRenamed("n", "actual").join(expected.withColumnRenamed("n", "expected"), on, "full")
    both = both.select(*on, F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"), F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"))
    text = F.concat(F.concat_ws("/", *on), F.lit(": expected "), F.col("expected").cast("string"), F.lit(", found "), F.col("actual").cast("string"))
    return both.where("actual <> expected").withColumn("discrepancy", text)


def checks(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row: for each named condition whether all rows hold it, and ``passed`` for all of them; true for no rows."""
    row = df.agg(F.count("*").alias("__n"), *(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(k) for k, c in named.items())).drop("__n")
    passed = F.lit(True)
    for k in named:
        passed = passed & F.col(k)
    return row.withColumn("passed", passed)


def blank_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, key) of all rows in which a required field is null or blank."""
    long = df.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))))
    return long.where(F.coalesce(F.trim("value"), F.lit("")) == "").select("field", key)


def class_dictionary(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct (id, name), and whether the ids are exactly 0, 1, ... without a gap and each has one name."""
    pairs = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(key, name).distinct()
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(key, name)) - 1
    return pairs.withColumn("contiguous", (place == F.col(key)) & (n >= 1))


def running_loss(df: DataFrame, by: list[str], loss: str, samples: str, item: str) -> DataFrame:
    """Loss weighted by samples, samples, distinct items and repeats of items."""
    weighted = F.try_divide(F.sum(F.col(loss) * F.col(samples)), F.sum(samples))
    return df.groupBy(*by).agg(weighted.alias("mean_loss"), F.sum(samples).alias("samples"), F.count_distinct(item).alias("unique_items"), (F.count(item) - F.count_distinct(item)).alias("repeated_items"))


def epoch_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one), count and standard error per group."""
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    return sums.withColumn("sem", F.col("std") / F.sqrt(F.greatest(F.col("n"), F.lit(1))))
