"""Members behind pairs of classes, with large classes spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_classes(classes: DataFrame, key: list[str], counted: str, hot_rows: int) -> DataFrame:
    """(key, ways) of classes with more than ``hot_rows`` members; at most one per ``hot_rows`` records."""
    return classes.where(F.col(counted) > hot_rows).select(*key, F.ceil(F.col(counted) / hot_rows).cast("int").alias("ways"))


def with_members(pairs: DataFrame, members: DataFrame, key: list[str], member: str, hot: DataFrame) -> DataFrame:
    """``pairs`` joined with ``members`` (key, member) of the class named by ``key``; those of hot classes are salted."""
    ways = F.coalesce("ways", F.lit(1))
    asked = pairs.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways")
    given = members.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(member), ways).cast("int")).drop("ways")
    return asked.join(given, [*key, "__salt"]).drop("__salt")
