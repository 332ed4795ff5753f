"""Readers of the project's tables in canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions import normalise as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_rows(image_record: DataFrame) -> DataFrame:
    """Rows of images that are held, with canonical image_id; rows without an id are dropped."""
    return (
        image_record.where(N.is_held(F.col("validation_status")))
        .withColumn("image_id", N.uuid_text(F.col("image_id")))
        .where(F.col("image_id").isNotNull())
    )


def held_images(image_record: DataFrame, **fields) -> DataFrame:
    """One row per held image; each keyword is a column expression of which the largest value is kept.

    All rows of an image agree on these fields, so the largest value only passes over nulls.
    """
    rows = held_rows(image_record).select("image_id", *(c.alias(k) for k, c in fields.items()))
    return rows.groupBy("image_id").agg(*(F.max(k).alias(k) for k in fields)) if fields else rows.distinct()
