"""Small helpers on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df``, or a ValueError that lists the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def partition_of(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows with one value of a column, such as those of a split; none raises."""
    rows = df.where(F.col(column) == value)
    if rows.isEmpty():
        raise ValueError(f"no rows with {column} = {value}")
    return rows
