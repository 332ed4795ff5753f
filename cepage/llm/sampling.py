"""A reproducible sample that stays stable as data grows, by epoch-rate selection.

The first time a record is seen, its epoch and that epoch's rate are written to a registry and never change. A
record is selected if a counter-based random number, keyed by its identifier, lies below its frozen rate. So the
sample depends on nothing but identifiers and the registry: not on order, partitions, reruns or later records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns

# Multipliers and key increments of the Philox generator with four words of 32 bits.
_M0, _M1 = np.uint64(0xD2511F53), np.uint64(0xCD9E8D57)
_W0, _W1 = np.uint64(0x9E3779B9), np.uint64(0xBB67AE85)
_LOW, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def philox(counter: list[np.ndarray], key: list[np.ndarray], rounds: int = 10) -> list[np.ndarray]:
    """Philox 4x32: four counter words and two key words (arrays of uint64 below 2**32) to four random words."""
    c0, c1, c2, c3 = counter
    k0, k1 = key
    for _ in range(rounds):
        p0, p1 = _M0 * c0, _M1 * c2
        c0, c1, c2, c3 = (p1 >> _32) ^ c1 ^ k0, p1 & _LOW, (p0 >> _32) ^ c3 ^ k1, p0 & _LOW
        k0, k1 = (k0 + _W0) & _LOW, (k1 + _W1) & _LOW
    return [c0, c1, c2, c3]


def uniform(a: np.ndarray, b: np.ndarray, seed: int, draw: int = 0) -> np.ndarray:
    """Numbers in [0, 1) of 53 bits for identifiers given as two 64-bit hashes: a is the key, b part of the counter."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    zero = np.zeros(len(a), np.uint64)
    w = philox([b & _LOW, b >> _32, zero + np.uint64(draw), zero + np.uint64(seed)], [a & _LOW, a >> _32])
    return ((w[0] << _32 | w[1]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def random_of(identifier: Column, seed: int) -> Column:
    """The random number of an identifier; null for null."""

    @F.pandas_udf("double")
    def draw(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(uniform(a.to_numpy(np.int64), b.to_numpy(np.int64), seed))

    text = identifier.cast("string")
    return F.when(identifier.isNotNull(), draw(F.xxhash64(text), F.xxhash64(F.lit(1), text)))


def newcomers(records: DataFrame, record: str, epoch: Column, rate: Column, registry: DataFrame | None = None, stratum: str | None = None) -> DataFrame:
    """Rows (id, stratum, first_epoch, rate) to add to the registry: those of records that it lacks.

    ``epoch`` and ``rate`` are columns over records. Of repeated new records the one of the smallest epoch counts.
    Null ids are passed over; a null rate selects nothing.
    """
    require_columns(records, (record,) if stratum is None else (record, stratum))
    group = F.col(f"`{stratum}`").cast("string") if stratum else F.lit(None).cast("string")
    rows = records.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").alias("id"), group.alias("stratum"), epoch.alias("first_epoch"), rate.cast("double").alias("rate"))
    if registry is not None:
        rows = rows.join(registry.select("id"), "id", "left_anti")
    return rows.groupBy("id").agg(F.min(F.struct("first_epoch", "rate", "stratum")).alias("x")).select("id", "x.stratum", "x.first_epoch", "x.rate")


def register(records: DataFrame, record: str, epoch: Column, rate: Column, registry: DataFrame | None = None, stratum: str | None = None) -> DataFrame:
    """The registry (id, stratum, first_epoch, rate) with the records it lacks; known ones stay as they are.

    See ``newcomers``. To persist the registry, write what is returned, or add the newcomers to what is there.
    """
    new = newcomers(records, record, epoch, rate, registry, stratum)
    return new if registry is None else registry.select(*new.columns).unionByName(new)


def select_sample(registry: DataFrame, seed: int = 0) -> DataFrame:
    """The registry's rows that are selected."""
    return registry.where(random_of(F.col("id"), seed) < F.col("rate"))
