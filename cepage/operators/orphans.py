"""Orphan references: keys named by child tables that the parent table lacks.

Keys are turned into integers of 128 bits (a UUID is one; integer text is one; other text is digested), the
parent keys are sorted and compressed into runs of successive integers, and every reference is matched as of the
nearest run start before it. A reference beyond that run's end is an orphan.

Scale: parents and references are pre-aggregated to distinct keys before one range shuffle on the key, so a key
named by a third of all rows travels once per task. Equal keys always fall into one range, so each partition
compresses and matches its own stretch; the kernel streams Arrow batches and keeps one key between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.session import parallelism

_KEY = ("__space", "__hi", "__lo")


def key_integer(key: Column) -> tuple[Column, Column, Column]:
    """(space, hi, lo) of a key's text: space 0 UUIDs, 1 integers of up to 18 digits, 2 the MD5 of other text."""
    is_uuid = key.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    is_int = key.rlike("^-?[0-9]{1,18}$")
    digits = F.when(is_uuid, F.replace(key, F.lit("-"), F.lit(""))).otherwise(F.md5(key.cast("binary")))
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")
    space = F.when(is_uuid, 0).when(is_int, 1).otherwise(2)
    number = F.when(is_int, key).try_cast("bigint")
    return space, F.when(is_int, F.lit(0)).otherwise(half(1)), F.when(is_int, number).otherwise(half(17))


def _relation_numbers(column: pa.Array, last: object) -> tuple[np.ndarray, list]:
    """Numbers of the relations of sorted rows, 0 for the relation ``last`` (of the batch before), and the distinct ones in order."""
    coded = column.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.append(True, codes[1:] != codes[:-1])
    values = [coded.dictionary[int(k)].as_py() for k in codes[starts]]
    first = 0 if values[0] == last else 1
    return np.cumsum(starts) - 1 + first, values


def beyond_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by (relation, key, parent first), the reference rows that no run of parent keys holds."""
    last, last_relation = None, object()  # the greatest parent key so far and its relation
    for batch in batches:
        if not batch.num_rows:
            continue
        number, values = _relation_numbers(batch.column("relation"), last_relation)
        keys = np.column_stack([number, *(batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in _KEY)])
        parent = batch.column("__parent").to_numpy(zero_copy_only=False).astype(bool)
        held = keys[parent] if last is None else np.vstack([last, keys[parent]])
        seen = np.cumsum(parent) + (last is not None)  # parents at or before each row
        orphan = ~parent
        if len(held):
            gap = np.ones(len(held), bool)
            same = (held[1:, :3] == held[:-1, :3]).all(axis=1)
            gap[1:] = ~(same & (held[1:, 3] - 1 <= held[:-1, 3]) & (held[1:, 3] > held[:-1, 3]) | same & (held[1:, 3] == held[:-1, 3]))
            run = np.cumsum(gap) - 1
            ends = held[np.append(np.flatnonzero(gap)[1:] - 1, len(held) - 1)]
            rows = np.flatnonzero(~parent & (seen > 0))
            end = ends[run[seen[rows] - 1]]
            beyond = np.zeros(len(rows), bool)
            for k in (3, 2, 1, 0):  # lexicographic reference > run end
                beyond = (keys[rows, k] > end[:, k]) | ((keys[rows, k] == end[:, k]) & beyond)
            orphan[rows] = beyond
            last = held[-1:].copy()
            last_relation = values[int(last[0, 0]) - int(number[0])] if last[0, 0] >= number[0] else last_relation
            last[0, 0] = 0
        if orphan.any():
            yield batch.filter(pa.array(orphan))


def find_orphans(parents: DataFrame, references: DataFrame, partitions: int | None = None) -> DataFrame:
    """References whose key is not among the parent keys of the same relation.

    parents: columns relation, ref_key. references: the same and any further columns, which are kept. Nulls in
    relation match nulls; a null ref_key names nothing and is never reported. Repeated references are returned
    once. An empty parent table makes every reference an orphan; an empty reference table gives no rows. Reference
    columns may have any names but those that begin with two underscores.
    """
    require_columns(parents, ("relation", "ref_key"))
    require_columns(references, ("relation", "ref_key"))
    spark = references.sparkSession
    space, hi, lo = key_integer(F.col("ref_key"))
    keys = [space.cast("int").alias("__space"), hi.alias("__hi"), lo.alias("__lo")]
    named = F.col("ref_key").isNotNull()
    left = parents.where(named).select("relation", "ref_key").distinct().select("relation", *keys, F.lit(True).alias("__parent"))
    right = references.where(named).distinct().select(*keys, F.lit(False).alias("__parent"), *(f"`{c}`" for c in references.columns))
    order = ("relation", *_KEY)
    both = left.unionByName(right, allowMissingColumns=True).repartitionByRange(partitions or parallelism(spark), *order)
    both = both.sortWithinPartitions(*order, F.col("__parent").desc())
    out = both.mapInArrow(beyond_runs, both.schema)
    return out.select(*(f"`{c}`" for c in references.columns))


def orphan_report(parents: DataFrame, references: DataFrame, period: Column) -> DataFrame:
    """Orphans counted per child_table, child_field and period (a column over references).

    references: relation, ref_key, child_table, child_field and what ``period`` needs. Counts are taken per key
    before the match. Rows without a date are counted under a null period.
    """
    keyed = references.where(F.col("ref_key").isNotNull()).groupBy("relation", "ref_key", "child_table", "child_field", period.alias("period")).agg(F.count("*").alias("n_rows"))
    return (
        find_orphans(parents, keyed)
        .groupBy("child_table", "child_field", "period")
        .agg(F.count("*").alias("orphan_keys"), F.sum("n_rows").alias("orphan_rows"))
    )
