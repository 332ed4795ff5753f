"""Consolidation of many small files into few large ones along a Hilbert curve.

1. Every listing is reduced to the place it leads to; the listing with the smallest order key stands for the file.
2. Each file falls into a cell of a grid over the given dimensions; cells are laid along a Hilbert curve.
3. An exact histogram of bytes per cell (at most 2**(bits * dimensions) rows, a bound set by parameters) is cut
   into stretches of about the target size. Cells above the target are split by a second exact histogram over
   hash buckets, whose number follows the bytes, so a cell with a third of all files is no hot spot.
4. One direct shuffle by pack number writes each pack as one file; row digests of source and destination must agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.session import cut, scratch_path


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert codes of integer points (rows) with ``bits`` bits in each of their n dimensions.

    The usual transpose method: undo excess rotations from the top bit down, Gray-encode, interleave.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            code = (code << 1) | ((x[i] >> b) & 1)
    return code


def cut_stretches(sizes: np.ndarray, target: int) -> np.ndarray:
    """Pack number of each successive weight: a new pack begins where the next weight would overfill it."""
    packs, filled, pack = np.zeros(len(sizes), np.int64), 0, 0
    for k, s in enumerate(sizes.tolist()):
        if filled and filled + s > target:
            pack, filled = pack + 1, 0
        packs[k], filled = pack, filled + s
    return packs


@dataclass(frozen=True)
class Dimension:
    """A grid dimension: a column, and whether its order matters (quantile steps) or not (hash steps)."""

    column: str
    ordered: bool = False


def _coordinates(df: DataFrame, dimensions: list[Dimension], bits: int) -> list[Column]:
    """Columns of grid coordinates; ordered dimensions are cut at 2**bits - 1 quantiles of all rows; null is 0."""
    steps = 1 << bits
    ordered = [d.column for d in dimensions if d.ordered]
    cuts: dict[str, list] = {}
    if ordered:
        at = [k / steps for k in range(1, steps)]
        row = df.agg(*(F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 10_000).alias(c) for c in ordered)).first()
        cuts = {c: sorted(set(row[c] or [])) for c in ordered}
    out = []
    for d in dimensions:
        c = F.col(f"`{d.column}`")
        if d.ordered:
            value = c.cast("double")
            below = F.size(F.filter(F.array(*map(F.lit, cuts[d.column])).cast("array<double>"), lambda b, v=value: b < v))
            out.append(F.when(c.isNull() | F.isnan(value), 0).otherwise(below))
        else:
            out.append(F.pmod(F.xxhash64(c), F.lit(steps)).cast("int"))
    return out


def distinct_files(listings: DataFrame, path: str = "relative_path", size: str = "file_size_bytes", order: str = "source_row", dims: list[str] = ()) -> DataFrame:
    """One row per file that the listings lead to: path, order key of its first listing, bytes and dimensions.

    Null and empty paths list no file. A size that is null or not positive in one listing is taken from another;
    unknown in all, it is 0.
    """
    c = lambda n: F.col(f"`{n}`")
    rows = listings.select(N.file_path(c(path)).alias("path"), c(order).alias("first_row"), F.when(c(size) > 0, c(size)).cast("bigint").alias("bytes"), *(c(d).alias(f"dim_{k}") for k, d in enumerate(dims)))
    rows = rows.where(F.col("path").isNotNull())
    kept = [f"dim_{k}" for k in range(len(dims))]
    return (
        rows.groupBy("path")
        .agg(F.min(F.struct("first_row", *kept)).alias("first"), F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"))
        .select("path", "bytes", "first.*")
    )


def plan_packs(files: DataFrame, dimensions: list[Dimension], target_bytes: int, bits: int = 5, min_bytes: int = 1) -> tuple[DataFrame, int]:
    """``files`` with pack_id, and the number of packs. Files weigh at least ``min_bytes``, so unknown sizes count.

    The driver sees the histogram of cells (bounded by bits) and of the split cells (about four rows per pack).
    """
    spark = files.sparkSession
    if bits * len(dimensions) > 18:
        raise ValueError("bits * dimensions must be at most 18, the bound of the cell histogram")
    names = [f"__x{k}" for k in range(len(dimensions))]
    weight = F.greatest(F.col("bytes"), F.lit(min_bytes))
    grid = files.withColumns(dict(zip(names, _coordinates(files, dimensions, bits), strict=True)) | {"__weight": weight})
    grid = grid.withColumn("__cell", sum((F.col(n).cast("int") * (1 << (bits * k)) for k, n in enumerate(names)), F.lit(0)))
    cells = grid.groupBy("__cell").agg(F.sum("__weight").alias("w")).toPandas()
    if cells.empty:
        return files.withColumn("pack_id", F.lit(0)), 1
    points = np.column_stack([(cells["__cell"].to_numpy() >> (bits * k)) & ((1 << bits) - 1) for k in range(len(names))])
    cells["code"] = hilbert_index(points, bits)
    hot = cells[cells.w > target_bytes]
    ways = {int(c): 1 << math.ceil(math.log2(4 * w / target_bytes)) for c, w in zip(hot["__cell"], hot.w, strict=True)}
    slots = cells[["__cell", "code", "w"]].assign(slot=0)
    ways_df = spark.createDataFrame([(int(c), ways.get(int(c), 1)) for c in cells["__cell"]], "`__cell` int, ways int")
    slotted = grid.join(F.broadcast(ways_df), "__cell").withColumn("__slot", F.pmod(F.xxhash64("path"), F.col("ways")))
    if ways:
        parts = slotted.where("ways > 1").groupBy("__cell", "__slot").agg(F.sum("__weight").alias("w")).toPandas()
        parts = parts.rename(columns={"__slot": "slot"}).merge(cells[["__cell", "code"]], on="__cell")
        slots = np_concat(slots[~slots["__cell"].isin(ways)], parts[slots.columns])
    slots = slots.sort_values(["code", "slot"], kind="stable")
    packs = cut_stretches(slots.w.to_numpy(np.int64), target_bytes)
    rows = list(zip(slots["__cell"].astype(int).tolist(), slots.slot.astype(int).tolist(), packs.tolist(), strict=True))
    mapping = spark.createDataFrame(rows, "`__cell` int, `__slot` bigint, pack_id int")
    mapping = F.broadcast(mapping) if len(rows) <= 1_000_000 else mapping
    out = slotted.join(mapping, ["__cell", "__slot"]).select(*files.columns, "pack_id")
    return out, int(packs[-1]) + 1


def np_concat(*frames):
    import pandas as pd

    return pd.concat(frames, ignore_index=True)


def row_digest(df: DataFrame, columns: list[str]) -> tuple:
    """Count, sum and xor of the rows' 64-bit digests: equal for equal multisets of rows, in any order."""
    h = F.xxhash64(*(F.col(c) for c in columns))
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def compact(listings: DataFrame, out_path: str, dimensions: list[Dimension], target_bytes: int = 512 << 20, bits: int = 5, path: str = "relative_path", size: str = "file_size_bytes", order: str = "source_row") -> DataFrame:
    """Write every listed file exactly once, in packs of about ``target_bytes`` along the Hilbert curve.

    Returns the written table (pack_id, pack_offset, path, first_row, bytes). Files larger than the target get a
    pack of their own bucket. Raises if the digests of what was to be written and what lies there differ. An
    empty table writes an empty table.
    """
    files = cut(distinct_files(listings, path, size, order, [d.column for d in dimensions]))
    grid = [Dimension(f"dim_{k}", d.ordered) for k, d in enumerate(dimensions)]
    planned, packs = plan_packs(files, grid, target_bytes, bits)
    from pyspark.sql import Window

    offset = F.sum("bytes").over(Window.partitionBy("pack_id").orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1))
    rows = planned.repartitionById(packs, F.col("pack_id")).withColumn("pack_offset", F.coalesce(offset, F.lit(0)))
    rows.select("pack_id", "pack_offset", "path", "first_row", "bytes").write.mode("errorifexists").parquet(out_path)
    written = listings.sparkSession.read.parquet(out_path)
    columns = ["path", "first_row", "bytes"]
    if row_digest(files, columns) != row_digest(written, columns):
        raise RuntimeError(f"the packs in {out_path} differ from their source")
    return written


def left_out(listings: DataFrame, written: DataFrame, path: str = "relative_path", order: str = "source_row") -> DataFrame:
    """Listings that the packs leave out because an earlier listing leads to the same file."""
    listed = listings.where(N.file_path(F.col(f"`{path}`")).isNotNull()).select(F.col(f"`{order}`").alias("source_row"))
    return listed.join(written.select(F.col("first_row").alias("source_row")), "source_row", "left_anti").distinct()


def compact_table(listings: DataFrame, dimensions: list[Dimension], **options) -> DataFrame:
    """``compact`` into a fresh folder of the shared directory."""
    return compact(listings, scratch_path(listings.sparkSession, "packs"), dimensions, **options)


def pack_files(spark: SparkSession, root: str, out_path: str, target_bytes: int = 512 << 20, bits: int = 5, pattern: str = "*") -> DataFrame:
    """Read every file below ``root`` and write its bytes into packs of about ``target_bytes``, one file each.

    Packs are planned on listings (folder and time of change are the dimensions), so contents are read and shuffled
    once. Written are pack_id, path, bytes, sha256 and content. Raises if the paths, sizes and digests of what was
    read and what lies in the packs differ. Returns the table of packs; a tree without files gives an empty one.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    listed = cut(found.select("path", F.col("length").alias("bytes"), F.regexp_replace("path", "/[^/]*$", "").alias("dim_0"), F.unix_micros("modificationTime").alias("dim_1")))
    planned, packs = plan_packs(listed, [Dimension("dim_0"), Dimension("dim_1", ordered=True)], target_bytes, bits)
    planned = cut(planned.select("path", "pack_id"))
    content = found.select("path", F.col("length").alias("bytes"), "content").join(planned, "path")
    content.repartitionById(packs, F.col("pack_id")).select("pack_id", "path", "bytes", F.sha2("content", 256).alias("sha256"), "content").write.mode("errorifexists").parquet(out_path)
    written = spark.read.parquet(out_path)
    source = found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    packed = written.select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if row_digest(source, ["path", "bytes", "sha256"]) != row_digest(packed, ["path", "bytes", "sha256"]):
        raise RuntimeError(f"the packs in {out_path} differ from the files below {root}")
    return written
