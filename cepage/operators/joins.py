"""Joins with validated keys, match indicators and distance conditions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions import scalars as S
from cepage.functions.bits import by_bucket, flip_masks, ranges
from cepage.session import cut, parallelism


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df``, after checking that no key occurs twice."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what} has repeated keys ({', '.join(keys)})")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join after checking that keys are unique on both sides."""
    return require_unique(left, keys, "left side").join(require_unique(right, keys, "right side"), keys)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], required: bool = False) -> DataFrame:
    """Lookup of right rows, unique by key; with ``required`` a key that is missing raises when the row is read."""
    found = require_unique(right, keys, "right side").withColumn("__found", F.lit(True))
    joined = left.join(found, keys, "left" if required else "inner")
    if required:
        present = F.when(F.col("__found").isNotNull(), True).otherwise(F.raise_error(F.lit("key not found")).cast("boolean"))
        joined = joined.where(present)
    return joined.drop("__found")


def skewed_lookup(rows: DataFrame, table: DataFrame, key: str, counted: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join of rows with ``table``, unique by key, whose column ``counted`` says how many rows have the key.

    Keys of more than ``hot_rows`` rows (so at most one per ``hot_rows`` rows) are sent to all tasks; only the others
    are shuffled. Both sides are read twice if there are such keys, so they should lie in written tables.
    """
    hot = table.where(F.col(counted) > hot_rows)
    if hot.isEmpty():
        return rows.join(table.drop(counted), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(counted) <= hot_rows).drop(counted), key)
    return rows.join(F.broadcast(hot.drop(counted)), key).unionByName(cold)


def match_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join with the column ``match``: both, left_only or right_only."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, "full")
    kind = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return joined.withColumn("match", kind).drop("__l", "__r")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side that lacks them."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether both sides have the same set of keys."""
    return coverage(left, right, key).isEmpty()


def ordered_pairs(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Pairs of rows with equal keys, the one with the smaller ``order`` first; equal orders make no pair."""
    a = df.select(*keys, F.col(order).alias(f"{order}_a"), *(F.col(f).alias(f"{f}_a") for f in fields))
    b = df.select(*keys, F.col(order).alias(f"{order}_b"), *(F.col(f).alias(f"{f}_b") for f in fields))
    return a.join(b, keys).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


#: Seconds that a copy in the shuffle, a probe and a candidate take; only their ratios matter.
COPY_S, PROBE_S, CANDIDATE_S = 1.5e-6, 8e-8, 1.2e-8
#: Bits of a bucket beside its number of stretch and piece: a value of the piece (folded where it is longer), the numbers of two blocks.
VALUE_BITS, BLOCK_BITS = 20, 16
#: Rows of a bucket that a task holds at once, however many hashes there are.
BUCKET_ROWS = 1_000_000


def _stretches(most: int, parts: int) -> list[tuple[int, int, int]]:
    """(first bit, end, bits that may differ) of the ``parts`` stretches that 64 bits are cut into.

    Allowed bits plus one add up to ``most`` + 1 over all stretches, so that at ``most`` wrong bits in all some stretch
    has no more than its own.
    """
    ends = [64 * k // parts for k in range(parts + 1)]
    base, extra = divmod(most + 1, parts)
    return [(a, b, base - 1 + (k < extra)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def _pieces(a: int, b: int, errors: int) -> list[tuple[int, int]]:
    """A stretch in ``errors`` + 1 pieces, one of which is equal where at most ``errors`` bits differ."""
    ends = [a + (b - a) * k // (errors + 1) for k in range(errors + 2)]
    return list(zip(ends, ends[1:], strict=False))


def _cheapest(most: int, rows: int) -> int:
    """Number of stretches for ``rows`` distinct hashes: fewer and longer ones have more probes, and fewer candidates."""

    def cost(parts: int) -> float:
        per_row = 0.0
        for a, b, errors in _stretches(most, parts):
            near = lambda bits, e=errors: sum(math.comb(bits, k) for k in range(e + 1))
            per_row += sum(COPY_S + near(b - a - (y - x)) * PROBE_S for x, y in _pieces(a, b, errors)) + rows / 2 * near(b - a) / 2 ** (b - a) * CANDIDATE_S
        return per_row

    return min(range(2, most + 2), key=cost)


def _mask(a: int, b: int) -> np.uint64:
    return np.uint64(((1 << (b - a)) - 1) << a)


def _search(places: list[tuple[int, list, int, int, int]], chunk: int = 200_000, block: int = 1_000_000):
    """A mapInArrow function: hashes sorted by bucket to the close pairs that belong to the bucket.

    places: by number of stretch and piece, the kind of hash, its stretches, the most bits that may differ, and which
    stretch and piece it is. A pair belongs to the first stretch that is good enough, and there to the first equal piece.
    """

    def pairs_of(place: tuple[int, list, int, int, int], bucket: np.ndarray, g: np.ndarray, salt: np.ndarray):
        _, cuts, most, k, p = place
        a, b, errors = cuts[k]
        pieces = _pieces(a, b, errors)
        width, own = np.uint64(b - a), _mask(*pieces[p])
        _, dense = np.unique(bucket, return_inverse=True)
        key = (dense.astype(np.uint64) << width) | ((g >> np.uint64(a)) & _mask(0, b - a))
        order = np.argsort(key, kind="stable")
        key, g, salt, bucket = key[order], g[order], salt[order], bucket[order]
        crossed = (bucket >> BLOCK_BITS) & ((1 << BLOCK_BITS) - 1) != bucket & ((1 << BLOCK_BITS) - 1)
        before, after = pieces[p][0] - a, pieces[p][1] - a
        for flips in flip_masks(int(width) - (after - before), errors):
            # The bits of the piece itself are equal: flips are laid around it.
            flip = (flips & _mask(0, before)) | ((flips >> np.uint64(before)) << np.uint64(after))
            if flip:
                wanted = key ^ flip
                up = np.flatnonzero(wanted > key)
                left, right = np.searchsorted(key, wanted[up], "left"), np.searchsorted(key, wanted[up], "right")
            else:
                up = np.arange(len(key))
                left, right = up + 1, np.searchsorted(key, key, "right")
            for n, j in ranges(left, right, block):
                i = up[n]
                x = g[i] ^ g[j]
                ok = np.bitwise_count(x) <= most
                ok &= ~crossed[i] | (salt[i] != salt[j])
                i, j, x = i[ok], j[ok], x[ok]
                keep = (x & own) == 0
                for f, t, e in cuts[:k]:
                    keep &= np.bitwise_count(x & _mask(f, t)) > e
                for f, t in pieces[:p]:
                    keep &= (x & _mask(f, t)) != 0
                if keep.any():
                    yield g[i[keep]].view(np.int64), g[j[keep]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, "bucket", chunk):
            bucket, g, salt = table.column("bucket").to_numpy(), table.column("h").to_numpy().view(np.uint64), table.column("salt").to_numpy()
            numbers = bucket >> (VALUE_BITS + 2 * BLOCK_BITS)
            for number in np.unique(numbers):
                at, place = numbers == number, places[number]
                for a, b in pairs_of(place, bucket[at], g[at], salt[at]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), place[0], np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["no", "ha", "hb"])

    return run


def _close_classes(classes: DataFrame, most: list[int], rows: dict[int, int], max_bucket: int, parts: int | None = None) -> DataFrame:
    """(no, ha, hb) of classes (no, h), distinct, whose hashes differ in at most most[no] bits, ha < hb; ``rows`` are the classes of each kind.

    A hash goes to a bucket for each piece of each stretch, ``most`` + 1 in all; changed values are looked up there, in
    sorted arrays, and never shuffled. Buckets above ``max_bucket`` rows, or four times what even hashes make (up to
    ``BUCKET_ROWS``), are split into blocks, each pair of blocks a bucket.
    """
    if not all(0 <= m <= 11 for m in most):
        raise ValueError("hashes may differ in 0 to 11 bits")
    places, limits, buckets = [], [], F.lit(None).cast("array<bigint>")
    for no, m in enumerate(most):
        # Distinct hashes are never equal, so there is nothing to find within 0 bits.
        cuts = _stretches(m, parts or _cheapest(m, rows.get(no, 0))) if m else []
        values = []
        for k, (a, b, errors) in enumerate(cuts):
            for p, (x, y) in enumerate(_pieces(a, b, errors)):
                value = F.shiftrightunsigned("h", x).bitwiseAND(F.lit((1 << (y - x)) - 1))
                if y - x > VALUE_BITS:
                    value = value.bitwiseXOR(F.shiftrightunsigned(value, VALUE_BITS)).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
                values.append(F.lit(len(places) << VALUE_BITS).cast("bigint").bitwiseOR(value.cast("bigint")))
                places.append((no, cuts, m, k, p))
                limits.append(max(max_bucket, min(BUCKET_ROWS, 4 * rows.get(no, 0) >> min(y - x, VALUE_BITS))))
        if values:
            buckets = F.when(F.col("no") == no, F.array(*values)).otherwise(buckets)
    copies = classes.select("h", F.explode(buckets).alias("bucket"))
    hot = []
    if max(rows.values(), default=0) > max_bucket:
        limit = F.get(F.array(*map(F.lit, limits)), F.shiftright("bucket", VALUE_BITS).cast("int"))
        hot = copies.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()
    if hot:
        ways = {r["bucket"]: math.ceil(r["n"] / limits[r["bucket"] >> VALUE_BITS]) for r in hot}
        if max(ways.values()) >= 1 << BLOCK_BITS:
            raise ValueError(f"max_bucket = {max_bucket} is too small for these hashes")
        split = F.broadcast(classes.sparkSession.createDataFrame(list(ways.items()), "bucket bigint, ways int"))
        copies = copies.join(split, "bucket", "left").withColumn("ways", F.coalesce("ways", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("h"), F.col("ways")).cast("int"))
        copies = copies.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
        blocks = F.shiftleft(F.least("salt", "other").cast("bigint"), BLOCK_BITS).bitwiseOR(F.greatest("salt", "other").cast("bigint"))
    else:
        copies, blocks = copies.withColumn("salt", F.lit(0)), F.lit(0).cast("bigint")
    copies = copies.select(F.shiftleft("bucket", 2 * BLOCK_BITS).bitwiseOR(blocks).alias("bucket"), "h", "salt")
    copies = copies.repartition(parallelism(classes.sparkSession), "bucket").sortWithinPartitions("bucket")
    return copies.mapInArrow(_search(places), "no int, ha bigint, hb bigint")


def close_hashes(hashes: DataFrame, most: int, max_bucket: int = 100_000, parts: int | None = None) -> DataFrame:
    """(ha, hb) of distinct hashes (column h, bigint), ha < hb, that differ in at most ``most`` bits (up to 11).

    A hash is cut into stretches, ``parts`` or as many as are cheapest for their number, one of which differs in no more
    than its share of the bits.
    """
    classes = cut(hashes.where(F.col("h").isNotNull()).select(F.lit(0).alias("no"), "h").distinct())
    return _close_classes(classes, [most], {0: classes.count()}, max_bucket, parts).select("ha", "hb")


def hamming_pairs(df: DataFrame, key: str, hashes: dict[str, int], hot_rows: int = 100_000, max_bucket: int = 100_000) -> DataFrame:
    """Pairs of keys (a < b) whose hashes (bigint columns, with the most bits that may differ) are close by any.

    Hashes are compared once each, all kinds in one search, then their rows are looked up; rows of a hash that more than
    ``hot_rows`` share are salted. Distances are null where a side has no hash; a key of several rows has the least of
    those found. ``triggered_by`` names the hashes that are close.
    """
    fields = [f"h{k}" for k in range(len(hashes))]
    rows = cut(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(F.col(h).alias(f) for h, f in zip(hashes, fields, strict=True))))
    kinds = F.array(*(F.struct(F.lit(k).alias("no"), F.col(f).alias("h")) for k, f in enumerate(fields)))
    members = rows.select(F.inline(kinds), "key", *fields).where(F.col("h").isNotNull())
    classes = cut(members.groupBy("no", "h").agg(F.count("*").alias("n")))
    counts = classes.groupBy("no").agg(F.count("*").alias("classes"), F.max("n").alias("n")).collect()
    pairs = _close_classes(classes, list(hashes.values()), {r["no"]: r["classes"] for r in counts}, max_bucket)
    pairs = pairs.unionByName(classes.where("n > 1").select("no", F.col("h").alias("ha"), F.col("h").alias("hb")))
    salted = any(r["n"] > hot_rows for r in counts)
    hot = classes.where(F.col("n") > hot_rows).select("no", "h", F.ceil(F.col("n") / hot_rows).cast("int").alias("ways"))
    for end in ("a", "b"):
        on = ["no", f"h{end}"]
        side = members.select("no", F.col("h").alias(f"h{end}"), F.col("key").alias(end), *(F.col(f).alias(f"{f}_{end}") for f in fields))
        if salted:
            here, ways = F.broadcast(hot.withColumnRenamed("h", f"h{end}")), F.coalesce("ways", F.lit(1))
            side = side.join(here, on, "left").withColumn("salt", F.pmod(F.xxhash64(end), ways).cast("int")).drop("ways")
            pairs = pairs.join(here, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways")
            on.append("salt")
        pairs = pairs.join(side, on)
        if salted:
            pairs = pairs.drop("salt")
    distances = [f"{h}_distance" for h in hashes]
    # A class paired with itself gives each pair of its rows twice.
    found = pairs.where((F.col("a") < F.col("b")) | (F.col("ha") != F.col("hb")) & (F.col("a") > F.col("b")))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(S.hamming(F.col(f"{f}_a"), F.col(f"{f}_b")).alias(d) for f, d in zip(fields, distances, strict=True)))
    found = found.groupBy("a", "b").agg(*(F.min(d).alias(d) for d in distances))
    near = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{h}_distance") <= most, h) for h, most in hashes.items()))), "+")
    return found.select("a", "b", *distances, near.alias("triggered_by"))


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], value: str, missing: str) -> DataFrame:
    """Left rows with the value of the first matching right row, or ``missing``."""
    best = right.groupBy(*on).agg(F.min_by(value, F.struct(*order)).alias(value))
    return left.join(best, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(missing)))
