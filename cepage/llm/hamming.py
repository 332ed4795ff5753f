"""Near-duplicate records by generalised pigeonhole over 64-bit hashes.

Bits that go together are grouped into blocks (of eight bits, or fewer where more bits may differ), blocks into partitions, and each partition gets a
threshold of its own, found by dynamic programming on estimated candidate counts: any two hashes within the total
threshold agree, up to its own threshold, in at least one partition. Both the number of partitions and the
thresholds follow the data, so the probes grow and the candidates shrink as the collection does.

Copies of one hash form a class and are compared once. A hash travels to each sub-block of each partition (a
partition with threshold t has t + 1 of them, one of which must be equal), so all neighbours meet in one bucket and
flipped values are probed there, in sorted arrays, not shuffled. Each close pair is emitted by the first bucket
that holds it, which needs no distinct. Buckets above ``max_bucket`` rows are split into blocks, each pair of
blocks a bucket of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.llm.bits import by_bucket, flip_masks, ranges
from cepage.llm.expand import hot_classes, with_members
from cepage.session import cut, parallelism

#: A block's bits, by the most bits that may differ: a partition can be no finer than its blocks.
WIDTHS = ((7, 8), (15, 4), (31, 2))
#: Seconds that a copy in the shuffle, a probe and a candidate take; only their ratios matter.
COPY_S, PROBE_S, CANDIDATE_S = 1.5e-6, 8e-8, 1.2e-8


def block_width(total: int) -> int:
    """Bits of a block for hashes that differ in at most ``total`` bits."""
    for most, width in WIDTHS:
        if 0 <= total <= most:
            return width
    raise ValueError(f"hashes may differ in 0 to {WIDTHS[-1][0]} bits")


def _bits(h: np.ndarray) -> np.ndarray:
    """Bits of hashes, one row each, lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(h.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per kind, how often bits i and j are both set (i <= j; for i = j how often i is set), and rows as i = -1."""
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for kind, part in batch.groupby("kind"):
            b = _bits(part["h"].to_numpy()).astype(np.float32)
            sums[kind] = sums.get(kind, 0) + (b.T @ b).astype(np.float64)
            rows[kind] = rows.get(kind, 0) + len(b)
    for kind, s in sums.items():
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"kind": kind, "i": np.append(i, -1), "j": np.append(j, -1), "v": np.append(s[i, j], rows[kind])})


def _histograms(order: dict[str, np.ndarray], width: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((64 // width[k], 1 << width[k])) for k in order}
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                g, w = permute(part["h"].to_numpy(), order[kind]), width[kind]
                for b in range(64 // w):
                    sums[kind][b] += np.bincount(((g >> np.uint64(w * b)) & np.uint64((1 << w) - 1)).astype(np.int64), minlength=1 << w)
        for kind, s in sums.items():
            b, v = np.nonzero(s)
            if len(b):
                yield pd.DataFrame({"kind": kind, "i": b, "j": v, "v": s[b, v]})

    return run


def correlated_order(both: np.ndarray, rows: int, width: int = 8) -> np.ndarray:
    """Bit positions such that each ``width`` successive ones go together as much as greedy grouping finds."""
    p = np.diag(both) / max(rows, 1)
    cov = both / max(rows, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, order = list(range(64)), []
    while free:
        group = [max(free, key=lambda b: (r[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (r[b, group].sum(), -b)))
            free.remove(group[-1])
        order += group
    return np.array(order)


def permute(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Hashes with bit order[k] moved to place k, as unsigned integers."""
    u = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.int64).view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for k, b in enumerate(order):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def restore(g: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The inverse of ``permute``, as signed integers."""
    out = np.zeros(len(g), np.uint64)
    for k, b in enumerate(order):
        out |= ((g >> np.uint64(k)) & np.uint64(1)) << np.uint64(b)
    return out.view(np.int64)


@dataclass(frozen=True)
class Part:
    """A partition: its first block, number of blocks and threshold, as sub-blocks (first block, blocks)."""

    first: int
    blocks: int
    threshold: int
    subs: tuple[tuple[int, int], ...]
    width: int

    @property
    def mask(self) -> int:
        return ((1 << (self.width * self.blocks)) - 1) << (self.width * self.first)


def even_cuts(first: int, blocks: int, parts: int) -> tuple[tuple[int, int], ...]:
    """``blocks`` successive blocks in ``parts`` stretches of nearly equal length."""
    ends = [first + blocks * k // parts for k in range(parts + 1)]
    return tuple((a, b - a) for a, b in zip(ends, ends[1:], strict=False))


def allocate(histograms: np.ndarray, rows: int, total: int, probing: int | None = None, pairs: float | None = None) -> list[Part]:
    """The cheapest partitions and thresholds for hashes within ``total`` bits of each other.

    All ``rows`` are copied; ``probing`` of them (all if not given) look up the others, which makes ``pairs`` in all.

    Thresholds plus one add up to ``total`` + 1 (a partition with none is left out), which is what the generalised
    pigeonhole asks for. The chance of two hashes to lie within t bits in a partition comes from the blocks' exact
    distance distributions, folded together.
    """
    probing, pairs = rows if probing is None else probing, rows * rows / 2 if pairs is None else pairs
    many, values = histograms.shape
    width = values.bit_length() - 1
    distance = np.bitwise_count(np.arange(values)[:, None] ^ np.arange(values)[None, :])
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    near = [np.bincount(distance.ravel(), weights=np.outer(s, s).ravel(), minlength=width + 1) for s in share]
    best: tuple[float, list[Part]] = (math.inf, [])
    for m in range(2, many + 1):
        groups = even_cuts(0, many, m)
        table: dict[int, tuple[float, list[Part]]] = {0: (0.0, [])}
        for first, blocks in groups:
            folded = np.ones(1)
            for b in range(first, first + blocks):
                folded = np.convolve(folded, near[b])
            after: dict[int, tuple[float, list[Part]]] = {}
            for used, (cost, parts) in table.items():
                for u in range(min(blocks, total + 1 - used) + 1):
                    more, chosen = cost, parts
                    if u:
                        subs = even_cuts(first, blocks, u)
                        probes = sum(sum(math.comb(width * (blocks - n), e) for e in range(u)) for _, n in subs)
                        more += rows * u * COPY_S + probing * probes * PROBE_S + pairs * float(folded[:u].sum()) * CANDIDATE_S
                        chosen = [*parts, Part(first, blocks, u - 1, subs, width)]
                    if used + u not in after or more < after[used + u][0]:
                        after[used + u] = (more, chosen)
            table = after
        if total + 1 in table and table[total + 1][0] < best[0]:
            best = table[total + 1]
    return best[1]


@dataclass(frozen=True)
class Plan:
    order: np.ndarray
    parts: list[Part]
    total: int
    splits: dict[tuple[int, int, int], int]


#: Bits of a bucket: its tag, the numbers of two blocks, and a value of its sub-block (folded where it is longer).
BLOCK_BITS, VALUE_BITS = 12, 26


def tag_of(kind: int, part: int, sub: int) -> int:
    """The upper thirteen bits of a bucket."""
    return (kind << 10) | (part << 5) | sub


def _copies(plans: dict[str, Plan], numbers: dict[str, int]):
    """A mapInArrow function: each class to its buckets. A bucket is kind, partition, sub-block, block pair, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, hashes = batch.column("kind").to_numpy(zero_copy_only=False), batch.column("h").to_numpy()
            for kind, plan in plans.items():
                g = permute(hashes[kinds == kind], plan.order)
                if not len(g):
                    continue
                for p, part in enumerate(plan.parts):
                    for s, (first, blocks) in enumerate(part.subs):
                        w = part.width
                        value = (g >> np.uint64(w * first)) & np.uint64((1 << (w * blocks)) - 1)
                        value = (value ^ (value >> np.uint64(VALUE_BITS)) ^ (value >> np.uint64(2 * VALUE_BITS))) & np.uint64((1 << VALUE_BITS) - 1)
                        tag = tag_of(numbers[kind], p, s)
                        ways = np.ones(len(g), np.int64)
                        for (b, v), n in {(k[1], k[2]): n for k, n in plan.splits.items() if k[0] == tag}.items():
                            hot = ((g >> np.uint64(w * b)) & np.uint64((1 << w) - 1)) == v
                            ways[hot] = np.maximum(ways[hot], n)
                        mixed = (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                        salt = (mixed % ways.astype(np.uint64)).astype(np.int64)
                        for n in np.unique(ways):
                            at = np.flatnonzero(ways == n)
                            for other in range(int(n)):
                                lo, hi = np.minimum(salt[at], other), np.maximum(salt[at], other)
                                bucket = (((tag << 2 * BLOCK_BITS) | (lo << BLOCK_BITS) | hi) << VALUE_BITS) | value[at].astype(np.int64)
                                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(g[at].view(np.int64)), pa.array(salt[at].astype(np.int16))], ["bucket", "g", "salt"])

    return run


def _search(plans: dict[str, Plan], numbers: dict[str, int], chunk: int, block: int):
    """A mapInArrow function: buckets (sorted) to the pairs of classes that are close and belong to the bucket."""
    kinds = {n: k for k, n in numbers.items()}

    def pairs_of(part: Part, s: int, total: int, earlier: list[Part], bucket: np.ndarray, g: np.ndarray, salt: np.ndarray):
        first, blocks = part.subs[s]
        w = part.width
        sub = np.uint64(((1 << (w * blocks)) - 1) << (w * first))
        rest = np.uint64(part.mask) & ~sub
        width = w * (part.blocks - blocks)
        below = np.uint64(part.mask & ((1 << (w * first)) - 1))
        above = rest & ~below
        value = (g & below) >> np.uint64(w * part.first)
        if above:
            value |= (g & above) >> np.uint64(w * (part.first + blocks))
        _, dense = np.unique(bucket, return_inverse=True)
        key = (dense.astype(np.uint64) << np.uint64(width)) | value
        order = np.argsort(key, kind="stable")
        key, g, salt, bucket = key[order], g[order], salt[order], bucket[order]
        block_of = lambda shift: (bucket >> shift) & ((1 << BLOCK_BITS) - 1)
        crossed = block_of(VALUE_BITS + BLOCK_BITS) != block_of(VALUE_BITS)
        for mask in flip_masks(width, part.threshold):
            if mask:
                wanted = key ^ mask
                up = np.flatnonzero(wanted > key)
                left, right = np.searchsorted(key, wanted[up], "left"), np.searchsorted(key, wanted[up], "right")
            else:
                up = np.arange(len(key))
                left, right = up + 1, np.searchsorted(key, key, "right")
            for k, j in ranges(left, right, block):
                i = up[k]
                x = g[i] ^ g[j]
                ok = np.bitwise_count(x) <= total
                ok &= ~crossed[i] | (salt[i] != salt[j])
                i, j, x = i[ok], j[ok], x[ok]
                keep = (x & sub) == 0
                for other in earlier:
                    keep &= np.bitwise_count(x & np.uint64(other.mask)) > other.threshold
                for f, n in part.subs[:s]:
                    keep &= (x & np.uint64(((1 << (w * n)) - 1) << (w * f))) != 0
                if keep.any():
                    yield g[i[keep]], g[j[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, "bucket", chunk):
            bucket, g = table.column("bucket").to_numpy(), table.column("g").to_numpy().view(np.uint64)
            salt = table.column("salt").to_numpy()
            tags = bucket >> (2 * BLOCK_BITS + VALUE_BITS)
            for tag in np.unique(tags):
                kind, p, s = kinds[int(tag) >> 10], (int(tag) >> 5) & 31, int(tag) & 31
                plan, at = plans[kind], tags == tag
                for a, b in pairs_of(plan.parts[p], s, plan.total, plan.parts[:p], bucket[at], g[at], salt[at]):
                    a, b = restore(a, plan.order), restore(b, plan.order)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["kind", "h_a", "h_b"])

    return run


def make_plans(classes: DataFrame, totals: dict[str, int], max_bucket: int = 2_000_000) -> dict[str, Plan]:
    """Bit order, partitions and thresholds per kind, from counts over all classes (a few thousand numbers)."""
    shape = "kind string, i int, j int, v double"
    sums = lambda f: classes.select("kind", "h").mapInPandas(f, shape).groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    moments = sums(_moments)
    width = {kind: block_width(total) for kind, total in totals.items()}
    order, rows = {}, {}
    for kind in totals:
        m = moments[moments.kind == kind]
        rows[kind] = int(m.v[m.i < 0].sum())
        both = np.zeros((64, 64))
        at = m[m.i >= 0]
        both[at.i, at.j] = both[at.j, at.i] = at.v
        order[kind] = correlated_order(both, rows[kind], width[kind])
    counts = sums(_histograms(order, width))
    plans = {}
    for number, (kind, total) in enumerate(totals.items()):
        h = np.zeros((64 // width[kind], 1 << width[kind]))
        at = counts[counts.kind == kind]
        h[at.i, at.j] = at.v
        parts = allocate(h, rows[kind], total)
        splits = {}
        for p, part in enumerate(parts):
            for s, (first, blocks) in enumerate(part.subs):
                # A bucket's rows are at most those of its rarest block.
                if all((h[b] > max_bucket).any() for b in range(first, first + blocks)):
                    b = min(range(first, first + blocks), key=lambda b: h[b].max())
                    splits |= {(tag_of(number, p, s), b, int(v)): math.ceil(h[b, v] / max_bucket) for v in np.flatnonzero(h[b] > max_bucket)}
        if len(totals) > 8 or max(splits.values(), default=1) >= 1 << BLOCK_BITS:
            raise ValueError(f"max_bucket = {max_bucket} is too small for these hashes, or there are more than eight kinds")
        plans[kind] = Plan(order[kind], parts, total, splits)
    return plans


def close_classes(classes: DataFrame, totals: dict[str, int], max_bucket: int = 2_000_000, chunk: int = 200_000, block: int = 4_000_000) -> DataFrame:
    """Pairs (kind, h_a < h_b) of different hashes that differ in at most totals[kind] bits.

    classes: distinct rows of kind and h (bigint); hashes of other kinds and nulls are passed over.
    """
    require_columns(classes, ("kind", "h"))
    classes = classes.where(F.col("h").isNotNull() & F.col("kind").isin(*totals)).select("kind", "h")
    plans = make_plans(classes, totals, max_bucket)
    numbers = {k: n for n, k in enumerate(totals)}
    copies = classes.mapInArrow(_copies(plans, numbers), "bucket bigint, g bigint, salt smallint")
    copies = copies.repartition(parallelism(classes.sparkSession), "bucket").sortWithinPartitions("bucket")
    return copies.mapInArrow(_search(plans, numbers, chunk, block), "kind string, h_a bigint, h_b bigint")


def members_of(records: DataFrame, record: str, hashes: dict[str, str]) -> DataFrame:
    """(kind, h, id) of each record's readable hashes; ``hashes`` gives the column of each kind."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{c}`").cast("bigint").alias("h")) for k, c in hashes.items()))
    rows = records.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").alias("id"), F.inline(kinds))
    return rows.where(F.col("h").isNotNull()).distinct()


def near_duplicates(records: DataFrame, record: str, hashes: dict[str, str], totals: dict[str, int], **options) -> tuple[DataFrame, DataFrame]:
    """(pairs between classes, membership) of records that are close by any of their hashes.

    pairs: kind, h_a, h_b; a class of two or more records is paired with itself. membership: kind, h, id.
    Null ids and null hashes take no part; repeated rows count once; other columns are ignored.
    """
    members = cut(members_of(records, record, hashes))
    classes = cut(members.groupBy("kind", "h").agg(F.count("*").alias("n")))
    pairs = close_classes(classes, totals, **options)
    copies = classes.where((F.col("n") > 1) & F.col("kind").isin(*totals)).select("kind", F.col("h").alias("h_a"), F.col("h").alias("h_b"))
    return pairs.unionByName(copies), members


def expand_pairs(pairs: DataFrame, members: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """Distinct pairs of records (a < b) behind pairs of classes; large classes are spread over several tasks."""
    hot = cut(hot_classes(members.groupBy("kind", "h").agg(F.count("*").alias("n")), ["kind", "h"], "n", hot_rows))
    both = pairs
    for end in ("a", "b"):
        named = members.select("kind", F.col("h").alias(f"h_{end}"), F.col("id").alias(f"__{end}"))
        both = with_members(both, named, ["kind", f"h_{end}"], f"__{end}", hot.withColumnRenamed("h", f"h_{end}"))
    both = both.where("__a <> __b")
    return both.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct()
