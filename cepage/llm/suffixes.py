"""Same or near-same records across splits by suffix arrays over partitioned, concatenated texts.

A record's text is its 64 hash bits; all texts together, one after the other, are sampled at seeds (sparse suffix
arrays, since spans count only at the same place of both texts). Two texts within ``total`` bits share one seed
with no more wrong bits than the seed allows, and one stretch of that seed exactly: a suffix begins at every such
stretch, goes on to the seed's end and round to the seed's beginning. Suffixes are partitioned by seed and
stretch; each partition is a sorted suffix array of training texts, in which the suffixes of evaluation texts find
their neighbours: those that share the whole seed as a prefix, but for the allowed bits, which are flipped. The
agreement of each pair of texts gives their shared spans; those of all partners of a record are merged into its
coverage (``covered_bits``), and the exact check holds the distance against the limit.

Seeds follow the collection: their number, widths and wrong bits are chosen by dynamic programming on counted
distances, as in ``hamming``, but for pairs across the splits. So candidates grow much more slowly than the product
of both splits. Exact suffixes (no wrong bit allowed) would need spans of nine bits, each shared by one in 512 records.

Copies of one text form a class and are looked up once. Only partitions with more than ``max_bucket`` training or
evaluation suffixes are cut into blocks of each, and every pair of blocks is a partition of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.llm.bits import by_bucket, flip_masks, ranges
from cepage.llm.hamming import Part, allocate, block_width
from cepage.session import parallelism

#: Spans of fewer bits are chance agreement and cover nothing.
LEAST_SPAN = 8
_BLOCK_BITS, _VALUE_BITS = 12, 26


def covered_bits(agreement: Column, least: int = LEAST_SPAN) -> Column:
    """Of a bigint whose set bits are places where two texts agree, those in spans of at least ``least`` places."""
    starts = agreement
    for k in range(1, least):
        starts = starts.bitwiseAND(F.shiftrightunsigned(agreement, k))
    spans = starts
    for k in range(1, least):
        spans = spans.bitwiseOR(F.shiftleft(starts, k))
    return spans


@dataclass(frozen=True)
class Seeds:
    """Seeds with their wrong bits; ways: (seed, stretch, block, value) to the blocks of training and of evaluation suffixes."""

    parts: list[Part]
    total: int
    ways: dict[tuple[int, int, int, int], tuple[int, int]]


def _counts(width: int):
    """A mapInPandas function: how often each block of bits has each value, for training and for evaluation texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 64 // width, 1 << width), np.int64)
        for batch in batches:
            h = batch["h"].to_numpy().view(np.uint64)
            for side, column in enumerate(("in_train", "in_eval")):
                own = h[batch[column].to_numpy(bool)]
                for b in range(64 // width):
                    sums[side, b] += np.bincount(((own >> np.uint64(width * b)) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
        side, block, value = np.nonzero(sums)
        yield pd.DataFrame({"side": side, "block": block, "value": value, "n": sums[side, block, value]})

    return run


def choose_seeds(classes: DataFrame, total: int, max_bucket: int) -> Seeds:
    """Seeds for texts within ``total`` bits, from counts over all classes (a few thousand numbers)."""
    width = block_width(total)
    counted = classes.select("h", "in_train", "in_eval").mapInPandas(_counts(width), "side int, block int, value int, n bigint")
    table = counted.groupBy("side", "block", "value").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((2, 64 // width, 1 << width), np.int64)
    sums[table.side, table.block, table.value] = table.n
    train, held_out = (int(sums[side, 0].sum()) for side in (0, 1))
    parts = allocate(sums.sum(axis=0).astype(float), train + held_out, total, held_out, float(train) * held_out)
    ways = {}
    most = sums.max(axis=0)
    for p, part in enumerate(parts):
        for s, (first, blocks) in enumerate(part.subs):
            # A partition's rows are at most those of its rarest block.
            if all((most[b] > max_bucket).any() for b in range(first, first + blocks)):
                b = min(range(first, first + blocks), key=lambda b: most[b].max())
                for v in np.flatnonzero(most[b] > max_bucket):
                    needed = tuple(max(1, math.ceil(int(sums[side, b, v]) / max_bucket)) for side in (0, 1))
                    if max(needed) >= 1 << _BLOCK_BITS:
                        raise ValueError(f"max_bucket = {max_bucket} is too small for {int(most[b, v])} suffixes of one beginning")
                    ways[p, s, b, int(v)] = needed
    return Seeds(parts, total, ways)


def stretch_of(h: np.ndarray, part: Part, first: int, blocks: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(exact stretch, what follows it in the seed and round to its beginning, bits of the latter) of texts."""
    w = part.width
    after, before = w * (part.first + part.blocks - first - blocks), w * (first - part.first)
    mask = lambda bits: np.uint64((1 << bits) - 1)
    head = (h >> np.uint64(w * first)) & mask(w * blocks)
    rest = np.zeros(len(h), np.uint64)
    if after:
        rest |= (h >> np.uint64(w * (first + blocks))) & mask(after)
    if before:
        rest |= ((h >> np.uint64(w * part.first)) & mask(before)) << np.uint64(after)
    return head, rest, after + before


def _suffixes(seeds: Seeds):
    """A mapInArrow function: the sampled suffixes of each class, with the partition they are sorted in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            sides = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("in_train", "in_eval")]
            mixed = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for p, part in enumerate(seeds.parts):
                for s, (first, blocks) in enumerate(part.subs):
                    head, _, _ = stretch_of(h, part, first, blocks)
                    value = ((head ^ (head >> np.uint64(_VALUE_BITS)) ^ (head >> np.uint64(2 * _VALUE_BITS))) & np.uint64((1 << _VALUE_BITS) - 1)).astype(np.int64)
                    many = np.ones((2, len(h)), np.int64)
                    for (q, t, b, v), n in seeds.ways.items():
                        if (q, t) == (p, s):
                            hot = ((h >> np.uint64(part.width * b)) & np.uint64((1 << part.width) - 1)) == v
                            many[:, hot] = np.array(n)[:, None]
                    tag = (p << 5 | s) << (2 * _BLOCK_BITS + _VALUE_BITS)
                    for side in (0, 1):
                        at = np.flatnonzero(sides[side])
                        copies = many[1 - side, at]
                        row = np.repeat(at, copies)
                        other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                        own = mixed[row] % many[side, row]
                        blocks_of = (own << _BLOCK_BITS | other) if side == 0 else (other << _BLOCK_BITS | own)
                        if len(row):
                            bucket = tag | blocks_of << _VALUE_BITS | value[row]
                            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h[row].view(np.int64)), pa.array(np.full(len(row), side == 1))], ["bucket", "h", "held_out"])

    return run


def _lookup(seeds: Seeds, chunk: int, block: int):
    """A mapInArrow function: sorted partitions to pairs (evaluation text, training text, where they agree)."""

    def pairs_of(p: int, s: int, bucket: np.ndarray, h: np.ndarray, held_out: np.ndarray):
        part = seeds.parts[p]
        first, blocks = part.subs[s]
        _, rest, bits = stretch_of(h, part, first, blocks)
        exact = np.uint64(((1 << (part.width * blocks)) - 1) << (part.width * first))
        _, dense = np.unique(bucket, return_inverse=True)
        suffix = (dense.astype(np.uint64) << np.uint64(bits)) | rest
        rank = np.flatnonzero(~held_out)
        rank = rank[np.argsort(suffix[rank])]
        array, texts = suffix[rank], h[rank]
        asked, wanted = h[held_out], suffix[held_out]
        order = np.argsort(wanted)  # lookups in order stay in the cache
        asked, wanted = asked[order], wanted[order]
        for flip in flip_masks(bits, part.threshold):
            turned = wanted ^ flip
            left, right = np.searchsorted(array, turned, "left"), np.searchsorted(array, turned, "right")
            for i, j in ranges(left, right, block):
                x = asked[i] ^ texts[j]
                ok = (np.bitwise_count(x) <= seeds.total) & (x != 0) & ((x & exact) == 0)
                i, j, x = i[ok], j[ok], x[ok]
                # The first seed and stretch that are good enough keep the pair.
                keep = np.ones(len(x), bool)
                for other in seeds.parts[:p]:
                    keep &= np.bitwise_count(x & np.uint64(other.mask)) > other.threshold
                for f, n in part.subs[:s]:
                    keep &= (x & np.uint64(((1 << (part.width * n)) - 1) << (part.width * f))) != 0
                if keep.any():
                    yield asked[i[keep]], texts[j[keep]], ~x[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_bucket(batches, "bucket", chunk):
            bucket, h = table.column("bucket").to_numpy(), table.column("h").to_numpy().view(np.uint64)
            held_out = table.column("held_out").to_numpy().astype(bool)
            tags = bucket >> (2 * _BLOCK_BITS + _VALUE_BITS)
            for tag in np.unique(tags):
                at = tags == tag
                for found in pairs_of(int(tag) >> 5, int(tag) & 31, bucket[at], h[at], held_out[at]):
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in found], ["h_eval", "h_train", "agreement"])

    return run


def shared_spans(classes: DataFrame, total: int, max_bucket: int = 2_000_000, chunk: int = 200_000, block: int = 4_000_000) -> DataFrame:
    """(h_eval, h_train, agreement) of different texts within ``total`` bits (0 to 31), one held out and one in training.

    classes: distinct h (bigint) with booleans in_train and in_eval; null h take no part. The set bits of ``agreement``
    are where both texts agree. ``max_bucket`` bounds the suffixes of either split that a partition holds at once.
    """
    require_columns(classes, ("h", "in_train", "in_eval"))
    classes = classes.where(F.col("h").isNotNull()).select("h", "in_train", "in_eval")
    seeds = choose_seeds(classes, total, max_bucket)
    found = classes.mapInArrow(_suffixes(seeds), "bucket bigint, h bigint, held_out boolean")
    found = found.repartition(parallelism(classes.sparkSession), "bucket").sortWithinPartitions("bucket")
    return found.mapInArrow(_lookup(seeds, chunk, block), "h_eval bigint, h_train bigint, agreement bigint")
