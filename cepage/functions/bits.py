"""Kernels on arrays of 64-bit hashes that the searches share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa


def flip_masks(bits: int, errors: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``errors`` bits set, the empty one first."""
    return np.array([sum(1 << k for k in c) for e in range(errors + 1) for c in combinations(range(bits), e)], np.uint64)


def ranges(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, i) with left[k] <= i < right[k], in blocks of about ``most`` pairs."""
    n = right - left
    rows = np.flatnonzero(n > 0)
    ends = np.cumsum(n[rows])
    at = 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        k, c = rows[at:to], n[rows[at:to]]
        starts = np.cumsum(c) - c
        # One row may exceed a block by itself; it is cut into stretches.
        if to == at + 1 and c[0] > most:
            for s in range(0, int(c[0]), most):
                m = min(most, int(c[0]) - s)
                yield np.full(m, k[0]), left[k[0]] + s + np.arange(m)
        else:
            yield np.repeat(k, c), np.arange(int(c.sum())) - np.repeat(starts - left[k], c)
        at = to


def by_bucket(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole buckets (equal ``key``) of sorted batches, each of at least ``most`` rows or the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and rows >= most:
            cut = int(np.searchsorted(keys, held[-1].column(key)[-1].as_py(), "right"))
            if cut < len(keys):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
