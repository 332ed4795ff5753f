"""Kernels on arrays of 64-bit hashes, under their name of old."""

from cepage.functions.bits import by_bucket, flip_masks, ranges

__all__ = ["by_bucket", "flip_masks", "ranges"]
