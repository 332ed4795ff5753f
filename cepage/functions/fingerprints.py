"""Image fingerprints and comparisons as NumPy kernels, and their application to decoded images.

Resizing uses a Lanczos filter of three lobes, widened when shrinking, in double precision. Other decoders and
resizers round differently, so hashes near a threshold may differ from those of other programs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@lru_cache(maxsize=64)
def _lanczos(size: int, target: int, lobes: int = 3) -> np.ndarray:
    """Weights (target x size) of a one-dimensional Lanczos resize."""
    scale = max(size / target, 1.0)
    centre = (np.arange(target) + 0.5) * size / target
    x = (np.arange(size) + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image (rows x columns, with or without channels) resized, within 0 and 255."""
    rows, columns = _lanczos(image.shape[0], height), _lanczos(image.shape[1], width)
    return np.clip(np.tensordot(rows, np.moveaxis(np.tensordot(columns, image.astype(float), (1, 1)), 0, 1), (1, 0)), 0, 255)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image."""
    return image.astype(float) if image.ndim == 2 else image.astype(float) @ np.array([0.299, 0.587, 0.114])


def unit_grey(image: np.ndarray) -> np.ndarray:
    """Luma scaled to [0, 1]."""
    return grey(image) / 255.0


def pack_bits(bits: np.ndarray) -> int:
    """Bits in row-major order, highest first, as a signed 64-bit number."""
    return int(np.packbits(bits.ravel()[:64]).view(">i8")[0])


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 9 x 8 luma cells exceeds its right neighbour."""
    small = np.round(resize(np.round(grey(image)), 8, 9))
    return pack_bits(small[:, :-1] > small[:, 1:])


@lru_cache(maxsize=8)
def cosine_basis(size: int) -> np.ndarray:
    """The orthonormal DCT-II matrix."""
    k, n = np.arange(size)[:, None], np.arange(size)[None, :]
    basis = np.cos(np.pi * (2 * n + 1) * k / (2 * size)) * np.sqrt(2.0 / size)
    basis[0] /= np.sqrt(2.0)
    return basis


def frequency_hash(image: np.ndarray) -> int:
    """64 bits: which low frequencies of 32 x 32 luma exceed the median of all but the constant one (itself tested)."""
    basis = cosine_basis(32)
    low = (basis @ np.round(resize(np.round(grey(image)), 32, 32)) @ basis.T)[:8, :8]
    return pack_bits(low > np.median(low.ravel()[1:]))


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over all windows of ``size`` x ``size``, by cumulative sums."""
    s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]


def structural_similarity(a: np.ndarray, b: np.ndarray, window: int = 11) -> float:
    """Mean SSIM of two equal-sized maps in [0, 1] over all whole windows, with unbiased variances."""
    if a.shape != b.shape or min(a.shape) < window:
        raise ValueError("maps must share a shape of at least one window")
    n = window * window
    ma, mb = _windows(a, window) / n, _windows(b, window) / n
    bias = n / (n - 1)
    va, vb = (_windows(a * a, window) / n - ma * ma) * bias, (_windows(b * b, window) / n - mb * mb) * bias
    vab = (_windows(a * b, window) / n - ma * mb) * bias
    c1, c2 = 0.01**2, 0.03**2
    top, bottom = (2 * ma * mb + c1) * (2 * vab + c2), (ma**2 + mb**2 + c1) * (va + vb + c2)
    return float(np.clip(np.divide(top, bottom, out=np.zeros_like(top), where=bottom != 0).mean(), -1, 1))


def colour_embedding(image: np.ndarray, size: int = 32) -> np.ndarray:
    """Channels shrunk, standardised each, flattened and scaled to unit length."""
    small = np.round(resize(image, size, size)) / 255.0
    flat = (small - small.mean(axis=(0, 1))) / np.maximum(small.std(axis=(0, 1)), 1e-8)
    return flat.ravel() / max(float(np.linalg.norm(flat)), 1e-12)


def blurred(image: np.ndarray, kernel: int = 31, sigma: float = 10.0) -> np.ndarray:
    """Gaussian blur with reflected edges, for images (rows x columns x channels) in [0, 1]."""
    x = np.arange(kernel) - (kernel - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    half = kernel // 2
    padded = np.pad(np.clip(image, 0, 1), ((half, half), (half, half), *[(0, 0)] * (image.ndim - 2)), mode="reflect")
    rows = sum(w[k] * padded[k : k + image.shape[0]] for k in range(kernel))
    return sum(w[k] * rows[:, k : k + image.shape[1]] for k in range(kernel))


def scaled(image: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    """Channels of an image in [0, 1] moved by their mean and divided by their deviation."""
    return (image - np.asarray(mean)) / np.asarray(std)


def unscaled(image: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    """The inverse of ``scaled``, kept within [0, 1]."""
    return np.clip(image * np.asarray(std) + np.asarray(mean), 0, 1)


def blurred_baseline(image: np.ndarray, mean: list[float], std: list[float], kernel: int = 31, sigma: float = 10.0) -> np.ndarray:
    """The blurred counterpart of a scaled image, scaled likewise."""
    return scaled(blurred(unscaled(image, mean, std), kernel, sigma), mean, std)


def block_means(scores: np.ndarray, block: int) -> np.ndarray:
    """Means of non-overlapping blocks, row by row; the block size must divide both sides."""
    h, w = scores.shape
    if h % block or w % block:
        raise ValueError("the block size must divide the map")
    return scores.reshape(h // block, block, w // block, block).mean(axis=(1, 3)).ravel()


def ranked_blocks(scores: np.ndarray, block: int) -> np.ndarray:
    """Block numbers by mean score, highest first, ties by number."""
    return np.argsort(-block_means(scores, block), kind="stable")


def unit_range(values: np.ndarray) -> np.ndarray:
    """Values mapped to [0, 1] by their extremes; NaN and infinities count as 0."""
    clean = np.nan_to_num(np.asarray(values, float), nan=0.0, posinf=0.0, neginf=0.0)
    return (clean - clean.min()) / (clean.max() - clean.min() + 1e-12)


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels of the image source (blue, green, red) as RGB; one channel is repeated."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def fingerprint_images(images: DataFrame) -> DataFrame:
    """origin, dhash, perceptual_hash and embedding of decoded images (origin, height, width, nChannels, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [to_rgb(r["data"], r["height"], r["width"], r["nChannels"]) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("origin"), pa.array([difference_hash(x) for x in rows]), pa.array([frequency_hash(x) for x in rows]), pa.array([colour_embedding(x).tolist() for x in rows], pa.list_(pa.float64()))],
                    ["origin", "dhash", "perceptual_hash", "embedding"],
                )

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "origin string, dhash bigint, perceptual_hash bigint, embedding array<double>")


def pixel_moments(images: DataFrame) -> DataFrame:
    """Per channel (red, green, blue) of all pixels scaled to [0, 1]: count, sum and sum of squares per image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, channel, n, s, q = [], [], [], [], []
            for r in batch.to_pylist():
                x = to_rgb(r["data"], r["height"], r["width"], r["nChannels"]) / 255.0
                for c in range(3):
                    origin.append(r["origin"])
                    channel.append(c)
                    n.append(float(x[:, :, c].size))
                    s.append(float(x[:, :, c].sum()))
                    q.append(float((x[:, :, c] ** 2).sum()))
            if origin:
                yield pa.RecordBatch.from_arrays([pa.array(origin), pa.array(channel, pa.int32()), pa.array(n), pa.array(s), pa.array(q)], ["origin", "channel", "n", "s", "q"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "origin string, channel int, n double, s double, q double")
