"""Insertion and deletion curves: orders of blocks, stored or computed scores, areas and random baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions import fingerprints as P
from cepage.functions import scalars as S
from cepage.operators import windows as W

#: Scores of a batch of images (n x rows x columns x channels, in [0, 1]) for a target, one number each.
Score = Callable[[np.ndarray, int], np.ndarray]


def fractions(start: float = 0.0, stop: float = 0.5, step: float = 0.05) -> list[float]:
    """The grid of perturbed shares, both ends included."""
    return [float(x) for x in np.arange(start, stop + step / 2, step)]


def block_orders(maps: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, method, block_order) of maps (keys, shape, values): numbers of the blocks, highest mean first, ties by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = [P.ranked_blocks(np.array(v, float).reshape(s), block).tolist() for s, v in zip(batch.column("shape").to_pylist(), batch.column("values").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(["map"] * len(orders)), pa.array(orders, pa.list_(pa.int32()))], [*keys, "method", "block_order"])

    types = dict(maps.dtypes)
    return maps.select(*keys, "shape", "values").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "method string, block_order array<int>"]))


def random_orders(items: DataFrame, keys: list[str], blocks: int, trials: int = 20) -> DataFrame:
    """(keys, method, block_order): random orders of each item, named random:0, random:1, ...

    The order of a trial follows SHA-256 digests of keys, trial and block, so it is the same in any run or partition.
    """
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), "trial")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(F.sha2(F.concat(name, F.lit(":"), b.cast("string")).cast("binary"), 256).alias("h"), b.alias("b")))
    rows = items.select(*keys).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return rows.select(*keys, F.concat(F.lit("random:"), F.col("trial").cast("string")).alias("method"), F.transform(F.array_sort(drawn), lambda e: e["b"].cast("int")).alias("block_order"))


def perturbed_scores(images: DataFrame, orders: DataFrame, key: str, score: Score, block: int, grid: list[float], kernel: int = 31, sigma: float = 10.0) -> DataFrame:
    """(key, method, kind, fraction, score): scores of images of which the first blocks of an order are kept or blurred.

    images: key, target, height, width, nChannels, data. ``insertion`` starts from the blurred image and puts blocks
    back, ``deletion`` blurs them. The number of blocks is the fraction of all, rounded half to even. ``score`` runs
    in the tasks, on all steps of one curve at a time.
    """
    joined = orders.select(key, "method", "block_order").join(images.select(key, "target", "height", "width", "nChannels", "data"), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                image = P.to_rgb(r["data"], r["height"], r["width"], r["nChannels"]) / 255.0
                base = P.blurred(image, kernel, sigma)
                across = r["width"] // block
                if r["height"] % block or r["width"] % block or sorted(r["block_order"]) != list(range(across * (r["height"] // block))):
                    raise ValueError("an order must name every block of an image whose sides the block size divides")
                place = np.empty(len(r["block_order"]), int)
                place[r["block_order"]] = np.arange(len(place))
                rank = np.kron(place.reshape(-1, across), np.ones((block, block), int))
                counts = [min(len(place), round(f * len(place))) for f in grid]
                changed = [(rank < n)[:, :, None] for n in counts]
                for kind, inside, outside in (("insertion", image, base), ("deletion", base, image)):
                    scores = np.asarray(score(np.stack([np.where(c, inside, outside) for c in changed]), r["target"]), float)
                    columns = [pa.array([r[key]] * len(grid), batch.schema.field(key).type), pa.array([r["method"]] * len(grid)), pa.array([kind] * len(grid)), pa.array(grid), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, [key, "method", "kind", "fraction", "score"])

    return joined.mapInArrow(run, f"`{key}` {dict(images.dtypes)[key]}, method string, kind string, fraction double, score double")


def curve_areas(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, insertion_auc, deletion_auc) of stored scores (keys, method, kind, fraction, score).

    Areas are divided by the length of the fractions; a curve of one fraction raises. A kind that is missing is null.
    """
    areas = W.trapezoid_area(scores, [*keys, "method", "kind"], "fraction", "score", "score")
    value = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("auc"))).alias(f"{kind}_auc")
    return areas.groupBy(*keys, "method").agg(value("insertion"), value("deletion"))


def against_random(areas: DataFrame, keys: list[str]) -> DataFrame:
    """Areas of each item's maps beside the mean and deviation of its random orders (methods that begin with random:)."""
    drawn = areas.where(F.col("method").startswith("random:")).groupBy(*keys)
    sums = [f(F.col(f"{k}_auc")).alias(f"random_{k}_{n}") for k in ("insertion", "deletion") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return areas.where(~F.col("method").startswith("random:")).join(drawn.agg(F.count("*").alias("random_orders"), *sums), keys, "left")


def faithfulness_table(areas: DataFrame, by: list[str]) -> DataFrame:
    """Per group: images, and mean and sample deviation of both areas with four decimals as text."""
    sums = areas.groupBy(*by).agg(F.count("*").alias("images"), *(f(f"{k}_auc").alias(f"{k}_auc_{n}") for k in ("insertion", "deletion") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    return sums.select(*by, "images", *(S.fixed_text(F.col(c), 4).alias(c) for c in sums.columns if "_auc_" in c))
