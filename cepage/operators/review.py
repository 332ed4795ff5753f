"""Similarity evidence for close pairs, and consolidation of reviewed pairs into groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions import fingerprints as P
from cepage.functions import normalise as N
from cepage.functions import scalars as S
from cepage.operators import aggregates as A
from cepage.operators import joins as J
from cepage.operators.components import component_table, smallest_labels


def similarity_evidence(pairs: DataFrame, images: DataFrame, key: str = "origin", window: int = 11) -> DataFrame:
    """Pairs (a, b) with SSIM of their luma and cosine of their colour embeddings; images of unequal size have null SSIM."""
    side = lambda end: images.select(F.col(key).alias(end), F.struct("height", "width", "nChannels", "data").alias(f"image_{end}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ssim, cosine = [], []
            for r in batch.select(["image_a", "image_b"]).to_pylist():
                x, y = (P.to_rgb(r[k]["data"], r[k]["height"], r[k]["width"], r[k]["nChannels"]) for k in ("image_a", "image_b"))
                fits = x.shape == y.shape and min(x.shape[:2]) >= window
                ssim.append(round(P.structural_similarity(P.unit_grey(x), P.unit_grey(y), window), 10) if fits else None)
                cosine.append(round(float(np.clip(P.colour_embedding(x) @ P.colour_embedding(y), -1, 1)), 10))
            given = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*given, pa.array(ssim, pa.float64()), pa.array(cosine, pa.float64())], [*kept, "ssim", "cosine"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in pairs.dtypes), "ssim double", "cosine double"])
    return joined.select(*kept, "image_a", "image_b").mapInArrow(run, schema)


def review_template(pairs: DataFrame) -> DataFrame:
    """Pairs to be decided: what a reviewer has to fill in is empty text, and the action asked for is named."""
    blank = [F.lit("").alias(c) for c in ("decision", "reason", "reviewer", "date", "evidence", "group_id_assigned")]
    return pairs.select("*", F.lit("independent_human_review").alias("required_action"), *blank)


def evidence_report(pairs: DataFrame) -> DataFrame:
    """One row: candidates, those across classes, and by what triggered them."""
    by = lambda t: F.count_if(F.col("triggered_by") == t)
    return pairs.agg(F.count("*").alias("candidates"), F.count_if(~F.coalesce(F.col("same_class"), F.lit(False))).alias("cross_class"), by("dhash").alias("by_dhash"), by("phash").alias("by_phash"), by("dhash+phash").alias("by_both"))


def review_checks(manifest: DataFrame, candidates: DataFrame, decisions: DataFrame, allowed: list[str], fields: list[str], blocking: tuple[str, ...] = ()) -> DataFrame:
    """check, n_violations: what keeps reviewed pairs from being consolidated; all counts are 0 if nothing does.

    manifest: image_id, class_name. candidates: candidate_pair_id, image_id_a/b, class_name_a/b. decisions:
    candidate_pair_id, image_id_a/b, decision, date and ``fields``. Keys are compared as given. Of repeated candidates
    the smallest (by ends, then labels) is what decisions are held against. ``blocking`` names decisions that are
    allowed but keep the whole review open.
    """
    rest = ["image_id_a", "image_id_b", "class_name_a", "class_name_b"]
    one = candidates.groupBy("candidate_pair_id").agg(F.min(F.struct(*rest)).alias("x")).select("candidate_pair_id", *(f"x.{c}" for c in rest))
    expected = one.select("candidate_pair_id", F.col("image_id_a").alias("ea"), F.col("image_id_b").alias("eb"))
    compared = decisions.join(expected, "candidate_pair_id")
    ends = one.select(F.col("image_id_a").alias("image_id")).union(one.select("image_id_b")).distinct()
    classes = manifest.groupBy("image_id").agg(F.min("class_name").alias("c"))
    labelled = one
    for end in ("a", "b"):
        labelled = labelled.join(classes.select(F.col("image_id").alias(f"image_id_{end}"), F.col("c").alias(f"c_{end}")), f"image_id_{end}")
    extra = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    parts = {
        "repeated_images": extra(manifest, "image_id"),
        "repeated_candidates": extra(candidates, "candidate_pair_id"),
        "repeated_decisions": extra(decisions, "candidate_pair_id"),
        "coverage": count(J.coverage(candidates, decisions, "candidate_pair_id")),
        "decision_not_allowed": count(decisions.where(~F.coalesce(N.folded(F.col("decision")).isin(*allowed), F.lit(False)))),
        "blank_fields": count(A.blank_fields(decisions, "candidate_pair_id", fields)),
        "dates": count(decisions.where(~S.is_iso_date(F.col("date")))),
        "pair_identity": count(compared.where(~(F.col("image_id_a").eqNullSafe(F.col("ea")) & F.col("image_id_b").eqNullSafe(F.col("eb"))))),
        "unknown_images": count(ends.join(manifest.select("image_id"), "image_id", "left_anti")),
        "labels": count(labelled.where("not (class_name_a <=> c_a and class_name_b <=> c_b)")),
        "blocking_decisions": count(decisions.where(N.folded(F.col("decision")).isin(*blocking))) if blocking else count(decisions.limit(0)),
    }
    rows = [df.select(F.lit(k).alias("check"), F.col("n").cast("bigint").alias("n_violations")) for k, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def consolidate(manifest: DataFrame, decisions: DataFrame, grouping: list[str], namespace: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, group_id, group size; groups of more than one class) from decisions that link images of the manifest."""
    links = decisions.where(N.folded(F.col("decision")).isin(*grouping))
    labels = smallest_labels(manifest.select(F.col("image_id").alias("node")), links, "node", "image_id_a", "image_id_b")
    classes = manifest.groupBy("image_id").agg(F.min("class_name").alias("class_name"))
    groups = component_table(labels, classes, "image_id", "class_name", namespace)
    members = labels.join(groups, "root").select(F.col("node").alias("image_id"), "group_id", "size")
    return members, groups.where(F.col("classes").contains("|")).select("group_id", "size", "classes")


def consolidate_checked(manifest: DataFrame, candidates: DataFrame, decisions: DataFrame, allowed: list[str], fields: list[str], grouping: list[str], namespace: str, blocking: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(checks, groups): the groups of ``consolidate``, but no row of them as long as any check finds a violation.

    A group of more than one class is a violation too (check ``mixed_groups``).
    """
    members, torn = consolidate(manifest, decisions, grouping, namespace)
    found = review_checks(manifest, candidates, decisions, allowed, fields, blocking)
    found = found.unionByName(torn.agg(F.count("*").alias("n_violations")).select(F.lit("mixed_groups").alias("check"), "n_violations"))
    passed = found.agg(F.sum("n_violations").alias("n")).where("n = 0").select(F.lit(True).alias("__passed"))
    return found, members.join(F.broadcast(passed)).drop("__passed")


def compare_maps(maps: DataFrame, keys: list[str], seed: str, fraction: float = 0.10, window: int = 11) -> DataFrame:
    """For maps (keys, seed, shape, values) of equal keys and different seeds: ordinal correlation, SSIM and overlap
    of the top fraction, the smaller seed first."""
    pairs = J.ordered_pairs(maps, keys, seed, ["shape", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shape, a, b in zip(*(batch.column(c).to_pylist() for c in ("shape_a", "values_a", "values_b")), strict=True):
                x, y = np.array(a).reshape(shape), np.array(b).reshape(shape)
                ranks = [np.argsort(np.argsort(v.ravel(), kind="stable"), kind="stable").astype(float) for v in (x, y)]
                rho = float(np.corrcoef(*ranks)[0, 1]) if x.size > 1 else 0.0
                k = max(1, round(fraction * x.size))
                top = [set(np.argsort(-v.ravel(), kind="stable")[:k].tolist()) for v in (x, y)]
                ssim = P.structural_similarity(P.unit_range(x), P.unit_range(y), window) if x.ndim == 2 and min(x.shape) >= window else None
                out.append((rho, ssim, len(top[0] & top[1]) / len(top[0] | top[1])))
            kept = [batch.column(c) for c in (*keys, f"{seed}_a", f"{seed}_b")]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), pa.float64()) for c in cols)], [*keys, f"{seed}_a", f"{seed}_b", "spearman", "ssim", "overlap"])

    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*keys, f"{seed}_a", f"{seed}_b")), "spearman double", "ssim double", "overlap double"])
    return pairs.mapInArrow(run, schema)
