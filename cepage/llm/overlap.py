"""Overlaps between the training split and the evaluation splits, exact (digest) or near (perceptual hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.llm.expand import hot_classes, with_members
from cepage.llm.suffixes import covered_bits, shared_spans
from cepage.operators.joins import skewed_lookup
from cepage.session import cut


def _texts(records: DataFrame, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, train, digest or h; classes of equal texts; pairs of classes: h_eval, h_train, agreement)."""
    require_columns(records, ("id", "split", "digest", "h"))
    rows = records.where(F.col("id").isNotNull() & F.col("split").isin("train", "validation", "test"))
    texts = F.array(F.struct(F.col("digest"), F.lit(None).cast("bigint").alias("h")), F.struct(F.lit(None).cast("string").alias("digest"), F.col("h")))
    rows = rows.select("id", (F.col("split") == "train").alias("train"), F.inline(texts)).where("digest is not null or h is not null")
    members = cut(rows.distinct())
    sums = [F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")]
    classes = cut(members.groupBy("digest", "h").agg(*sums))
    near = shared_spans(classes, total)
    same = classes.where("in_train and in_eval and h is not null").select(F.col("h").alias("h_eval"), F.col("h").alias("h_train"), F.lit(-1).cast("bigint").alias("agreement"))
    return members, classes, near.unionByName(same)


def cross_split_overlaps(records: DataFrame, total: int = 6, hot_rows: int = 200_000) -> DataFrame:
    """Distinct (eval_id, train_id) of records in a training and an evaluation split that are the same or nearly.

    records: id, split (train, validation or test; anything else takes no part), digest (string) and h (bigint).
    Two records overlap if their digests are equal or their hashes differ in at most ``total`` bits. Null ids,
    digests and hashes match nothing; repeated rows count once; an empty table gives no rows. Members of classes
    with more than ``hot_rows`` are spread over several tasks.
    """
    members, classes, near = _texts(records, total)
    held_out, train = members.where("not train"), members.where("train")
    hot = {end: hot_classes(classes.where("h is not null"), ["h"], f"n_{end}", hot_rows) for end in ("eval", "train")}
    by_hash = near.select("h_eval", "h_train")
    for end, side in (("eval", held_out), ("train", train)):
        named = side.where("h is not null").select(F.col("id").alias(f"{end}_id"), F.col("h").alias(f"h_{end}"))
        by_hash = with_members(by_hash, named, [f"h_{end}"], f"{end}_id", hot[end].withColumnRenamed("h", f"h_{end}"))
    shared = classes.where("in_train and in_eval and digest is not null")
    by_digest = shared.select("digest")
    for end, side in (("eval", held_out), ("train", train)):
        by_digest = with_members(by_digest, side.where("digest is not null").select(F.col("id").alias(f"{end}_id"), "digest"), ["digest"], f"{end}_id", hot_classes(shared, ["digest"], f"n_{end}", hot_rows))
    pairs = ("eval_id", "train_id")
    return by_hash.select(*pairs).unionByName(by_digest.select(*pairs)).where("eval_id <> train_id").distinct()


def overlap_report(records: DataFrame, by: list[str], total: int = 6, hot_rows: int = 1_000_000) -> DataFrame:
    """Per group of evaluation records (columns ``by``): records, those with an overlap in training, those whose text
    or digest recurs there as it is, and how many of their 64 places lie in spans shared with near texts of training.

    Spans of all partners are merged per text, then looked up by its records; no pair of records is formed.
    """
    members, classes, near = _texts(records, total)
    merged = near.groupBy(F.col("h_eval").alias("h")).agg(F.bit_or(covered_bits(F.col("agreement"))).alias("spans"))
    known = cut(merged.join(classes.where("h is not null").select("h", "n_eval"), "h"))
    digests = cut(classes.where("in_train and in_eval and digest is not null").select("digest", "n_eval"))
    held_out = members.where("not train")
    covered = skewed_lookup(held_out.where("h is not null").select("id", "h"), known, "h", "n_eval", hot_rows).select("id", F.bit_count("spans").alias("covered"))
    whole = skewed_lookup(held_out.where("digest is not null").select("id", "digest"), digests, "digest", "n_eval", hot_rows).select("id", F.lit(64).alias("covered"))
    hit = covered.unionByName(whole).groupBy("id").agg(F.max("covered").alias("covered"))
    rows = records.where(F.col("id").isNotNull() & F.col("split").isin("validation", "test")).select("id", *by).distinct()
    joined = rows.join(hit, "id", "left")
    found = F.count("covered").alias("n_overlapping"), F.count_if(F.col("covered") == 64).alias("n_whole"), F.coalesce(F.sum("covered"), F.lit(0)).cast("bigint").alias("covered_places")
    return joined.groupBy(*by).agg(F.count("*").alias("n_records"), *found)
