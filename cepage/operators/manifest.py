"""Building and auditing the manifest of a tree of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions import fingerprints
from cepage.functions import normalise as N
from cepage.functions import scalars as S
from cepage.functions.frames import partition_of
from cepage.operators import aggregates as A
from cepage.session import cut
from cepage.sources import files, sinks


def build_manifest(spark: SparkSession, root: str, class_ids: dict[str, int], suffixes: list[str], spec: dict, namespace: str, dataset: str = "", extensions: tuple[str, ...] = (".jpg", ".jpeg")) -> tuple[DataFrame, DataFrame]:
    """(originals, excluded variants) of the images below ``root``; the folder that holds a file is its class.

    Originals have identifiers, class, size, digest, decoded shape, hashes, sorted error codes and a status. Files
    that cannot be decoded, whose name has no identifier, whose class is unknown or whose digest or identifier
    occurs twice are invalid. Files are read twice (bytes and pixels), each by its own distributed scan.
    """
    name = F.element_at(F.split("relative_path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = files.discover(spark, root, list(extensions), content=True).select("path", "relative_path", "file_size_bytes", F.sha2("content", 256).alias("sha256"), files.image_format(F.col("content")).alias("image_format"), name.alias("filename"), stem.alias("stem"))
    found = found.withColumns({"class_name": F.element_at(F.split("relative_path", "/"), 1), "augmentation_type": S.variant_suffix(F.col("stem"), suffixes), "original_id": S.prefix_uuid(F.col("stem"))})
    excluded = found.where("augmentation_type is not null").select("relative_path", "filename", "class_name", "augmentation_type", "original_id", "file_size_bytes", "sha256")
    decoded = files.images(spark, root)
    shown = fingerprints.fingerprint_images(decoded).select("origin", "dhash", "perceptual_hash")
    shown = decoded.select("origin", "width", "height", F.when(F.col("nChannels") == 1, "L").otherwise("RGB").alias("colour_mode")).join(shown, "origin")
    key = lambda c: F.regexp_replace(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    rows = found.where("augmentation_type is null").withColumn("__at", key(F.col("path"))).join(shown.withColumn("__at", key(F.col("origin"))).drop("origin"), "__at", "left").drop("__at", "path", "augmentation_type")
    decoded_ok = F.col("width").isNotNull()
    spec_codes = S.spec_errors(F.col("width"), F.col("height"), F.col("colour_mode"), F.col("image_format"), spec)
    codes = [F.when(~decoded_ok, "decode_error"), F.when(F.col("original_id").isNull(), "invalid_or_missing_uuid"), F.when(~F.col("class_name").isin(*class_ids), "unknown_class"), F.when(decoded_ok & (spec_codes != ""), spec_codes)]
    rows = rows.withColumns({
        "image_id": S.uuid5(namespace, F.concat_ws(":", F.lit(dataset), F.coalesce("original_id", "relative_path"))),
        "class_id": S.lookup(F.col("class_name"), class_ids, F.lit(None).cast("int")),
        "validation_errors": F.array_join(F.array_compact(F.array(*codes)), ";"),
    })
    for field, code in (("sha256", "duplicate_sha256"), ("original_id", "duplicate_original_id")):
        marked = A.mark_duplicates(rows, "relative_path", F.col(field), code, "validation_errors").select("relative_path", F.col("errors").alias("__errors"))
        rows = rows.join(marked, "relative_path", "left").withColumn("validation_errors", F.coalesce("__errors", "validation_errors")).drop("__errors")
    rows = rows.withColumns({"validation_status": F.when(F.col("validation_errors") == "", "valid").otherwise("invalid"), "dhash": N.hex64(F.col("dhash")), "perceptual_hash": N.hex64(F.col("perceptual_hash")), "is_original": F.lit(True), "split": F.lit("")})
    return rows, excluded


def audit_manifest(manifest: DataFrame, digests: DataFrame, named: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(one row of checks, row errors): files that the manifest lacks, that are missing, leave the root or differ."""
    both = manifest.select("relative_path", F.col("sha256").alias("expected")).join(digests.select("relative_path", F.col("sha256").alias("actual")), "relative_path", "full")
    error = (
        F.when(~S.stays_inside(F.col("relative_path")), "leaves_root")
        .when(F.col("expected").isNull(), "not_in_manifest")
        .when(F.col("actual").isNull(), "missing_file")
        .when(F.lower("expected") != F.lower("actual"), "digest_mismatch")
    )
    errors = both.select("relative_path", error.alias("error")).where("error is not null")
    row = A.checks(manifest, named)
    counted = errors.agg(F.count("*").alias("n_errors"))
    return row.join(F.broadcast(counted)).withColumn("passed", F.col("passed") & (F.col("n_errors") == 0)), errors


def train_moments(manifest: DataFrame, images: DataFrame, path: str = "path") -> DataFrame:
    """Channel means and population deviations over all pixels of the training images; ``path`` is their full path.

    A channel without deviation raises, and so does a manifest without training images.
    """
    local = lambda c: F.regexp_replace(c, "^file:/*", "/")
    train = partition_of(manifest, "split", "train").select(local(path).alias("__p"))
    kept = fingerprints.pixel_moments(images).withColumn("__p", local("origin")).join(train, "__p", "left_semi")
    total = kept.groupBy("channel").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return A.require_spread(total.select("channel", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std")))


def require_valid(manifest: DataFrame) -> DataFrame:
    """``manifest``, after checking that no row is invalid; any invalid row raises."""
    if not manifest.where(~F.coalesce(F.col("validation_status") == "valid", F.lit(False))).isEmpty():
        raise ValueError("the manifest has invalid rows")
    return manifest


def publish_manifest(rows: DataFrame, path: str, columns: list[str], expected: dict[str, int]) -> str:
    """Write an originals manifest as twins, with the digest of its rows beside them; returns the digest.

    Invalid rows and class counts other than ``expected`` raise before anything is written; so does a second writing.
    """
    rows = cut(rows)
    require_valid(rows)
    wanted = rows.sparkSession.createDataFrame(list(expected.items()), "class_name string, n bigint")
    wrong = [r["discrepancy"] for r in A.reconcile(rows.groupBy("class_name").agg(F.count("*").alias("n")), wanted, ["class_name"]).limit(20).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    sinks.write_twins(rows, path, columns)
    digest = sinks.table_digest(rows.sparkSession.read.parquet(f"{path}/parquet"))
    rows.sparkSession.createDataFrame([(f"{path}/parquet", digest)], "path string, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/digest")
    return digest


def audit_published(spark: SparkSession, root: str, path: str, columns: list[str], expected: dict[str, int], suffixes: list[str], extensions: tuple[str, ...] = (".jpg", ".jpeg")) -> tuple[DataFrame, DataFrame]:
    """(one row of fourteen checks and ``passed``, row errors) of a published manifest held against the files below ``root``.

    Checks: row and class counts; marks of originals; no split, seed or final group yet; status; files, digests and
    variants; unique identifiers and content; twins of equal rows and columns.
    """
    text = files.text_csv(spark, f"{path}/csv", columns)
    parquet = spark.read.parquet(f"{path}/parquet")
    stem = F.regexp_replace(F.element_at(F.split("relative_path", "/"), -1), r"\.[^.]*$", "")
    have = files.digests(spark, root, list(extensions)).select("relative_path", F.col("sha256").alias("__actual"))
    both = text.join(have, "relative_path", "left")
    codes = F.array(
        F.when(~S.stays_inside(F.col("relative_path")), "leaves_root"),
        F.when(F.col("__actual").isNull(), "missing_file"),
        F.when(S.variant_suffix(stem, suffixes).isNotNull(), "variant"),
        F.when(F.lower("__actual") != F.lower("sha256"), "digest_mismatch"),
    )
    errors = cut(both.select("relative_path", F.explode(F.array_compact(codes)).alias("error")))
    none = lambda *kinds: F.count_if(F.col("error").isin(*kinds)) == 0
    kinds = errors.agg(none("missing_file", "leaves_root").alias("no_missing_files"), none("digest_mismatch").alias("no_hash_mismatches"), none("variant").alias("no_variants"))
    wanted = spark.createDataFrame(list(expected.items()), "class_name string, n bigint")
    counts = A.reconcile(text.groupBy("class_name").agg(F.count("*").alias("n")), wanted, ["class_name"]).agg((F.count("*") == 0).alias("class_counts_match"))
    repeated = A.duplicate_counts(text, {c: F.col(c) for c in ("image_id", "original_id", "sha256")}).agg((F.coalesce(F.sum("extra_members"), F.lit(0)) == 0).alias("unique_identifiers_and_content"))
    always = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    marks = text.agg(
        (F.count("*") == sum(expected.values())).alias("row_count_matches"), always(F.lower("is_original") == "true").alias("all_rows_marked_original"),
        always(F.lower("is_augmented") == "false").alias("no_rows_marked_augmented"), F.coalesce(F.bool_and(F.col("split") == ""), F.lit(True)).alias("split_is_blank"),
        F.coalesce(F.bool_and(F.col("split_seed") == ""), F.lit(True)).alias("split_seed_is_blank"), always(F.col("group_id_status") == "provisional_original_id").alias("group_id_is_provisional"),
        always(F.col("validation_status") == "valid").alias("all_validation_status_valid"), F.count("*").alias("__rows"),
    )
    twins = parquet.agg(F.count("*").alias("__twin_rows"))
    row = marks.crossJoin(twins).crossJoin(counts).crossJoin(kinds).crossJoin(repeated)  # each side is one aggregated row
    row = row.withColumn("csv_parquet_row_match", F.col("__rows") == F.col("__twin_rows")).withColumn("csv_parquet_column_match", F.lit(parquet.columns == columns)).drop("__rows", "__twin_rows")
    passed = F.lit(True)
    for c in row.columns:
        passed = passed & F.col(c)
    return row.withColumn("passed", passed), errors
