"""Queries p5 and p6: orphan references and consolidation of small files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.operators import compaction, orphans
from cepage.plans import sql_text as Q
from cepage.sources.tables import held_rows, table

#: Child table, field and the relation (set of parent keys) that it refers to.
REFERENCES = (
    ("candidate", "image_id_a", "image"),
    ("candidate", "image_id_b", "image"),
    ("predictions_test", "image_id", "image"),
    ("review_decision", "candidate_pair_id", "pair"),
)
PACK_DIMENSIONS = [compaction.Dimension("source_dataset"), compaction.Dimension("class_key"), compaction.Dimension("ingested_at", ordered=True)]


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = held_rows(table(spark, sf_dir, "image_record")).select(F.lit("image").alias("relation"), F.col("image_id").alias("ref_key"))
    pairs = table(spark, sf_dir, "candidate").select(F.lit("pair").alias("relation"), N.uuid_text(F.col("candidate_pair_id")).alias("ref_key"))
    return images.unionByName(pairs)


def _references(spark: SparkSession, sf_dir: str, dated: bool) -> DataFrame:
    def one(name: str, field: str, relation: str) -> DataFrame:
        more = [F.date_format("ingested_at", "yyyy-MM").alias("month")] if dated else []
        return table(spark, sf_dir, name).select(F.lit(relation).alias("relation"), N.uuid_text(F.col(field)).alias("ref_key"), F.lit(name).alias("child_table"), F.lit(field).alias("child_field"), *more)

    return reduce(DataFrame.unionByName, (one(*x) for x in REFERENCES))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.find_orphans(_parents(spark, sf_dir), _references(spark, sf_dir, dated=False))
    return found.select("child_table", "child_field", "ref_key")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = orphans.orphan_report(_parents(spark, sf_dir), _references(spark, sf_dir, dated=True), F.col("month"))
    return report.withColumnRenamed("period", "month")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "image_record").select("relative_path", "file_size_bytes", "source_row", "source_dataset", "class_name", "ingested_at")
    return rows.withColumns({"class_key": N.label(F.col("class_name")), "ingested_at": F.unix_micros(F.col("ingested_at").cast("timestamp"))})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = _listings(spark, sf_dir)
    return compaction.left_out(listings, compaction.compact_table(listings, PACK_DIMENSIONS))


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = compaction.compact_table(_listings(spark, sf_dir), PACK_DIMENSIONS)
    return written.groupBy("pack_id").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max(F.col("pack_offset") + F.col("bytes")).alias("pack_end"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_packs": p6_packs}


HELD_SQL = f"SELECT DISTINCT {Q.uuid('image_id')} AS image_id FROM image_record WHERE coalesce(lower(trim(validation_status)), '') <> 'deleted' AND {Q.uuid('image_id')} IS NOT NULL"
_REFS_SQL = " UNION ALL ".join(f"SELECT '{r}' AS relation, '{t}' AS child_table, '{f}' AS child_field, {Q.uuid(f)} AS ref_key, strftime(ingested_at, '%Y-%m') AS month FROM {t}" for t, f, r in REFERENCES)
_ORPHANS_SQL = f"""WITH parent AS (SELECT 'image' AS relation, image_id AS ref_key FROM ({HELD_SQL})
  UNION SELECT 'pair', {Q.uuid('candidate_pair_id')} FROM candidate WHERE {Q.uuid('candidate_pair_id')} IS NOT NULL),
refs AS ({_REFS_SQL}),
orphan AS (SELECT * FROM refs r WHERE ref_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parent p WHERE p.relation = r.relation AND p.ref_key = r.ref_key)) """

_STEPS_SQL = """list_reduce(list_transform(list_filter(string_split(replace(url_decode(replace(
  trim(relative_path, chr(32)||chr(9)||chr(10)||chr(13)), '+', '%2B')), chr(92), '/'), '/'), lambda s: s NOT IN ('', '.')), lambda s: [s]),
  lambda a, s: CASE WHEN s[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] ELSE a || s END, CAST([] AS VARCHAR[]))"""
_FILES_SQL = f"WITH f AS (SELECT source_row, file_size_bytes, array_to_string({_STEPS_SQL}, '/') AS p FROM image_record WHERE relative_path IS NOT NULL) "

ORACLES = {
    "p6_found": _FILES_SQL + "SELECT source_row FROM (SELECT source_row, min(source_row) OVER (PARTITION BY p) AS keep FROM f WHERE p <> '') WHERE source_row > keep",
    "p5_found": _ORPHANS_SQL + "SELECT DISTINCT child_table, child_field, ref_key FROM orphan",
    "p5_report": _ORPHANS_SQL + "SELECT child_table, child_field, month, count(DISTINCT ref_key) AS orphan_keys, count(*) AS orphan_rows FROM orphan GROUP BY ALL",
}
