"""Queries of the subpackage over the project's tables, and their SQL where it can be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.llm import bpe, components, hamming, leakage, overlap, reading, sampling, splits
from cepage.plans import sql_text as Q
from cepage.session import Kept, cut
from cepage.sources.tables import held_images, held_rows, table

#: Most bits in which the hashes of two near-duplicate images differ.
NEAR = {"dhash": 4, "perceptual_hash": 6}
#: Share of the images that an epoch (year of first listing) selects, as the corpus grew; later years take the last rate.
#: Rates never rise, so that a late listing of an earlier date cannot cost an image its place even without a registry.
RATES = {2023: 0.12, 2024: 0.10}
LAST_RATE = 0.08


def _confirmed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different held images whose candidate was confirmed."""
    held = held_images(table(spark, sf_dir, "image_record"))
    confirmed = (
        table(spark, sf_dir, "review_decision")
        .where(N.folded(F.col("decision")).isin("confirmed_same_source", "confirmed_related"))
        .select(N.uuid_text(F.col("candidate_pair_id")).alias("pair"))
    )
    links = table(spark, sf_dir, "candidate").select(*(N.uuid_text(F.col(c)).alias(k) for k, c in (("pair", "candidate_pair_id"), ("a", "image_id_a"), ("b", "image_id_b"))))
    links = links.where("a <> b").join(confirmed, "pair", "left_semi")
    for end in ("a", "b"):
        links = links.join(held.withColumnRenamed("image_id", end), end, "left_semi")
    return links.select("a", "b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = components.group_links(_confirmed_links(spark, sf_dir))
    return groups.select(F.col("node").alias("image_id"), F.col("component").alias("group_id_assigned"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = held_images(table(spark, sf_dir, "image_record"), **{k: N.hash64(F.col(k)) for k in NEAR})
    pairs, members = hamming.near_duplicates(images, "image_id", {k: k for k in NEAR}, NEAR)
    return hamming.expand_pairs(pairs, members).toDF("image_id_a", "image_id_b")


def _grouped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"group_id": N.uuid_text(F.col("group_id")), "class_name": N.label(F.col("class_name")), "split": N.split_name(F.col("split"))}
    return held_images(table(spark, sf_dir, "image_record"), **fields)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Components are those of the ledger; what is torn is told by the records, so the ledger's splits don't count.
    ledger = Kept(spark, "splits", sf_dir).read()
    known = ledger if ledger is None else ledger.withColumn("split", F.lit(None).cast("string"))
    torn = splits.torn_components(_grouped_images(spark, sf_dir), "image_id", ["group_id"], "class_name", "split", known)
    return torn.where(F.col("component").startswith("group_id:")).select(F.substring_index("component", ":", -1).alias("group_id"))


def p3_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Kept(spark, "splits", sf_dir)
    assigned, ledger = splits.assign_splits(_grouped_images(spark, sf_dir), "image_id", ["group_id"], "class_name", "split", kept.read())
    kept.write(ledger)
    return assigned.select(F.col("id").alias("image_id"), "component", "class_name", "split", "status")


def _until_middle(image_record: DataFrame) -> DataFrame:
    """Rows loaded up to the middle of the time in which rows were loaded: the first of two batches."""
    t = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    ends = image_record.agg(F.min(t), F.max(t)).first()
    return image_record.where(t <= (ends[0] + ends[1]) // 2) if ends[0] is not None else image_record


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments of the first batch, of all rows after it, ledger) with images linked by group and by digest."""
    fields = {"group_id": N.uuid_text(F.col("group_id")), "digest": N.digest256(F.col("sha256")), "class_name": N.label(F.col("class_name"))}
    rows = table(spark, sf_dir, "image_record")
    earlier, ledger, assigned = None, None, None
    for batch in (_until_middle(rows), rows):
        images = held_images(batch, **fields).withColumn("split", F.lit(None).cast("string"))
        earlier = assigned
        assigned, ledger = splits.assign_splits(images, "image_id", ["group_id", "digest"], "class_name", "split", ledger)
        assigned, ledger = cut(assigned), cut(ledger)
    return earlier, assigned, ledger


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, assigned, _ = _two_batches(spark, sf_dir)
    return assigned.select(F.col("id").alias("image_id"), "component", "class_name", "split", "status")


def p3_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, assigned, _ = _two_batches(spark, sf_dir)
    return assigned.select(F.col("id").alias("image_id"), "component")


def p3_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier, assigned, _ = _two_batches(spark, sf_dir)
    both = earlier.select("id", F.col("split").alias("was")).join(assigned.select("id", "split", "status"), "id")
    moved = ~F.col("split").eqNullSafe(F.col("was")) & (F.col("status") != "quarantined") | ~F.col("status").isin("kept", "quarantined")
    return both.agg(F.count("*").alias("n_earlier"), F.count_if(moved).alias("n_moved"))


def _first_listings(image_record: DataFrame) -> DataFrame:
    rows = held_rows(image_record).select("image_id", N.label(F.col("class_name")).alias("class_name"), F.year("ingested_at").alias("year"))
    return rows.groupBy("image_id").agg(F.max("class_name").alias("class_name"), F.min("year").alias("year"))


def _epoch_rate() -> Column:
    rate = F.lit(LAST_RATE)
    for year, share in sorted(RATES.items(), reverse=True):
        rate = F.when(F.col("year") <= year, share).otherwise(rate)
    return rate


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _first_listings(table(spark, sf_dir, "image_record"))
    kept = Kept(spark, "registry", sf_dir)
    known = kept.read_all()
    new = sampling.newcomers(images, "image_id", F.col("year"), _epoch_rate(), known, stratum="class_name")
    kept.append(new)
    chosen = sampling.select_sample(kept.read_all())
    if known is not None:  # what was registered before need not be held any more
        chosen = chosen.join(images.select(F.col("image_id").alias("id")), "id", "left_semi")
    return chosen.select(F.col("id").alias("image_id"), F.col("stratum").alias("class_name"))


def p7_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "image_record")
    registry, members = None, []
    for batch in (_until_middle(rows), rows):
        new = sampling.newcomers(_first_listings(batch), "image_id", F.col("year"), _epoch_rate(), registry, stratum="class_name")
        registry = cut(new if registry is None else registry.unionByName(new))
        members.append(sampling.select_sample(registry).select("id", "first_epoch", "rate"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    earlier = registry.where(F.col("id").isNotNull())
    lost = members[0].join(members[1], ["id", "first_epoch", "rate"], "left_anti")
    return n(earlier, "n_registered").join(F.broadcast(n(lost, "n_lost")))


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = held_images(
        table(spark, sf_dir, "image_record"),
        split=N.split_name(F.col("split")),
        digest=N.digest256(F.col("sha256")),
        h=N.hash64(F.col("perceptual_hash")),
        source_dataset=F.col("source_dataset"),
    )
    return images.withColumnRenamed("image_id", "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.cross_split_overlaps(_split_records(spark, sf_dir), NEAR["perceptual_hash"])
    return found.select(F.least("eval_id", "train_id").alias("image_id_a"), F.greatest("eval_id", "train_id").alias("image_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_split_records(spark, sf_dir), ["split", "source_dataset"], NEAR["perceptual_hash"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.coverage_ranks(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_assign": p3_assign, "p3_batches": p3_batches, "p3_merges": p3_merges, "p3_stays": p3_stays, "p7_sample": p7_sample, "p7_growth": p7_growth, "p4_found": p4_found, "p4_report": p4_report, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_coverage": p10_coverage}

_HELD_SQL = f"""held AS (SELECT id, max(dh) AS dh, max(ph) AS ph, max(sha) AS sha, max(split) AS split, max(src) AS source_dataset, max(gid) AS gid FROM (
  SELECT {Q.uuid('image_id')} AS id, {Q.hash64('dhash')} AS dh, {Q.hash64('perceptual_hash')} AS ph, {Q.split('split')} AS split, source_dataset AS src,
    {Q.digest('sha256')} AS sha, {Q.uuid('group_id')} AS gid
  FROM image_record WHERE coalesce(lower(trim(validation_status)), '') <> 'deleted') WHERE id IS NOT NULL GROUP BY id)"""
_OVERLAP_SQL = f"""WITH {_HELD_SQL}, overlap AS (SELECT e.id AS eval_id, t.id AS train_id FROM held e JOIN held t ON e.split IN ('validation', 'test') AND t.split = 'train'
  AND (e.sha = t.sha OR bit_count(xor(e.ph, t.ph)) <= 6)) """

_BREAKS_SQL = "'[' || chr(13) || chr(8232) || chr(8233) || ']'"
_UNSEEN_SQL = "'[' || chr(8203) || '-' || chr(8207) || chr(8288) || chr(65279) || chr(173) || ']'"
_PROSE_SQL = f"""line AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(CASE WHEN contains(text, '<') THEN regexp_replace(text, '{reading.TAGS}', ' ', 'g') ELSE text END, {_UNSEEN_SQL}, '', 'g'),
    {_BREAKS_SQL}, chr(10), 'g'), chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  entry AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(line), '{reading.NO_LETTER}')) AS w FROM line
    WHERE NOT (regexp_matches(line, '{reading.MARKS}', 's') AND regexp_matches(line, '{reading.NO_PROSE}', 's'))) WHERE w <> '' GROUP BY ALL),
  total AS (SELECT doc_id, sum(c)::BIGINT AS n FROM entry GROUP BY doc_id HAVING sum(c) >= 15)"""

ORACLES = {
    "p10_coverage": f"""WITH {_PROSE_SQL}, ranked AS (SELECT w, rank() OVER (ORDER BY c DESC) AS g FROM (SELECT w, sum(c) AS c FROM entry JOIN total USING (doc_id) GROUP BY w)),
  upto AS (SELECT doc_id, n, g, sum(c) OVER (PARTITION BY doc_id ORDER BY g) AS seen FROM entry JOIN total USING (doc_id) JOIN ranked USING (w))
  SELECT doc_id, n AS n_words, min(g) AS coverage_rank FROM upto WHERE seen >= ceil(n * 8 / 10.0) GROUP BY ALL""",
    "p1_found": f"""WITH RECURSIVE {_HELD_SQL}, link AS (SELECT DISTINCT a, b FROM (
  SELECT {Q.uuid('candidate_pair_id')} AS pair, {Q.uuid('image_id_a')} AS a, {Q.uuid('image_id_b')} AS b FROM candidate)
  WHERE a <> b AND a IN (SELECT id FROM held) AND b IN (SELECT id FROM held) AND pair IN (SELECT {Q.uuid('candidate_pair_id')} FROM review_decision
  WHERE lower(trim(decision)) IN ('confirmed_same_source', 'confirmed_related'))),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT node AS image_id, min(other) AS group_id_assigned FROM reach GROUP BY node""",
    "p2_found": f"""WITH {_HELD_SQL} SELECT a.id AS image_id_a, b.id AS image_id_b FROM held a JOIN held b ON a.id < b.id
  AND (bit_count(xor(a.dh, b.dh)) <= 4 OR bit_count(xor(a.ph, b.ph)) <= 6)""",
    "p3_found": f"WITH {_HELD_SQL} SELECT gid AS group_id FROM held WHERE gid IS NOT NULL GROUP BY gid HAVING count(DISTINCT split) > 1",
    "p3_merges": f"""WITH RECURSIVE {_HELD_SQL}, own AS (SELECT id, list_filter(['group_id:' || gid, 'digest:' || sha], lambda x: x IS NOT NULL) AS n FROM held),
  named AS (SELECT id, CASE WHEN len(n) > 0 THEN n ELSE ['record:' || id] END AS n FROM own), edge AS (SELECT DISTINCT n[1] AS a, n[2] AS b FROM named WHERE len(n) = 2),
  both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
  cc(node, root) USING KEY (node) AS (SELECT DISTINCT unnest(n) AS node, node AS root FROM named
    UNION SELECT e.b, min(cc.root) FROM cc JOIN both_ways e ON e.a = cc.node JOIN recurring.cc AS old ON old.node = e.b WHERE cc.root < old.root GROUP BY e.b)
  SELECT id AS image_id, root AS component FROM named JOIN cc ON cc.node = n[1]""",
    "p3_stays": f"""WITH middle AS (SELECT (epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2 AS t FROM image_record)
  SELECT count(DISTINCT {Q.uuid('image_id')}) AS n_earlier, 0::BIGINT AS n_moved FROM image_record, middle WHERE epoch_us(ingested_at) <= t AND coalesce(lower(trim(validation_status)), '') <> 'deleted'""",
    "p7_growth": f"WITH {_HELD_SQL} SELECT count(*) AS n_registered, 0::BIGINT AS n_lost FROM held",
    "p4_found": _OVERLAP_SQL + "SELECT DISTINCT least(eval_id, train_id) AS image_id_a, greatest(eval_id, train_id) AS image_id_b FROM overlap",
    "p4_report": _OVERLAP_SQL + f""", near AS (SELECT e.id, ~xor(e.ph, t.ph) AS x FROM held e JOIN held t ON e.split IN ('validation', 'test') AND t.split = 'train' AND bit_count(xor(e.ph, t.ph)) <= 6),
  starts AS (SELECT id, {" & ".join(f"(x >> {k})" for k in range(8))} AS x FROM near), spans AS (SELECT id, bit_count(bit_or({" | ".join(f"((x << {k}) & 18446744073709551615::HUGEINT)" for k in range(8))})) AS covered FROM (SELECT id, x::HUGEINT AS x FROM starts) GROUP BY id),
  own AS (SELECT id, split, source_dataset, CASE WHEN sha IN (SELECT sha FROM held WHERE split = 'train' AND sha IS NOT NULL) THEN 64 ELSE covered END AS covered FROM held LEFT JOIN spans USING (id) WHERE split IN ('validation', 'test'))
  SELECT split, source_dataset, count(*) AS n_records, count(covered) AS n_overlapping, count(*) FILTER (WHERE covered = 64) AS n_whole, coalesce(sum(covered), 0)::BIGINT AS covered_places FROM own GROUP BY split, source_dataset""",
}
