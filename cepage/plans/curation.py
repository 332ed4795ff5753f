"""Queries on the manifest, candidates and reviews: audit, duplicates, pairs, groups, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.functions import scalars as S
from cepage.functions.frames import partition_of
from cepage.operators import aggregates as A
from cepage.operators import components as C
from cepage.operators import joins as J
from cepage.operators import windows as W
from cepage.plans import sql_text as Q
from cepage.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
# A namespace for identifiers, the image specification and the class ids of the project's tables.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
SPEC = {"width": 256, "height": 256, "mode": "RGB", "format": "JPEG"}
CLASS_IDS = {"black rot": 0, "esca": 1, "healthy": 2, "leaf blight": 3}
PROPORTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifest rows in canonical form."""
    c = F.col
    return table(spark, sf_dir, "image_record").select(
        "source_row", N.uuid_text(c("image_id")).alias("image_id"), N.uuid_text(c("original_id")).alias("original_id"), N.uuid_text(c("group_id")).alias("group_id"),
        N.label(c("class_name")).alias("class_name"), "class_id", N.digest256(c("sha256")).alias("digest"), N.split_name(c("split")).alias("split"),
        N.hash64(c("dhash")).alias("dh"), N.hash64(c("perceptual_hash")).alias("ph"), "width", "height", "colour_mode", "image_format", "validation_errors",
        N.folded(c("validation_status")).alias("status"), "source_dataset", "relative_path", "filename", "file_size_bytes", "is_original", "ingested_at",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows with canonical identifiers."""
    ids = {c: N.uuid_text(F.col(c)) for c in ("candidate_pair_id", "image_id_a", "image_id_b")}
    return table(spark, sf_dir, "candidate").withColumns(ids)


def first_candidates(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The first loaded row of each candidate pair, with the named fields only."""
    first = candidates(spark, sf_dir).groupBy("candidate_pair_id").agg(F.min(F.struct("ingested_at", *fields)).alias("x"))
    return first.select("candidate_pair_id", *(f"x.{f}" for f in fields))


def candidate_order() -> list:
    """The order in which candidates are offered: closest first."""
    return [F.least("dhash_distance", "phash_distance"), F.col("dhash_distance"), F.col("phash_distance"), F.col("candidate_pair_id")]


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows with canonical identifiers and decisions."""
    ids = {c: N.uuid_text(F.col(c)) for c in ("candidate_pair_id", "image_id_a", "image_id_b")}
    return table(spark, sf_dir, "review_decision").withColumns(ids | {"decision": N.folded(F.col("decision"))})


_CAND = f"cand AS (SELECT * EXCLUDE (candidate_pair_id, image_id_a, image_id_b), {Q.uuid('candidate_pair_id')} AS candidate_pair_id, {Q.uuid('image_id_a')} AS image_id_a, {Q.uuid('image_id_b')} AS image_id_b FROM candidate)"
_FIRST = _CAND + ", firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_pair_id ORDER BY ingested_at) AS rn FROM cand) WHERE rn = 1)"
_DEC = f"dec AS (SELECT * EXCLUDE (candidate_pair_id, image_id_a, image_id_b, decision), {Q.uuid('candidate_pair_id')} AS candidate_pair_id, {Q.uuid('image_id_a')} AS image_id_a, {Q.uuid('image_id_b')} AS image_id_b, {Q.folded('decision')} AS decision FROM review_decision)"
_I = f"WITH {Q.IMAGES} "


@query(_I + "SELECT class_name, count(*) AS n FROM images GROUP BY class_name")
def a01_class_counts(spark, sf):
    return images(spark, sf).groupBy("class_name").agg(F.count("*").alias("n"))


@query(_I + """SELECT class_name, count(*) AS n, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE coalesce(file_size_bytes, 0) <= 0) AS n_no_size,
  count(*) FILTER (WHERE split IS NULL) AS n_unsplit FROM images GROUP BY class_name""")
def a02_status_counts(spark, sf):
    c = F.col
    return images(spark, sf).groupBy("class_name").agg(F.count("*").alias("n"), F.count_if(c("status") == "valid").alias("n_valid"), F.count_if(F.coalesce(c("file_size_bytes"), F.lit(0)) <= 0).alias("n_no_size"), F.count_if(c("split").isNull()).alias("n_unsplit"))


@query(_I + """SELECT source_row, digest AS value, list_aggregate(list_sort(list_distinct(list_append(list_filter(string_split(coalesce(validation_errors, ''), ';'), lambda e: e <> ''), 'duplicate_sha256'))), 'string_agg', ';') AS errors
  FROM images WHERE digest IN (SELECT digest FROM images WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1)""")
def a03_duplicate_marks(spark, sf):
    return A.mark_duplicates(images(spark, sf), "source_row", F.col("digest"), "duplicate_sha256", "validation_errors")


@query(_I + """, long AS (SELECT 'digest' AS field, digest AS value FROM images UNION ALL SELECT 'image_id', image_id FROM images UNION ALL SELECT 'filename', filename FROM images),
  c AS (SELECT field, value, count(*) AS n FROM long WHERE value <> '' GROUP BY field, value)
  SELECT field, count(*) AS distinct_values, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS all_members, sum(n - 1)::BIGINT AS extra_members FROM c GROUP BY field""")
def a04_duplicate_rows(spark, sf):
    return A.duplicate_counts(images(spark, sf), {"digest": F.col("digest"), "image_id": F.col("image_id"), "filename": F.col("filename")})


@query(_I + "SELECT group_id, count(DISTINCT class_name) AS n_classes, count(*) AS n FROM images WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT class_name) > 1")
def a05_multiclass_groups(spark, sf):
    sums = images(spark, sf).where("group_id is not null").groupBy("group_id").agg(F.count_distinct("class_name").alias("n_classes"), F.count("*").alias("n"))
    return sums.where("n_classes > 1")


@query(_I + "SELECT group_id, min(class_name) AS class_name, count(DISTINCT image_id) AS size FROM images WHERE group_id IS NOT NULL GROUP BY group_id")
def a06_group_table(spark, sf):
    return images(spark, sf).where("group_id is not null").groupBy("group_id").agg(F.min("class_name").alias("class_name"), F.count_distinct("image_id").alias("size"))


@query(_I + "SELECT split, class_name, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM images GROUP BY split, class_name")
def a07_split_class_sizes(spark, sf):
    return images(spark, sf).groupBy("split", "class_name").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))


_VALUES = ", ".join(f"('{s}', {p}::DOUBLE)" for s, p in PROPORTIONS.items())


@query(_I + f"""SELECT class_name, split, n, round(abs(n::DOUBLE / sum(n) OVER (PARTITION BY class_name) - p) * 100, 6) AS deviation_pp
  FROM (SELECT class_name, split, count(*) AS n FROM images WHERE split IS NOT NULL AND class_name IS NOT NULL GROUP BY ALL) JOIN (VALUES {_VALUES}) AS v(split, p) USING (split)""")
def a07_split_deviations(spark, sf):
    counts = images(spark, sf).where("split is not null and class_name is not null").groupBy("class_name", "split").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.Window.partitionBy("class_name"))
    wanted = S.lookup(F.col("split"), PROPORTIONS, F.lit(0.0))
    return counts.select("class_name", "split", "n", F.round(F.abs(F.col("n") / total - wanted) * 100, 6).alias("deviation_pp"))


@query(f"""WITH RECURSIVE {Q.IMAGES}, {_CAND}, {_DEC}, node AS (SELECT DISTINCT image_id AS id FROM images WHERE image_id IS NOT NULL),
  link AS (SELECT image_id_a AS a, image_id_b AS b FROM dec WHERE decision IN ('confirmed_same_source', 'confirmed_related') AND image_id_a IN (SELECT id FROM node) AND image_id_b IN (SELECT id FROM node)),
  edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT id AS node, id AS other FROM node UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other)
  SELECT node, min(other) AS root FROM reach GROUP BY node""")
def x05_components(spark, sf):
    links = decisions(spark, sf).where(F.col("decision").isin("confirmed_same_source", "confirmed_related"))
    return C.smallest_labels(images(spark, sf).select(F.col("image_id").alias("node")), links, "node", "image_id_a", "image_id_b")


@query(f"""WITH RECURSIVE {Q.IMAGES}, {_DEC}, node AS (SELECT DISTINCT image_id AS id FROM images WHERE image_id IS NOT NULL),
  link AS (SELECT image_id_a AS a, image_id_b AS b FROM dec WHERE decision IN ('confirmed_same_source', 'confirmed_related') AND image_id_a IN (SELECT id FROM node) AND image_id_b IN (SELECT id FROM node)),
  edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT id AS node, id AS other FROM node UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
  cls AS (SELECT image_id, max(class_name) AS class_name FROM images WHERE image_id IS NOT NULL GROUP BY image_id),
  sums AS (SELECT root, list_sort(list(DISTINCT node)) AS m, count(DISTINCT node)::INT AS size, coalesce(array_to_string(list_sort(list(DISTINCT class_name) FILTER (WHERE class_name IS NOT NULL)), '|'), '') AS classes FROM roots JOIN cls ON image_id = node GROUP BY root)
  SELECT root, CASE WHEN size = 1 THEN m[1] ELSE {Q.uuid5(NAMESPACE, "array_to_string(m, ':')")} END AS group_id, size, classes FROM sums""")
def a27_component_table(spark, sf):
    classes = images(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.max("class_name").alias("class_name"))
    return C.component_table(x05_components(spark, sf), classes, "image_id", "class_name", NAMESPACE)


@query(_I + """, c AS (SELECT class_name, count(*) AS actual FROM images WHERE class_name IS NOT NULL GROUP BY class_name),
  e AS (SELECT * FROM (VALUES ('black rot', 1180), ('esca', 1383), ('healthy', 423), ('leaf blight', 1076), ('mildew', 10)) AS v(class_name, expected)),
  j AS (SELECT coalesce(c.class_name, e.class_name) AS class_name, coalesce(actual, 0)::BIGINT AS actual, coalesce(expected, 0)::BIGINT AS expected FROM c FULL JOIN e ON c.class_name = e.class_name)
  SELECT *, class_name || ': expected ' || expected || ', found ' || actual AS discrepancy FROM j WHERE actual <> expected""")
def a28_reconcile(spark, sf):
    expected = spark.createDataFrame([("black rot", 1180), ("esca", 1383), ("healthy", 423), ("leaf blight", 1076), ("mildew", 10)], "class_name string, n bigint")
    counts = images(spark, sf).where("class_name is not null").groupBy("class_name").agg(F.count("*").alias("n"))
    return A.reconcile(counts, expected, ["class_name"])


@query(_I + ", p AS (SELECT DISTINCT class_id, class_name FROM images WHERE class_id IS NOT NULL AND class_name IS NOT NULL) SELECT class_id, class_name, row_number() OVER (ORDER BY class_id, class_name) - 1 = class_id AS contiguous FROM p")
def a30_class_dictionary(spark, sf):
    return A.class_dictionary(images(spark, sf), "class_id", "class_name")


@query(_I + "SELECT source_row, CASE class_name WHEN 'black rot' THEN 0 WHEN 'esca' THEN 1 WHEN 'healthy' THEN 2 WHEN 'leaf blight' THEN 3 ELSE -1 END AS looked_up FROM images")
def p03_lookup(spark, sf):
    return images(spark, sf).select("source_row", S.lookup(F.coalesce("class_name", F.lit("")), CLASS_IDS, F.lit(-1)).alias("looked_up"))


@query(_I + "SELECT source_row, image_id FROM images WHERE split = 'validation'")
def p04_partition_filter(spark, sf):
    return partition_of(images(spark, sf), "split", "validation").select("source_row", "image_id")


@query(f"WITH {_DEC} SELECT decision, count(*) AS n, count(DISTINCT candidate_pair_id) AS n_pairs FROM dec WHERE decision IN ('confirmed_same_source', 'confirmed_related') GROUP BY decision")
def p05_grouping_decisions(spark, sf):
    kept = decisions(spark, sf).where(F.col("decision").isin("confirmed_same_source", "confirmed_related"))
    return kept.groupBy("decision").agg(F.count("*").alias("n"), F.count_distinct("candidate_pair_id").alias("n_pairs"))


@query("SELECT source_row, nullif(regexp_extract(regexp_replace(filename, '\\.[^.]*$', ''), '_(Leaf [0-9]+|[A-Z]*[.]?[A-Za-z]+ [0-9]*7)$', 1, 'i'), '') AS variant FROM image_record WHERE filename IS NOT NULL")
def p06_variants(spark, sf):
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    suffixes = ["Leaf [0-9]+", "[A-Z]*[.]?[A-Za-z]+ [0-9]*7"]
    return table(spark, sf, "image_record").where("filename is not null").select("source_row", S.variant_suffix(stem, suffixes).alias("variant"))


_DEPTHS = """list_reduce(list_transform(string_split(replace(trim(relative_path), chr(92), '/'), '/'), lambda s: [(CASE s WHEN '..' THEN -1 WHEN '' THEN 0 WHEN '.' THEN 0 ELSE 1 END)::BIGINT]),
  lambda a, s: a || [a[-1] + s[1]], [0::BIGINT])"""


@query(f"""WITH w AS (SELECT source_row, {_DEPTHS} AS d, regexp_matches(trim(relative_path), '^([/\\\\]|[A-Za-z]:)') AS rooted FROM image_record WHERE relative_path IS NOT NULL)
  SELECT source_row, list_min(d) >= 0 AND NOT rooted AS inside, list_min(d) >= 0 AND NOT rooted AND d[-1] > 0 AS inside_not_root FROM w""")
def p08_path_guard(spark, sf):
    rows = table(spark, sf, "image_record").where("relative_path is not null")
    return rows.select("source_row", S.stays_inside(F.trim("relative_path")).alias("inside"), S.stays_inside(F.trim("relative_path"), root_allowed=False).alias("inside_not_root"))


_FLAGS = """list_filter([CASE WHEN NOT same_class THEN 'cross_class' END, CASE WHEN dhash_distance <= 4 AND phash_distance <= 4 THEN 'close_on_both' END,
  CASE WHEN ssim_uniform_window >= 0.2 THEN 'high_ssim' END, CASE WHEN rgb_embedding_cosine_similarity >= 0.9 THEN 'high_cosine' END], lambda x: x IS NOT NULL)"""


@query(f"""WITH {_FIRST}, f AS (SELECT *, {_FLAGS} AS flags FROM firsts), t AS (SELECT *, CASE WHEN NOT same_class THEN 1 WHEN len(flags) > 0 THEN 2 ELSE 3 END AS tier FROM f),
  r AS (SELECT *, row_number() OVER (ORDER BY tier, rgb_embedding_cosine_similarity DESC NULLS LAST, ssim_uniform_window DESC NULLS LAST, dhash_distance NULLS FIRST, phash_distance NULLS FIRST, candidate_pair_id) AS priority,
    row_number() OVER (ORDER BY least(dhash_distance, phash_distance) NULLS FIRST, dhash_distance NULLS FIRST, phash_distance NULLS FIRST, candidate_pair_id) - 1 AS source_row FROM t)
  SELECT candidate_pair_id, tier, CASE WHEN len(flags) > 0 THEN array_to_string(flags, ';') ELSE 'threshold_only' END AS reasons, priority, CAST(source_row // 12 + 1 AS INT) AS page FROM r""")
def w01_priority_queue(spark, sf):
    c = F.col
    rules = {"cross_class": ~c("same_class"), "close_on_both": (c("dhash_distance") <= 4) & (c("phash_distance") <= 4), "high_ssim": c("ssim_uniform_window") >= 0.2, "high_cosine": c("rgb_embedding_cosine_similarity") >= 0.9}
    reasons = S.rule_flags(rules, "threshold_only")
    tier = F.when(~c("same_class"), 1).when(reasons != "threshold_only", 2).otherwise(3)
    order = [c("tier"), F.desc_nulls_last("rgb_embedding_cosine_similarity"), F.desc_nulls_last("ssim_uniform_window"), F.asc_nulls_first("dhash_distance"), F.asc_nulls_first("phash_distance"), c("candidate_pair_id")]
    ranked = first_candidates(spark, sf, "same_class", "dhash_distance", "phash_distance", "ssim_uniform_window", "rgb_embedding_cosine_similarity").select("*", tier.alias("tier"), reasons.alias("reasons"))
    # Sheets show candidates in the order in which they were offered (o01_candidate_order), not in that of their rank.
    ranked = W.global_row_number(ranked, candidate_order(), "source_row")
    ranked = W.global_row_number(ranked, order, "priority")
    return ranked.select("candidate_pair_id", "tier", "reasons", "priority", S.page_of(c("source_row") - 1, 12).alias("page"))


@query("""SELECT source_row, coalesce(list_aggregate(list_sort(list_filter([
  CASE WHEN width IS DISTINCT FROM 256 THEN 'unexpected_width:' || coalesce(width::VARCHAR, '') END, CASE WHEN height IS DISTINCT FROM 256 THEN 'unexpected_height:' || coalesce(height::VARCHAR, '') END,
  CASE WHEN colour_mode IS DISTINCT FROM 'RGB' THEN 'unexpected_mode:' || coalesce(colour_mode, '') END, CASE WHEN image_format IS DISTINCT FROM 'JPEG' THEN 'unexpected_format:' || coalesce(image_format, '') END], lambda x: x IS NOT NULL)), 'string_agg', ';'), '') AS errors FROM image_record""")
def p10_spec_errors(spark, sf):
    c = F.col
    return table(spark, sf, "image_record").select("source_row", S.spec_errors(c("width"), c("height"), c("colour_mode"), c("image_format"), SPEC).alias("errors"))


@query("SELECT date, coalesce(regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(date AS DATE) IS NOT NULL, false) AS is_iso, count(*) AS n FROM review_decision GROUP BY date")
def p12_iso_dates(spark, sf):
    return table(spark, sf, "review_decision").groupBy("date").agg(F.count("*").alias("n")).select("date", S.is_iso_date(F.col("date")).alias("is_iso"), "n")


@query(_I + """, c AS (SELECT coalesce(bool_and(coalesce(is_original, false)), true) AS all_original, coalesce(bool_and(coalesce(status = 'valid', false)), true) AS all_valid,
  coalesce(bool_and(image_id IS NOT NULL), true) AS all_named, coalesce(bool_and(source_row IS NOT NULL), true) AS all_numbered FROM images) SELECT *, all_original AND all_valid AND all_named AND all_numbered AS passed FROM c""")
def p14_checks(spark, sf):
    c = F.col
    return A.checks(images(spark, sf), {"all_original": c("is_original"), "all_valid": c("status") == "valid", "all_named": c("image_id").isNotNull(), "all_numbered": c("source_row").isNotNull()})


_BLANK_FIELDS = ("reason", "reviewer", "date", "evidence")


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, candidate_pair_id FROM review_decision WHERE coalesce(trim({f}), '') = ''" for f in _BLANK_FIELDS))
def p15_blank_metadata(spark, sf):
    return A.blank_fields(table(spark, sf, "review_decision"), "candidate_pair_id", list(_BLANK_FIELDS))


@query(f"""WITH {_FIRST}, {_DEC} SELECT d.candidate_pair_id, d.image_id_a, d.image_id_b FROM dec d JOIN firsts f USING (candidate_pair_id)
  WHERE d.image_id_a IS DISTINCT FROM f.image_id_a OR d.image_id_b IS DISTINCT FROM f.image_id_b""")
def p16_pair_identity(spark, sf):
    expected = first_candidates(spark, sf, "image_id_a", "image_id_b").select("candidate_pair_id", F.col("image_id_a").alias("ea"), F.col("image_id_b").alias("eb"))
    joined = decisions(spark, sf).join(expected, "candidate_pair_id")
    same = F.col("image_id_a").eqNullSafe(F.col("ea")) & F.col("image_id_b").eqNullSafe(F.col("eb"))
    return joined.where(~same).select("candidate_pair_id", "image_id_a", "image_id_b")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def p18_duplicate_keys(spark, sf):
    return J.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j02_many_to_one(spark, sf):
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return J.many_to_one(table(spark, sf, "orders"), customers, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("""WITH a AS (SELECT user_id, count(*) AS purchases FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id), b AS (SELECT user_id, count(*) AS others FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, purchases, others, CASE WHEN a.user_id IS NULL THEN 'right_only' WHEN b.user_id IS NULL THEN 'left_only' ELSE 'both' END AS match FROM a FULL JOIN b ON a.user_id = b.user_id""")
def j03_match_indicator(spark, sf):
    events = table(spark, sf, "events")
    ends = F.broadcast(events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")))
    marked = events.join(ends)
    one = marked.where("event_type = lo").groupBy("user_id").agg(F.count("*").alias("purchases"))
    two = marked.where("event_type = hi").groupBy("user_id").agg(F.count("*").alias("others"))
    return J.match_indicator(one, two, ["user_id"])


@query(f"WITH {Q.IMAGES}, {_CAND} SELECT candidate_pair_id, image_id_a, image_id_b, strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f') AS ingested_at FROM cand WHERE image_id_a IN (SELECT image_id FROM images) AND image_id_b IN (SELECT image_id FROM images)")
def j08_known_ends(spark, sf):
    known = images(spark, sf).select("image_id").distinct()
    rows = candidates(spark, sf).select("candidate_pair_id", "image_id_a", "image_id_b", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at"))
    for end in ("image_id_a", "image_id_b"):
        rows = rows.join(known.withColumnRenamed("image_id", end), end, "left_semi")
    return rows


@query(f"""WITH {_CAND}, {_DEC}, a AS (SELECT DISTINCT candidate_pair_id AS k FROM cand WHERE candidate_pair_id IS NOT NULL), b AS (SELECT DISTINCT candidate_pair_id AS k FROM dec WHERE candidate_pair_id IS NOT NULL)
  SELECT k AS candidate_pair_id, 'right' AS missing_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'left' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def j09_coverage(spark, sf):
    return J.coverage(candidates(spark, sf), decisions(spark, sf), "candidate_pair_id")


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS same_keys""")
def j10_same_keys(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    missing = J.coverage(orders, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
    return missing.agg((F.count("*") == 0).alias("same_keys"))


_ONE_IMAGE = "one AS (SELECT image_id, max(dh) AS dh, max(ph) AS ph FROM images WHERE image_id IS NOT NULL GROUP BY image_id)"


@query(_I + f""", {_ONE_IMAGE} SELECT a.image_id AS a, b.image_id AS b, bit_count(xor(a.dh, b.dh))::INT AS dhash_distance, bit_count(xor(a.ph, b.ph))::INT AS phash_distance,
  array_to_string(list_filter([CASE WHEN bit_count(xor(a.dh, b.dh)) <= 4 THEN 'dhash' END, CASE WHEN bit_count(xor(a.ph, b.ph)) <= 6 THEN 'phash' END], lambda x: x IS NOT NULL), '+') AS triggered_by
  FROM one a JOIN one b ON a.image_id < b.image_id AND (bit_count(xor(a.dh, b.dh)) <= 4 OR bit_count(xor(a.ph, b.ph)) <= 6)""")
def j11_hamming_pairs(spark, sf):
    one = images(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.max("dh").alias("dhash"), F.max("ph").alias("phash"))
    return J.hamming_pairs(one, "image_id", {"dhash": 4, "phash": 6})


@query(f"""WITH {Q.PREDICTIONS} SELECT a.model_name, a.regime, a.image_id, a.seed AS seed_a, b.seed AS seed_b, a.predicted_class AS predicted_class_a, b.predicted_class AS predicted_class_b
  FROM pred a JOIN pred b ON a.model_name = b.model_name AND a.regime = b.regime AND a.image_id = b.image_id AND a.seed < b.seed""")
def j12_seed_pairs(spark, sf):
    from cepage.plans.evaluation import predictions

    return J.ordered_pairs(predictions(spark, sf, "model_name", "regime", "seed", "predicted_class"), ["model_name", "regime", "image_id"], "seed", ["predicted_class"])


@query("SELECT m.model_name, r.regime, s.seed FROM (SELECT DISTINCT model_name FROM run_registry) m, (SELECT DISTINCT regime FROM run_registry) r, (SELECT DISTINCT seed FROM run_registry) s")
def j13_run_grid(spark, sf):
    runs = table(spark, sf, "run_registry")
    names = [F.broadcast(runs.select(c).distinct()) for c in ("model_name", "regime", "seed")]
    return names[0].join(names[1]).join(names[2])


@query(f"""WITH {Q.IMAGES}, {_DEC} SELECT i.source_row, coalesce(d.decision, 'missing') AS decision FROM images i LEFT JOIN (SELECT image_id_a, arg_min(decision, (ingested_at, decision)) AS decision FROM dec WHERE decision IS NOT NULL GROUP BY image_id_a) d ON i.image_id = d.image_id_a""")
def j14_first_match(spark, sf):
    right = decisions(spark, sf).where("decision is not null").select(F.col("image_id_a").alias("image_id"), "decision", "ingested_at")
    joined = J.first_match(images(spark, sf).select("source_row", "image_id"), right, ["image_id"], ["ingested_at", "decision"], "decision", "missing")
    return joined.select("source_row", "decision")


@query(f"""WITH {Q.IMAGES}, {_FIRST}, cls AS (SELECT image_id, max(class_name) AS c FROM images WHERE image_id IS NOT NULL GROUP BY image_id)
  SELECT candidate_pair_id FROM firsts f JOIN cls a ON f.image_id_a = a.image_id JOIN cls b ON f.image_id_b = b.image_id WHERE {Q.label('class_name_a')} IS DISTINCT FROM a.c OR {Q.label('class_name_b')} IS DISTINCT FROM b.c""")
def j15_label_mismatch(spark, sf):
    classes = images(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.max("class_name").alias("c"))
    rows = first_candidates(spark, sf, "image_id_a", "image_id_b", "class_name_a", "class_name_b")
    for end in ("a", "b"):
        rows = rows.join(classes.select(F.col("image_id").alias(f"image_id_{end}"), F.col("c").alias(f"c_{end}")), f"image_id_{end}")
    same = N.label(F.col("class_name_a")).eqNullSafe(F.col("c_a")) & N.label(F.col("class_name_b")).eqNullSafe(F.col("c_b"))
    return rows.where(~same).select("candidate_pair_id")


@query(f"WITH {_CAND}, e AS (SELECT image_id_a AS image_id FROM cand UNION SELECT image_id_b FROM cand) SELECT image_id FROM e WHERE image_id IS NOT NULL")
def u02_candidate_images(spark, sf):
    rows = candidates(spark, sf)
    return rows.select(F.col("image_id_a").alias("image_id")).union(rows.select("image_id_b")).where("image_id is not null").distinct()


@query(f"WITH {Q.IMAGES}, {Q.PREDICTIONS} SELECT image_id FROM images WHERE image_id IS NOT NULL INTERSECT SELECT image_id FROM pred")
def u03_predicted_images(spark, sf):
    from cepage.plans.evaluation import predictions

    return images(spark, sf).where("image_id is not null").select("image_id").intersect(predictions(spark, sf).select("image_id"))


@query(f"WITH {Q.IMAGES}, {Q.PREDICTIONS} SELECT image_id FROM pred EXCEPT SELECT image_id FROM images")
def u04_unknown_images(spark, sf):
    from cepage.plans.evaluation import predictions

    return predictions(spark, sf).select("image_id").subtract(images(spark, sf).select("image_id"))


_PAIR_NAME = "CASE WHEN image_id_a IS NOT NULL AND image_id_b IS NOT NULL THEN least(image_id_a, image_id_b) || ':' || greatest(image_id_a, image_id_b) END"


@query(f"WITH {_CAND} SELECT candidate_pair_id, ingested_at, {Q.uuid5(NAMESPACE, 'candidate_pair_id')} AS name_id, {Q.uuid5(NAMESPACE, _PAIR_NAME)} AS pair_id FROM cand")
def f02_uuid5(spark, sf):
    ids = candidates(spark, sf)
    return ids.select("candidate_pair_id", "ingested_at", S.uuid5(NAMESPACE, F.col("candidate_pair_id")).alias("name_id"), S.pair_id(NAMESPACE, F.col("image_id_a"), F.col("image_id_b")).alias("pair_id"))


@query("SELECT experiment_id, substr(sha256(experiment_id), 1, 20) AS short_id, CAST(concat('0x', substr(sha256(experiment_id), 1, 16)) AS UBIGINT)::VARCHAR AS seed FROM run_registry")
def f07_seeds(spark, sf):
    runs = table(spark, sf, "run_registry")
    return runs.select("experiment_id", S.short_id(F.col("experiment_id")).alias("short_id"), S.seed64(F.col("experiment_id")).cast("string").alias("seed"))


@query(f"""WITH {_FIRST} SELECT candidate_pair_id, row_number() OVER (ORDER BY least(dhash_distance, phash_distance) NULLS FIRST, dhash_distance NULLS FIRST, phash_distance NULLS FIRST, candidate_pair_id) AS position FROM firsts""")
def o01_candidate_order(spark, sf):
    rows = first_candidates(spark, sf, "dhash_distance", "phash_distance")
    return W.global_row_number(rows, candidate_order(), "position").select("candidate_pair_id", "position")


@query(_I + "SELECT source_row, class_name, round(1.0::DOUBLE / count(*) OVER (PARTITION BY class_name), 12) AS weight FROM images WHERE class_name IS NOT NULL")
def w10_class_weights(spark, sf):
    weighted = W.inverse_frequency(images(spark, sf).where("class_name is not null").select("source_row", "class_name"), "class_name")
    return weighted.select("source_row", "class_name", F.round("weight", 12).alias("weight"))


@query(_I + """, one AS (SELECT image_id, max(class_name) AS class_name FROM images WHERE image_id IS NOT NULL GROUP BY image_id HAVING max(class_name) IS NOT NULL),
  r AS (SELECT class_name, image_id, sha256('1729:' || image_id) AS h, row_number() OVER (PARTITION BY class_name ORDER BY sha256('1729:' || image_id)) AS rn FROM one)
  SELECT class_name, image_id, h, row_number() OVER (ORDER BY class_name, h, image_id)::INT AS selection_order FROM r WHERE rn <= 10""")
def x12_stratified_sample(spark, sf):
    one = images(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.max("class_name").alias("class_name"))
    return W.stratified_sample(one, "class_name", "image_id", 10, 1729)
