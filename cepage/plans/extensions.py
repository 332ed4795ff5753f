"""Queries beyond the surveyed operators that share their machinery: reviews, tuning, status, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.functions import scalars as S
from cepage.operators import inference as I
from cepage.operators import provenance as P
from cepage.operators import review as R
from cepage.plans import sql_text as Q
from cepage.plans.curation import _CAND, _DEC, NAMESPACE, candidates, decisions, images
from cepage.plans.evaluation import _PAIRS, _TEST, bootstrapped, paired_predictions, predictions
from cepage.sources.tables import table
from cepage.streaming import windows

QUERIES: dict = {}
ORACLES: dict = {}
ALLOWED = ["confirmed_same_source", "confirmed_related", "visually_similar_not_related", "uncertain", "rejected"]
GROUPING = ALLOWED[:2]
FIELDS = ("reason", "reviewer", "evidence")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df, digits: int = 9):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


_REVIEW = f"""{Q.IMAGES}, {_CAND}, {_DEC}, man AS (SELECT image_id, class_name FROM images WHERE image_id IS NOT NULL), cls AS (SELECT image_id, min(class_name) AS c FROM man GROUP BY image_id),
  one AS (SELECT * FROM (SELECT candidate_pair_id, image_id_a, image_id_b, {Q.label('class_name_a')} AS la, {Q.label('class_name_b')} AS lb, row_number() OVER (PARTITION BY candidate_pair_id
    ORDER BY image_id_a NULLS FIRST, image_id_b NULLS FIRST, {Q.label('class_name_a')} NULLS FIRST, {Q.label('class_name_b')} NULLS FIRST) AS rn FROM cand) WHERE rn = 1)"""
_MORE = lambda t, k: f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
_ONLY = lambda a, b: f"(SELECT count(*) FROM (SELECT candidate_pair_id FROM {a} WHERE candidate_pair_id IS NOT NULL EXCEPT SELECT candidate_pair_id FROM {b}))"
_CHECKS_SQL = {
    "repeated_images": _MORE("man", "image_id"),
    "repeated_candidates": _MORE("cand", "candidate_pair_id"),
    "repeated_decisions": _MORE("dec", "candidate_pair_id"),
    "coverage": f"SELECT {_ONLY('cand', 'dec')} + {_ONLY('dec', 'cand')}",
    "decision_not_allowed": f"SELECT count(*) FROM dec WHERE NOT coalesce(decision IN ({', '.join(map(repr, ALLOWED))}), false)",
    "blank_fields": " + ".join(f"(SELECT count(*) FROM dec WHERE coalesce(trim({f}), '') = '')" for f in FIELDS).join(("SELECT ", "")),
    "dates": "SELECT count(*) FROM dec WHERE NOT coalesce(regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(date AS DATE) IS NOT NULL, false)",
    "pair_identity": "SELECT count(*) FROM dec d JOIN one o USING (candidate_pair_id) WHERE d.image_id_a IS DISTINCT FROM o.image_id_a OR d.image_id_b IS DISTINCT FROM o.image_id_b",
    "unknown_images": "SELECT count(*) FROM (SELECT image_id_a AS e FROM one UNION SELECT image_id_b FROM one) WHERE e IS NULL OR e NOT IN (SELECT image_id FROM man)",
    "labels": "SELECT count(*) FROM one JOIN cls a ON a.image_id = image_id_a JOIN cls b ON b.image_id = image_id_b WHERE la IS DISTINCT FROM a.c OR lb IS DISTINCT FROM b.c",
    "blocking_decisions": "SELECT count(*) FROM dec WHERE decision = 'uncertain'",
}
_ALL_CHECKS = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v})::BIGINT AS n_violations" for k, v in _CHECKS_SQL.items())


def _review(spark, sf):
    """(manifest, candidates, decisions) as the review sees them."""
    manifest = images(spark, sf).where("image_id is not null").select("image_id", "class_name")
    pairs = candidates(spark, sf).withColumns({f"class_name_{e}": N.label(F.col(f"class_name_{e}")) for e in "ab"})
    return manifest, pairs, decisions(spark, sf)


def _sound_review(spark, sf):
    """The part of the review that passes all checks: first listings, candidates and decisions that agree with them."""
    manifest, pairs, said = _review(spark, sf)
    manifest = manifest.groupBy("image_id").agg(F.min("class_name").alias("class_name"))
    rest = ["image_id_a", "image_id_b", "class_name_a", "class_name_b"]
    one = pairs.groupBy("candidate_pair_id").agg(F.min(F.struct(*rest)).alias("x")).select("candidate_pair_id", *(f"x.{c}" for c in rest))
    for end in "ab":
        known = manifest.select(F.col("image_id").alias(f"image_id_{end}"), F.col("class_name").alias(f"c_{end}"))
        one = one.join(known, f"image_id_{end}").where(f"class_name_{end} <=> c_{end}").drop(f"c_{end}")
    # A link across classes would make a mixed group.
    sound = said.where(F.col("decision").isin(*ALLOWED) & (F.col("decision") != "uncertain") & S.is_iso_date(F.col("date")))
    for f in FIELDS:
        sound = sound.where(F.coalesce(F.trim(f), F.lit("")) != "")
    whole = sound.groupBy("candidate_pair_id").agg(F.min(F.struct("image_id_a", "image_id_b", "decision", "date", *FIELDS)).alias("x")).select("candidate_pair_id", "x.*")
    whole = whole.join(one.select("candidate_pair_id", F.col("image_id_a").alias("ea"), F.col("image_id_b").alias("eb"), (F.col("class_name_a") == F.col("class_name_b")).alias("same")), "candidate_pair_id")
    whole = whole.where("image_id_a <=> ea and image_id_b <=> eb and same").drop("ea", "eb", "same")
    return manifest, one.join(whole.select("candidate_pair_id"), "candidate_pair_id", "left_semi"), whole


@query(f"WITH {_REVIEW} {_ALL_CHECKS}")
def x06_review_checks(spark, sf):
    return R.review_checks(*_review(spark, sf), ALLOWED, list(FIELDS), ("uncertain",))


@query(f"""WITH {_REVIEW}, checks AS ({_ALL_CHECKS}) SELECT image_id, image_id AS group_id, 1::INT AS size FROM cls WHERE (SELECT sum(n_violations) FROM checks) = 0""")
def x06_groups(spark, sf):
    """No rows as long as the tables, which are dirty, fail any check; what a sound review gives is in x06_sound_groups."""
    return R.consolidate_checked(*_review(spark, sf), ALLOWED, list(FIELDS), GROUPING, NAMESPACE, ("uncertain",))[1]


_SOUND = " AND ".join(f"coalesce(trim({f}), '') <> ''" for f in FIELDS)


@query(f"""WITH RECURSIVE {_REVIEW}, sound AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_pair_id ORDER BY image_id_a NULLS FIRST, image_id_b NULLS FIRST, decision, date) AS rn FROM dec
    WHERE decision IN ({', '.join(map(repr, ALLOWED))}) AND decision <> 'uncertain' AND regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(date AS DATE) IS NOT NULL AND {_SOUND}) WHERE rn = 1),
  link AS (SELECT s.image_id_a AS a, s.image_id_b AS b FROM sound s JOIN one o USING (candidate_pair_id) JOIN cls x ON x.image_id = o.image_id_a JOIN cls y ON y.image_id = o.image_id_b
    WHERE s.image_id_a = o.image_id_a AND s.image_id_b = o.image_id_b AND la IS NOT DISTINCT FROM x.c AND lb IS NOT DISTINCT FROM y.c AND la = lb AND s.decision IN ('confirmed_same_source', 'confirmed_related')),
  edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT image_id AS node, image_id AS other FROM cls UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other), named AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
  sums AS (SELECT root, list_sort(list(node)) AS m, count(*)::INT AS size FROM named GROUP BY root)
  SELECT node AS image_id, CASE WHEN size = 1 THEN m[1] ELSE {Q.uuid5(NAMESPACE, "array_to_string(m, ':')")} END AS group_id, size FROM named JOIN sums USING (root)""")
def x06_sound_groups(spark, sf):
    return R.consolidate_checked(*_sound_review(spark, sf), ALLOWED, list(FIELDS), GROUPING, NAMESPACE, ("uncertain",))[1]


@query(f"""WITH {Q.PREDICTIONS}, r AS (SELECT model_name, regime, seed, avg(correct::INT) AS score, avg(1 - confidence) AS loss FROM pred WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL)
  SELECT model_name, regime, count(score) AS runs, round(avg(score), 9) AS mean_score, round(stddev_samp(score), 9) AS std_score, round(avg(loss), 9) AS mean_loss FROM r GROUP BY ALL HAVING count(score) >= 2""")
def a20_candidate_summary(spark, sf):
    return _rounded(P.candidate_summary(_journal(spark, sf), ["model_name", "regime"], "score", "loss"))


def _journal(spark, sf):
    rows = predictions(spark, sf, "model_name", "regime", "seed", "correct", "confidence").where("confidence is not null and not isnan(confidence)")
    return rows.groupBy("model_name", "regime", "seed").agg(F.avg(F.col("correct").cast("double")).alias("score"), F.avg(1 - F.col("confidence")).alias("loss"))


@query(f"""WITH {Q.PREDICTIONS}, r AS (SELECT model_name, regime, seed, avg(correct::INT) AS score, avg(1 - confidence) AS loss FROM pred WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL),
  s AS (SELECT model_name, regime, avg(score) AS m, stddev_samp(score) AS d, avg(loss) AS l FROM r GROUP BY ALL)
  SELECT model_name, regime, round(m, 9) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY m DESC, d, l, regime) AS rn FROM s) WHERE rn = 1""")
def x16_best_candidate(spark, sf):
    summary = P.candidate_summary(_journal(spark, sf), ["model_name", "regime"], "score", "loss")
    return _rounded(P.best_candidate(summary, ["model_name"], "regime"))


@query(f"""WITH {Q.PREDICTIONS}, h AS (SELECT experiment_id, count(*) >= 50 AS d FROM pred GROUP BY experiment_id)
  SELECT r.experiment_id, CASE WHEN d IS NULL THEN 'absent' WHEN d THEN 'done' ELSE 'not_done' END AS state FROM run_registry r LEFT JOIN h USING (experiment_id)""")
def x20_run_status(spark, sf):
    runs = predictions(spark, sf).groupBy("experiment_id").agg(F.count("*").alias("n"))
    return P.run_status(runs, table(spark, sf, "run_registry").select("experiment_id"), ["experiment_id"], F.col("n") >= 50)


@query("""WITH a AS (SELECT DISTINCT experiment_id, checkpoint_sha256 FROM predictions_test) SELECT coalesce(r.experiment_id, a.experiment_id) AS experiment_id,
  CASE WHEN a.checkpoint_sha256 IS NULL THEN 'missing' WHEN r.checkpoint_sha256 IS NULL THEN 'unexpected' ELSE 'different' END AS problem FROM run_registry r FULL JOIN a ON a.experiment_id = r.experiment_id
  WHERE a.checkpoint_sha256 IS NULL OR r.checkpoint_sha256 IS NULL OR lower(a.checkpoint_sha256) <> lower(r.checkpoint_sha256)""")
def p13_checkpoint_digests(spark, sf):
    given = table(spark, sf, "run_registry").select("experiment_id", "checkpoint_sha256")
    used = table(spark, sf, "predictions_test").select("experiment_id", "checkpoint_sha256").distinct()
    return P.verify_digests(given, used, "experiment_id", "checkpoint_sha256")


@query()
def x21_diagnostic_comparisons(spark, sf):
    tests = I.mcnemar(paired_predictions(spark, sf, "correct"), ["family", "left", "right"])
    adjusted = I.holm(tests, ["family"], "p_value", ["left", "right"])
    spread = bootstrapped(spark, sf, resamples=500).withColumnRenamed("p_value", "p_bootstrap")
    return adjusted.join(spread, ["family", "left", "right"]).withColumn("for_publication", F.lit(False))


@query(f"""WITH {Q.PREDICTIONS}, {_PAIRS}, {_TEST}, numbered AS (SELECT pv.*, row_number() OVER (ORDER BY CASE WHEN family LIKE 'regime:%' THEN 0 ELSE 1 END,
    CASE family WHEN 'regime:standard_ce' THEN 1 WHEN 'regime:focal_loss' THEN 2 WHEN 'regime:weighted_sampler' THEN 3 WHEN 'model:resnet50' THEN 1 WHEN 'model:vit_b_16' THEN 2 WHEN 'model:swin_tiny' THEN 3 ELSE 4 END, li, ri) - 1 AS i
    FROM pv JOIN (SELECT m || '|' || r AS "left", (SELECT count(*) FROM mo y WHERE y.i < mo.i) * 10 + re.i AS li FROM mo, re) USING ("left") JOIN (SELECT m || '|' || r AS "right", (SELECT count(*) FROM mo y WHERE y.i < mo.i) * 10 + re.i AS ri FROM mo, re) USING ("right")),
  h AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, i) + 1) * p_value AS sc, row_number() OVER (PARTITION BY family ORDER BY p_value, i) AS rn, min(i) OVER (PARTITION BY family) AS first FROM numbered)
  SELECT i::INT AS task_index, family, "left", "right", round(p_value, 9) AS p_value, round(least(1.0::DOUBLE, max(sc) OVER (PARTITION BY family ORDER BY rn)), 9) AS p_holm, dense_rank() OVER (ORDER BY first)::INT AS family_position FROM h""")
def x22_assembled_results(spark, sf):
    results = I.mcnemar(paired_predictions(spark, sf, "correct"), ["task_index", "family", "left", "right"])
    return _rounded(I.assembled(results, "task_index", "family", "p_value", []).select("task_index", "family", "left", "right", "p_value", "p_holm", "family_position"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_daily_events(spark, sf):
    sums = windows.windowed(table(spark, sf, "events"), ["event_type"])
    return sums.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
