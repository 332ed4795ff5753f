"""Queries on predictions: metrics, calibration, seeds and comparisons of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.functions import scalars as S
from cepage.operators import aggregates as A
from cepage.operators import inference as I
from cepage.operators import metrics as M
from cepage.operators import provenance as P
from cepage.plans import sql_text as Q
from cepage.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
CLASSES = 4
GROUP = ["model_name", "regime"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: What the class metrics need of a prediction.
LABELS = (*GROUP, "true_class", "predicted_class")


def predictions(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The first loaded prediction of each run and image: experiment_id, canonical image_id and the named fields.

    Only these are read and shuffled. The field p is the array of probabilities.
    """
    made = {"image_id": N.uuid_text(F.col("image_id"))} | ({"p": F.array(*(f"probability_class_{k}" for k in range(CLASSES)))} if "p" in fields else {})
    rows = table(spark, sf_dir, "predictions_test").withColumns(made).where("image_id is not null")
    first = rows.groupBy("experiment_id", "image_id").agg(F.min(F.struct("ingested_at", *fields)).alias("x"))
    return first.select("experiment_id", "image_id", *(f"x.{f}" for f in fields))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


_P = f"WITH {Q.PREDICTIONS} "
_GRID = "grid AS (SELECT DISTINCT model_name, regime, t.k::INT AS true_class, q.k::INT AS predicted_class FROM pred, range(4) t(k), range(4) q(k))"
_CM = _GRID + ", cm AS (SELECT g.*, count(p.image_id) AS n FROM grid g LEFT JOIN pred p USING (model_name, regime, true_class, predicted_class) GROUP BY ALL)"
_REPORT = _CM + """, rep AS (SELECT model_name, regime, k.k::INT AS class_id, sum(CASE WHEN true_class = k.k THEN n ELSE 0 END)::BIGINT AS support, sum(CASE WHEN predicted_class = k.k THEN n ELSE 0 END)::BIGINT AS predicted,
  sum(CASE WHEN true_class = k.k AND predicted_class = k.k THEN n ELSE 0 END)::BIGINT AS hits FROM cm, range(4) k(k) GROUP BY ALL),
  scored AS (SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * hits / nullif(predicted + support, 0), 0) AS f1 FROM rep)"""
_VALID = "probability_class_0 + probability_class_1 + probability_class_2 + probability_class_3"
_OK = f"ok AS (SELECT *, [probability_class_0, probability_class_1, probability_class_2, probability_class_3] AS p FROM pred WHERE {' AND '.join(f'probability_class_{k} IS NOT NULL AND isfinite(probability_class_{k})' for k in range(4))} AND abs({_VALID} - 1) <= 2e-5)"


@query(_P + f", {_CM} SELECT * FROM cm")
def a11_confusion(spark, sf):
    return M.confusion(predictions(spark, sf, *LABELS), GROUP, CLASSES)


@query(_P + f", {_CM} SELECT model_name, regime, true_class, " + ", ".join(f"sum(CASE WHEN predicted_class = {k} THEN n ELSE 0 END)::BIGINT AS predicted_{k}" for k in range(4)) + " FROM cm GROUP BY ALL")
def a11_confusion_wide(spark, sf):
    return M.confusion_wide(predictions(spark, sf, *LABELS), GROUP, CLASSES)


@query(_P + f", {_REPORT} SELECT model_name, regime, class_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support, hits FROM scored")
def a12_class_report(spark, sf):
    return _rounded(M.class_report(predictions(spark, sf, *LABELS), GROUP, CLASSES))


@query(_P + f""", {_REPORT} SELECT model_name, regime, sum(support)::BIGINT AS n, sum(hits)::BIGINT AS n_correct, round(sum(hits)::DOUBLE / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision,
  round(avg(recall), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM scored GROUP BY ALL""")
def a13_summary(spark, sf):
    return _rounded(M.summary(predictions(spark, sf, *LABELS), GROUP, CLASSES))


_AUC = """long AS (SELECT model_name, c.k::INT AS class_id, p[c.k + 1] AS score, true_class = c.k AS pos FROM ok, range(4) c(k)),
  rk AS (SELECT *, rank() OVER (PARTITION BY model_name, class_id ORDER BY score) + (count(*) OVER (PARTITION BY model_name, class_id, score) - 1) / 2.0::DOUBLE AS r FROM long),
  au AS (SELECT model_name, class_id, count(*) FILTER (WHERE pos) AS n_positive, count(*) FILTER (WHERE NOT pos) AS n_negative, sum(r) FILTER (WHERE pos) AS s FROM rk GROUP BY ALL),
  area AS (SELECT model_name, class_id, n_positive, n_negative, (s - n_positive * (n_positive + 1) / 2.0::DOUBLE) / nullif(n_positive * n_negative, 0)::DOUBLE AS auc FROM au)"""


def _valid(spark, sf) -> DataFrame:
    return predictions(spark, sf, "model_name", "true_class", "p").where(S.valid_probabilities(F.col("p"), CLASSES))


@query(_P + f", {_OK}, {_AUC} SELECT model_name, class_id, n_positive, n_negative, round(auc, 9) AS auc FROM area")
def a14_roc_auc(spark, sf):
    return _rounded(M.one_vs_rest_auc(_valid(spark, sf), ["model_name"], F.col("p"), CLASSES))


@query(_P + f", {_OK}, {_AUC} SELECT model_name, CASE WHEN count(auc) = 4 THEN round(avg(auc), 9) END AS macro_auc FROM area GROUP BY model_name")
def a14_macro_auc(spark, sf):
    return _rounded(M.macro_auc(_valid(spark, sf), ["model_name"], F.col("p"), CLASSES))


@query(_P + f""", {_OK} SELECT model_name, regime, count(*) AS n, round(avg(-ln(least(greatest(p[true_class + 1], 1e-12), 1))), 9) AS log_loss,
  round(avg({' + '.join(f'pow(p[{k + 1}] - CASE WHEN true_class = {k} THEN 1 ELSE 0 END, 2)' for k in range(4))}), 9) AS brier FROM ok GROUP BY ALL""")
def a15_probability_losses(spark, sf):
    return _rounded(M.probability_losses(predictions(spark, sf, *GROUP, "true_class", "p"), GROUP, F.col("p"), CLASSES))


_BIN = "len(list_filter(list_transform(range(1, 15), lambda k: k / 15.0::DOUBLE), lambda e: e <= confidence))"
_BINS = f"bins AS (SELECT model_name, regime, {_BIN}::INT AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct::INT) AS accuracy FROM pred WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL)"


@query(_P + f", {_BINS} SELECT model_name, regime, bin, n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy FROM bins")
def a17_calibration_bins(spark, sf):
    return _rounded(M.calibration_bins(predictions(spark, sf, *GROUP, "confidence", "correct"), GROUP, F.col("confidence"), F.col("correct")))


@query(_P + f", {_BINS} SELECT model_name, regime, round(sum(abs(mean_confidence - accuracy) * n) / sum(n), 9) AS ece FROM bins GROUP BY ALL")
def a17_ece(spark, sf):
    return _rounded(M.expected_calibration_error(predictions(spark, sf, *GROUP, "confidence", "correct"), GROUP, F.col("confidence"), F.col("correct")))


@query(_P + """, k AS (SELECT DISTINCT experiment_id, r.k FROM pred, range(4) r(k)), f AS (SELECT k.experiment_id, k.k, coalesce(2.0::DOUBLE * count(*) FILTER (WHERE true_class = k.k AND predicted_class = k.k) / nullif(count(*) FILTER (WHERE true_class = k.k) + count(*) FILTER (WHERE predicted_class = k.k), 0), 0) AS f1
  FROM k JOIN pred p USING (experiment_id) GROUP BY ALL) SELECT experiment_id, round(avg(f1), 9) AS macro_f1 FROM f GROUP BY experiment_id""")
def a18_macro_f1(spark, sf):
    return _rounded(M.summary(predictions(spark, sf, "true_class", "predicted_class"), ["experiment_id"], CLASSES).select("experiment_id", "macro_f1"))


@query(_P + """, e AS (SELECT model_name, regime, experiment_id, avg(correct::INT) AS accuracy FROM pred GROUP BY ALL), s AS (SELECT model_name, regime, count(*) AS n, avg(accuracy) AS mean, coalesce(stddev_samp(accuracy), 0) AS std FROM e GROUP BY ALL)
  SELECT model_name, regime, n, round(mean, 9) AS mean, round(std, 9) AS std, round(mean - 1.96 * std / sqrt(n), 9) AS ci_low, round(mean + 1.96 * std / sqrt(n), 9) AS ci_high FROM s""")
def a08_seed_summary(spark, sf):
    runs = predictions(spark, sf, *GROUP, "correct").groupBy(*GROUP, "experiment_id").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return _rounded(A.seed_summary(runs, GROUP, "accuracy"))


@query(_P + """, g AS (SELECT DISTINCT model_name, regime, seed, t.k::INT AS true_class, q.k::INT AS predicted_class FROM pred, range(4) t(k), range(4) q(k)),
  c AS (SELECT g.*, count(p.image_id) AS n FROM g LEFT JOIN pred p USING (model_name, regime, seed, true_class, predicted_class) GROUP BY ALL),
  m AS (SELECT model_name, regime, true_class, predicted_class, sum(n)::BIGINT AS total, avg(n) AS mean FROM c GROUP BY ALL)
  SELECT model_name, regime, true_class, predicted_class, total, round(mean, 9) AS mean, round(coalesce(mean / nullif(sum(mean) OVER (PARTITION BY model_name, regime, true_class), 0), 0), 9) AS share FROM m""")
def a23_mean_confusion(spark, sf):
    return _rounded(M.mean_confusion(predictions(spark, sf, *LABELS, "seed"), GROUP, "seed", CLASSES))


@query(_P + f"SELECT experiment_id, image_id, {_VALID.replace('probability', 'probability')} IS NOT NULL AND NOT isnan({_VALID}) AND abs({_VALID} - 1) <= 2e-5 AS valid FROM pred")
def p11_valid_probabilities(spark, sf):
    return predictions(spark, sf, "p").select("experiment_id", "image_id", S.valid_probabilities(F.col("p"), CLASSES).alias("valid"))


@query(_P + """, l AS (SELECT experiment_id, image_id, [probability_class_0, probability_class_1, probability_class_2, probability_class_3] AS p FROM pred WHERE isfinite(probability_class_0) AND isfinite(probability_class_1) AND isfinite(probability_class_2) AND isfinite(probability_class_3))
  SELECT experiment_id, image_id, (list_position(p, list_max(p)) - 1)::INT AS best FROM l""")
def w09_argmax(spark, sf):
    rows = predictions(spark, sf, "p").where(F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.select("experiment_id", "image_id", S.argmax_lowest(F.col("p")).alias("best"))


def comparisons(spark: SparkSession) -> DataFrame:
    """Thirty comparisons in seven families: models within a regime, regimes within a model."""
    models = ["resnet50", "vit_b_16", "swin_tiny", "yolov8n_cls"]
    regimes = ["standard_ce", "focal_loss", "weighted_sampler"]
    one = I.comparison_grid(spark, models, regimes).select("task_index", F.concat(F.lit("regime:"), "family").alias("family"), F.concat_ws("|", "left", "family").alias("left"), F.concat_ws("|", "right", "family").alias("right"))
    two = I.comparison_grid(spark, regimes, models).select((F.col("task_index") + 18).alias("task_index"), F.concat(F.lit("model:"), "family").alias("family"), F.concat_ws("|", "family", "left").alias("left"), F.concat_ws("|", "family", "right").alias("right"))
    return one.unionByName(two)


def paired_predictions(spark: SparkSession, sf_dir: str, outcome: str) -> DataFrame:
    rows = predictions(spark, sf_dir, *GROUP, "seed", outcome).withColumn("system", F.concat_ws("|", "model_name", "regime"))
    return I.paired(rows, "system", comparisons(spark), ["seed", "image_id"], outcome)


_PAIRS = """sys AS (SELECT *, model_name || '|' || regime AS s FROM pred), mo(m, i) AS (VALUES ('resnet50', 1), ('vit_b_16', 2), ('swin_tiny', 3), ('yolov8n_cls', 4)),
  re(r, i) AS (VALUES ('standard_ce', 1), ('focal_loss', 2), ('weighted_sampler', 3)),
  cmp AS (SELECT 'regime:' || r AS family, a.m || '|' || r AS l, b.m || '|' || r AS rt FROM re, mo a, mo b WHERE a.i < b.i UNION ALL SELECT 'model:' || m, m || '|' || a.r, m || '|' || b.r FROM mo, re a, re b WHERE a.i < b.i)"""
_TEST = """mc AS (SELECT family, l AS "left", rt AS "right", count(*) FILTER (WHERE a.correct AND NOT b.correct) AS left_only, count(*) FILTER (WHERE NOT a.correct AND b.correct) AS right_only
  FROM cmp JOIN sys a ON a.s = l JOIN sys b ON b.s = rt AND a.seed = b.seed AND a.image_id = b.image_id GROUP BY ALL),
  tail AS (SELECT *, left_only + right_only AS discordant FROM mc),
  pv AS (SELECT *, CASE WHEN discordant = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * CASE WHEN least(left_only, right_only) >= discordant THEN 1 ELSE (SELECT sum(exp(lgamma(discordant + 1) - lgamma(i + 1) - lgamma(discordant - i + 1) - discordant * ln(2.0::DOUBLE))) FROM range(least(left_only, right_only) + 1) z(i)) END) END AS p_value FROM tail)"""


@query(_P + f', {_PAIRS}, {_TEST} SELECT family, "left", "right", left_only, right_only, discordant, round(p_value, 9) AS p_value FROM pv')
def x10_mcnemar(spark, sf):
    return _rounded(I.mcnemar(paired_predictions(spark, sf, "correct"), ["family", "left", "right"]))


@query(_P + f""", {_PAIRS}, {_TEST}, h AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, "left", "right") + 1) * p_value AS sc, row_number() OVER (PARTITION BY family ORDER BY p_value, "left", "right") AS rn FROM pv)
  SELECT family, "left", "right", round(p_value, 9) AS p_value, round(least(1.0::DOUBLE, max(sc) OVER (PARTITION BY family ORDER BY rn)), 9) AS p_holm FROM h""")
def w05_holm(spark, sf):
    tests = I.mcnemar(paired_predictions(spark, sf, "correct"), ["family", "left", "right"])
    return _rounded(I.holm(tests, ["family"], "p_value", ["left", "right"]).select("family", "left", "right", "p_value", "p_holm"))


@query(_P + f""", {_PAIRS}, j AS (SELECT family, l, rt, seed, image_id, count(a) AS na, count(b) AS nb FROM (SELECT family, l, rt, seed, image_id, 1 AS a, NULL AS b FROM cmp JOIN sys ON s = l UNION ALL SELECT family, l, rt, seed, image_id, NULL, 1 FROM cmp JOIN sys ON s = rt) GROUP BY ALL)
  SELECT family, l AS "left", rt AS "right", count(*) AS n, count(*) FILTER (WHERE na = 0) AS missing_left, count(*) FILTER (WHERE nb = 0) AS missing_right FROM j GROUP BY ALL""")
def j03_unmatched(spark, sf):
    return I.unmatched(paired_predictions(spark, sf, "correct"), "correct", ["family", "left", "right"])


def bootstrapped(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The bootstrap of every comparison, on observations that both systems have."""
    rows = predictions(spark, sf_dir, *LABELS, "seed", "group_id").withColumn("system", F.concat_ws("|", "model_name", "regime"))
    keys = ["seed", "image_id", "true_class", "group_id"]
    pairs = I.paired(rows, "system", comparisons(spark), keys, "predicted_class").where("predicted_class_left is not null and predicted_class_right is not null and group_id is not null")
    return I.crossed_bootstrap(pairs, ["family", "left", "right"], "seed", "group_id", CLASSES, **options)


@query()
def x09_bootstrap(spark, sf):
    return bootstrapped(spark, sf)


# Names as published, in the order in which tables show them.
MODEL_LABELS = {"resnet50": "ResNet50", "vit_b_16": "ViT-B/16", "swin_tiny": "Swin-Tiny", "yolov8n_cls": "YOLOv8n-cls"}
REGIME_LABELS = {"standard_ce": "Standard CE", "focal_loss": "Focal Loss", "weighted_sampler": "Balanced CE"}


def _case(c: str, names: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {c} END"


_MEANS = ("accuracy", "macro_precision", "macro_recall", "macro_f1")


@query(_P + f""", k AS (SELECT DISTINCT model_name, regime, seed, r.k FROM pred, range(4) r(k)),
  c AS (SELECT k.model_name, k.regime, k.seed, k.k, count(*) FILTER (WHERE true_class = k.k AND predicted_class = k.k)::DOUBLE AS hit, count(*) FILTER (WHERE true_class = k.k) AS t, count(*) FILTER (WHERE predicted_class = k.k) AS p FROM k JOIN pred USING (model_name, regime, seed) GROUP BY ALL),
  e AS (SELECT model_name, regime, seed, sum(hit) / sum(t) AS accuracy, avg(coalesce(hit / nullif(p, 0), 0)) AS macro_precision, avg(coalesce(hit / nullif(t, 0), 0)) AS macro_recall, avg(coalesce(2 * hit / nullif(t + p, 0), 0)) AS macro_f1 FROM c GROUP BY ALL),
  m AS (SELECT model_name, regime, count(*) AS seeds, {", ".join(f"round(avg({c}), 9) AS {c}" for c in _MEANS)} FROM e GROUP BY ALL)
  SELECT {_case('model_name', MODEL_LABELS)} AS architecture, {_case('regime', REGIME_LABELS)} AS training_regime, seeds, {", ".join(f"printf('%.4f', {c}) AS {c}" for c in _MEANS)},
  row_number() OVER (ORDER BY {_case('model_name', MODEL_LABELS)}, {_case('regime', REGIME_LABELS)}, model_name, regime)::INT AS position FROM m""")
def x17_predictive_table(spark, sf):
    """The published table of predictive quality: means over seeds as text, in display order."""
    runs = M.summary(predictions(spark, sf, *LABELS, "seed"), [*GROUP, "seed"], CLASSES).withColumnRenamed("balanced_accuracy", "macro_recall")
    means = runs.groupBy(*GROUP).agg(F.count("*").alias("seeds"), *(F.round(F.avg(c), 9).alias(c) for c in _MEANS))
    named = means.withColumns({"architecture": S.lookup(F.col("model_name"), MODEL_LABELS), "training_regime": S.lookup(F.col("regime"), REGIME_LABELS)})
    # One row per model and regime, so a single ordering task is enough.
    order = Window.orderBy("architecture", "training_regime", *GROUP)
    return named.select("architecture", "training_regime", "seeds", *(S.fixed_text(F.col(c), 4).alias(c) for c in _MEANS), F.row_number().over(order).alias("position"))


@query("""WITH k AS (SELECT DISTINCT model_name, regime FROM run_registry), have AS (SELECT model_name, regime, count(*) AS n, bool_and(finished_at IS NOT NULL) AS done FROM run_registry WHERE seed = (SELECT min(seed) FROM run_registry) GROUP BY ALL),
  j AS (SELECT n, done FROM k LEFT JOIN have USING (model_name, regime)), r AS (SELECT count(*) AS expected, count(*) FILTER (WHERE done AND n = 1) AS completed, 0::BIGINT AS unexpected, 0::BIGINT AS forbidden FROM j)
  SELECT *, expected = completed AS passed FROM r""")
def x23_matrix_summary(spark, sf):
    runs = table(spark, sf, "run_registry")
    first = runs.join(F.broadcast(runs.agg(F.min("seed").alias("seed"))), "seed")
    return P.matrix_summary(first, runs.select(*GROUP), GROUP, F.col("finished_at").isNotNull(), F.lit(False))
