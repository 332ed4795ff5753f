"""Classifier metrics over prediction tables: counts, rates, ranks, probabilities and calibration."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cepage.functions import scalars as S
from cepage.operators.windows import sums_before


def class_grid(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """All groups with all pairs of true and predicted classes."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(classes * classes - 1)), lambda k: F.struct((k / classes).cast("int").alias("true_class"), (k % classes).cast("int").alias("predicted_class")))
    return df.select(*by).distinct().select(*by, F.inline(cells))


def confusion(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Counts for every pair of classes, zeros included; rows with a null class are left out."""
    counts = df.groupBy(*by, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    grid = class_grid(df, by, classes)
    return grid.join(counts, [*by, "true_class", "predicted_class"], "left").select(*by, "true_class", "predicted_class", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """The confusion matrix with one column for each predicted class."""
    cells = (F.sum(F.when(F.col("predicted_class") == k, F.col("n")).otherwise(0)).alias(f"predicted_{k}") for k in range(classes))
    return confusion(df, by, classes).groupBy(*by, "true_class").agg(*cells)


def mean_confusion(df: DataFrame, by: list[str], over: str, classes: int) -> DataFrame:
    """Per pair of classes: the sum and mean of counts over runs (``over``), and the mean as a share of its row."""
    cells = confusion(df, [*by, over], classes).groupBy(*by, "true_class", "predicted_class").agg(F.sum("n").alias("total"), F.avg("n").alias("mean"))
    row = F.sum("mean").over(Window.partitionBy(*by, "true_class"))
    return cells.withColumn("share", F.coalesce(F.try_divide(F.col("mean"), row), F.lit(0.0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where a denominator is."""
    cells = confusion(df, by, classes)
    sides = cells.select(*by, F.inline(F.array(F.struct(F.col("true_class").alias("class_id"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")), F.struct(F.col("predicted_class").alias("class_id"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))), F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0).alias("hit"))
    sums = sides.groupBy(*by, "class_id").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), (F.sum("hit") / 2).cast("bigint").alias("hits"))
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.col("hits") * 2, F.col("predicted") + F.col("support"))
    return sums.select(*by, "class_id", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits")


def summary(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Accuracy, macro and weighted means over all classes, balanced accuracy and counts."""
    return (
        class_report(df, by, classes)
        .groupBy(*by)
        .agg(
            F.sum("support").alias("n"),
            F.sum("hits").alias("n_correct"),
            _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg("precision").alias("macro_precision"),
            F.avg("recall").alias("balanced_accuracy"),
            F.avg("f1").alias("macro_f1"),
            _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        )
    )


def roc_auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by the rank sum with average ranks on ties; null if a side is empty.

    Ties are aggregated first and ranks are running sums over distinct scores, taken by ranges of scores, so neither
    equal scores nor a large group end up in one task.
    """
    tied = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    ranked = sums_before(tied, by, score, "n", "__before").withColumn("mean_rank", F.col("__before") + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(*by).agg(F.sum("p").cast("double").alias("np"), F.sum(F.col("n") - F.col("p")).cast("double").alias("nn"), F.sum(F.col("p") * F.col("mean_rank")).alias("s"))
    auc = F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn"))
    return sums.select(*by, F.col("np").cast("bigint").alias("n_positive"), F.col("nn").cast("bigint").alias("n_negative"), auc.alias("auc"))


def one_vs_rest_auc(df: DataFrame, by: list[str], probabilities: Column, classes: int) -> DataFrame:
    """ROC-AUC of each class against the rest."""
    long = df.select(*by, "true_class", F.posexplode(probabilities).alias("class_id", "score"))
    areas = roc_auc(long, [*by, "class_id"], "score", F.col("true_class") == F.col("class_id"))
    return areas.where(F.col("class_id") < classes)


def macro_auc(df: DataFrame, by: list[str], probabilities: Column, classes: int) -> DataFrame:
    """Mean of the classes' areas; null unless all have one."""
    areas = one_vs_rest_auc(df, by, probabilities, classes)
    return areas.groupBy(*by).agg(F.when(F.count("auc") == classes, F.avg("auc")).alias("macro_auc"))


def probability_losses(df: DataFrame, by: list[str], probabilities: Column, classes: int) -> DataFrame:
    """Mean log loss and mean Brier score of rows with a valid distribution."""
    valid = df.where(S.valid_probabilities(probabilities, classes))
    return valid.groupBy(*by).agg(F.count("*").alias("n"), F.avg(S.log_loss(probabilities, F.col("true_class"))).alias("log_loss"), F.avg(S.brier(probabilities, F.col("true_class"), classes)).alias("brier"))


def calibration_bins(df: DataFrame, by: list[str], confidence: Column, correct: Column, bins: int = 15) -> DataFrame:
    """Count, mean confidence and accuracy per equal bin of [0, 1]; left-closed, the last bin closed."""
    edges = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    at = F.size(F.filter(edges, lambda e: e <= confidence))
    rows = df.where(confidence.isNotNull() & ~F.isnan(confidence)).withColumn("bin", at)
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, by: list[str], confidence: Column, correct: Column, bins: int = 15) -> DataFrame:
    """Mean gap of confidence and accuracy over bins, weighted by their share."""
    cells = calibration_bins(df, by, confidence, correct, bins)
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")
    return cells.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


