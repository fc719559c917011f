"""Evaluation of scored rows against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden.session import written

SINGLE_CLASS = "only one class in the data"
SMALL_SAMPLE = "fewer rows than recommended"


def evaluable(df: DataFrame, warmed_up_only: bool = True, score: str = "fraud_score") -> DataFrame:
    """Rows with a score and a label; by default only those scored by a fresh model."""
    rows = df.filter(F.col(score).isNotNull() & F.col("isFraud").isNotNull())
    return rows.filter(F.col("is_warmed_up")) if warmed_up_only else rows


def with_prediction(df: DataFrame, threshold: float = C.THRESHOLD,
                    score: str = "fraud_score") -> DataFrame:
    return df.withColumn("predicted", (F.col(score) >= F.lit(threshold)).cast("int"))


def confusion_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp from ``isFraud`` and ``predicted``; one pass, also per key."""
    real, flagged = F.col("isFraud") == 1, F.col("predicted") == 1
    return df.groupBy(*(keys or [])).agg(
        F.count_if(~real & ~flagged).alias("tn"), F.count_if(~real & flagged).alias("fp"),
        F.count_if(real & ~flagged).alias("fn"), F.count_if(real & flagged).alias("tp"))


def _ratio(part: Column, whole: Column) -> Column:
    """Division that gives 0 over 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class; null when only one class occurs."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (tn + fp > 0)
    return confusion.withColumns({
        "precision": F.when(both, _ratio(tp, tp + fp)),
        "recall": F.when(both, _ratio(tp, tp + fn)),
        "f1": F.when(both, _ratio(2 * tp, 2 * tp + fp + fn)),
    })


def class_report(confusion: DataFrame) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support out of one confusion row.

    A single class has no report: no rows.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    confusion = confusion.filter((tp + fn > 0) & (tn + fp > 0))

    def entry(name, hit, false_hit, missed):
        return F.struct(
            F.lit(name).alias("class"), _ratio(hit, hit + false_hit).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + false_hit + missed).alias("f1"),
            (hit + missed).alias("support"))

    both = confusion.select(
        entry("legit", tn, fn, fp).alias("a"), entry("fraud", tp, fp, fn).alias("b"),
        (tp + fp + fn + tn).alias("total"), _ratio(tp + tn, tp + fp + fn + tn).alias("acc"))
    a, b, total = F.col("a"), F.col("b"), F.col("total")

    def mean(field, weighted):
        if not weighted:
            return (a[field] + b[field]) / 2
        return _ratio(a[field] * a["support"] + b[field] * b["support"], total)

    def average(name, weighted):
        return F.struct(
            F.lit(name).alias("class"), mean("precision", weighted).alias("precision"),
            mean("recall", weighted).alias("recall"), mean("f1", weighted).alias("f1"),
            total.alias("support"))

    accuracy = F.struct(
        F.lit("accuracy").alias("class"), F.col("acc").alias("precision"),
        F.col("acc").alias("recall"), F.col("acc").alias("f1"), total.alias("support"))
    return both.select(F.inline(F.array(
        a, b, accuracy, average("macro avg", False), average("weighted avg", True))))


def score_counts(df: DataFrame, score: str = "fraud_score", keys: list[str] | None = None,
                 folder: str | None = None) -> DataFrame:
    """(keys, score, part, positives, negatives): labels per distinct score, written once.

    The scores lie in range partitions, numbered by ``part``; however they are spread, the
    partitions are of like size.
    """
    keys = keys or []
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col("isFraud") == 1).alias("positives"),
        F.count_if(F.col("isFraud") == 0).alias("negatives"))
    return written(counts.repartitionByRange(*keys, "score").withColumn(
        "part", F.spark_partition_id()), "score-counts", folder)


def confusion_at(counts: DataFrame, flagged: Column, keys: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp from counts per score and the condition under which a score is flagged."""
    def rows(label, condition):
        return F.coalesce(F.sum(F.when(condition, F.col(label))), F.lit(0)).cast("bigint")

    return counts.groupBy(*(keys or [])).agg(
        rows("negatives", ~flagged).alias("tn"), rows("negatives", flagged).alias("fp"),
        rows("positives", ~flagged).alias("fn"), rows("positives", flagged).alias("tp"))


def area_under_roc(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The exact area from ``score_counts``: negatives below a score count, ties by half.

    The running count goes within each range partition, and then over the partitions' totals.
    """
    keys = keys or []
    p, q = F.col("positives").cast("double"), F.col("negatives").cast("double")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "part").orderBy("score").rowsBetween(*before)
    parts = (
        counts.withColumn("below", F.coalesce(F.sum(q).over(inside), F.lit(0.0)))
        .groupBy(*keys, "part").agg(
            F.sum(p * (F.col("below") + q / 2)).alias("area"), F.sum(p).alias("p"), F.sum(q).alias("q"))
    )
    across = Window.partitionBy(*keys).orderBy("part").rowsBetween(*before)
    total = parts.withColumn("before", F.coalesce(F.sum("q").over(across), F.lit(0.0))).groupBy(*keys).agg(
        F.sum(F.col("area") + F.col("p") * F.col("before")).alias("area"),
        F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return total.select(*keys, F.when(
        both, F.col("area") / (F.col("positives") * F.col("negatives"))).alias("auc_roc"))


def roc_auc(df: DataFrame, score: str = "fraud_score", keys: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties at half weight; null for a single class."""
    return area_under_roc(score_counts(df, score, keys), keys)


def evaluation_summary(df: DataFrame, threshold: float = C.THRESHOLD,
                       min_rows: int = C.MIN_EVALUATION_ROWS,
                       score: str = "fraud_score") -> DataFrame:
    """Rows, frauds, alerts, rate, mean and max score, and warnings about the sample."""
    totals = df.agg(
        F.count("*").alias("n_samples"),
        F.coalesce(F.sum("isFraud"), F.lit(0)).cast("bigint").alias("n_real_frauds"),
        F.count_if(F.col(score) >= F.lit(threshold)).alias("n_alerts"),
        F.avg("isFraud").alias("fraud_rate"), F.avg(score).alias("score_mean"),
        F.max(score).alias("score_max"))
    single = (F.col("n_real_frauds") == 0) | (F.col("n_real_frauds") == F.col("n_samples"))
    return totals.withColumns({
        "class_warning": F.when(single, F.lit(SINGLE_CLASS)),
        "sample_warning": F.when(F.col("n_samples") < min_rows, F.lit(SMALL_SAMPLE)),
    })


def model_metrics(df: DataFrame, threshold: float = C.THRESHOLD,
                  model_version: str = C.MODEL_VERSION,
                  contamination: float = C.CONTAMINATION,
                  evaluated_at: Column | None = None, score: str = "fraud_score") -> DataFrame:
    """The metrics row of one evaluation; no row when the area under the curve is undefined.

    Area and confusion counts come from one aggregation of the rows.
    """
    counts = score_counts(df, score)
    measured = classification_metrics(confusion_at(counts, F.col("score") >= F.lit(threshold)))
    auc = area_under_roc(counts).select("auc_roc").scalar()
    now = F.current_timestamp().cast("timestamp_ntz") if evaluated_at is None else evaluated_at
    return measured.select(
        now.alias("evaluated_at"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("samples_evaluated"),
        F.lit(threshold).alias("threshold"), auc.alias("auc_roc"), F.col("f1").alias("f1_score"),
        "recall", "precision", F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"), F.col("tn").alias("true_negatives"),
        F.col("fn").alias("false_negatives"), F.lit(model_version).alias("model_version"),
        F.lit(contamination).alias("contamination_rate"),
    ).filter("auc_roc is not null")
