"""Splits, importances, grid search and the comparison of feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden.functions.features import with_amount_ratio
from cardwarden.operators import evaluation as E
from cardwarden.operators.cleaning import (
    drop_identifiers, fill_constant, keep_existing, label_encode, numeric_columns, text_columns,
)
from cardwarden.operators.forest import (
    Forest, ForestParams, anomaly_score, fit_forest, grow_forest, spread, stored_nodes,
    with_decision,
)
from cardwarden.operators.profiling import contamination_of
from cardwarden.plans.quantiles import exact_quantiles
from cardwarden.plans.selection import cut_keys, hex_bucket
from cardwarden.session import scratch_folder, scratch_path, written


def stratum_quotas(df: DataFrame, label: str, test_share: float) -> DataFrame:
    """Test rows per label: the share of each stratum, largest remainders topped up to the total."""
    sizes = df.groupBy(label).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy()
    total = F.sum("rows").over(everything)
    exact = F.col("rows") * F.ceil(total * F.lit(test_share)) / total
    shares = sizes.withColumn("exact", exact).withColumns({
        "base": F.floor("exact"),
        "draws": F.ceil(F.sum("rows").over(everything) * F.lit(test_share)),
    })
    by_rest = Window.orderBy(F.desc(F.col("exact") - F.col("base")), label)
    spare = F.col("draws") - F.sum("base").over(everything)
    return shares.withColumn(
        "take", F.col("base") + (F.row_number().over(by_rest) <= spare).cast("bigint")
    ).select(label, "take")


def stratified_split(df: DataFrame, key: str, label: str = "isFraud", test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: an exact share per label, chosen by the order of a seeded digest.

    The cut digest per label comes from bucket counts, so a label holding nearly all
    rows is never sorted in one task.
    """
    hashed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    cuts = cut_keys(hashed, [label], "__h", hex_bucket(F.col("__h")),
                    stratum_quotas(df, label, test_share))
    return hashed.join(cuts, label, "left").withColumn(
        "is_test", F.coalesce(F.col("__h") <= F.col("cut_key"), F.lit(False))
    ).drop("__h", "cut_key")


def model_frame(df: DataFrame, columns: list[str] | None, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Offline model input: chosen columns, amount ratio and log, text columns as codes.

    As in the offline trainers the mean amount and the codes come from all rows.
    """
    chosen = columns or [c for c in drop_identifiers(df).columns if c not in keep]
    frame = keep_existing(df, [*keep, *[c for c in chosen if c not in keep]])
    if "TransactionAmt" in frame.columns:
        frame = with_amount_ratio(frame)
    features = [c for c in frame.columns if c not in keep]
    texts = [c for c in text_columns(frame) if c in features]
    frame = label_encode(frame, texts)
    return frame.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]), features


def train_contamination(train: DataFrame) -> float:
    return train.agg(contamination_of(F.avg("isFraud")).alias("c")).first()["c"]


QUALITY = ("model string, n_features int, trees int, sample_size bigint, auc_roc double, f1 double, "
           "precision double, recall double, tn bigint, fp bigint, fn bigint, tp bigint")


def evaluate_forest(forest: Forest, test: DataFrame, name: str) -> DataFrame:
    """AUC, F1 and confusion counts of one model on labelled rows, as one row (``QUALITY``).

    The rows are scored once; their counts per score give the area and the confusion.
    """
    spark = test.sparkSession
    inputs = spread(test.select("isFraud", *forest.features))
    scored = inputs.select("isFraud", (F.lit(forest.offset) - anomaly_score(forest)).alias("risk"))
    with scratch_folder(spark, "evaluation") as folder:
        counts = E.score_counts(scored, "risk", folder=folder)
        auc = E.area_under_roc(counts).first()["auc_roc"]
        # an anomaly lies below the offset, so its risk is above zero
        confusion = E.confusion_at(counts, F.col("score") > 0)
        m = E.classification_metrics(confusion).first()
    row = (name, len(forest.features), forest.params.trees, forest.sample_size, auc,
           m["f1"], m["precision"], m["recall"], m["tn"], m["fp"], m["fn"], m["tp"])
    return spark.createDataFrame([row], QUALITY)


DERIVED = ("amt_ratio", "log_amt")

# model name -> (feature list or all, trees, rows per tree, share of features)
MODELS = {
    "base": (None, 200, "auto", 1.0),
    "tuned": (None, 500, 2048, 0.8),
    "top_15": (C.TOP_15_FEATURES, 500, 2048, 1.0),
    "top_25": (C.TOP_25_FEATURES, 500, 2048, 1.0),
}


def compare_models(df: DataFrame, key: str, ignore: list[str],
                   models: dict[str, tuple] | None = None) -> DataFrame:
    """One result row per model: the same split and encoded rows, different columns and sizes."""
    spark, rows = df.sparkSession, []
    with scratch_folder(spark, "comparison") as folder:
        chosen = [c for c in df.columns if c not in (key, "isFraud", *ignore)]
        frame, encoded = model_frame(stratified_split(df, key), chosen, [key, "isFraud", "is_test"])
        frame = written(frame, "frame", folder)
        train, test = frame.filter(~F.col("is_test")), frame.filter("is_test")
        contamination = train_contamination(train)
        for name, (columns, trees, samples, share) in (models or MODELS).items():
            features = [c for c in encoded if columns is None or c in columns
                        or c in DERIVED and "TransactionAmt" in columns]
            params = ForestParams(trees, samples, share, contamination)
            forest = fit_forest(train, key, features, params, scratch_path(spark, "nodes", folder))
            rows += evaluate_forest(forest, test, name).collect()
    return spark.createDataFrame(rows, QUALITY)


GRID_TREES = (100, 300)
GRID_SAMPLES = ("auto", 1024, 2048)
GRID_CONTAMINATION = (0.035, 0.05, 0.08)


def grid_search(df: DataFrame, key: str, columns: list[str] = C.TOP_15_FEATURES,
                trees: tuple = GRID_TREES, samples: tuple = GRID_SAMPLES,
                contaminations: tuple = GRID_CONTAMINATION) -> DataFrame:
    """F1 per (trees, rows per tree, contamination), the best first.

    Contamination only moves the offset and a smaller forest is the first trees of
    the larger one, so one fit per sample size serves all its settings, and all
    settings of a fit are counted in one pass over the scored test rows.
    """
    spark, rows = df.sparkSession, []
    with scratch_folder(spark, "grid") as folder:
        frame, features = model_frame(stratified_split(df, key), columns, [key, "isFraud", "is_test"])
        frame = written(frame, "frame", folder)
        train = frame.filter(~F.col("is_test"))
        for position, size in enumerate(samples):
            forest = stored_nodes(grow_forest(train, key, features, ForestParams(max(trees), size)),
                                  scratch_path(spark, "nodes", folder))
            scores = {t: anomaly_score(forest, t).alias(f"s_{t}") for t in trees}
            inputs = spread(frame.select("isFraud", "is_test", *features))
            scored = written(inputs.select("isFraud", "is_test", *scores.values()), "scores", folder)
            cuts = exact_quantiles(scored.filter(~F.col("is_test")),
                                   {f"s_{t}": list(contaminations) for t in trees})
            settings = F.array(*[
                F.struct(
                    F.lit(t).alias("trees"), F.lit(c).alias("contamination"),
                    (F.col(f"s_{t}") - F.lit(cuts[f"s_{t}"][i]) < 0).cast("int").alias("predicted"))
                for t in trees for i, c in enumerate(contaminations)])
            flagged = scored.filter("is_test").select("isFraud", F.inline(settings))
            measured = E.classification_metrics(E.confusion_counts(flagged, ["trees", "contamination"]))
            rows += [(r["trees"], str(size), position, r["contamination"], r["f1"],
                      r["tn"] + r["fp"] + r["fn"] + r["tp"]) for r in measured.collect()]
    results = spark.createDataFrame(
        rows, "trees int, max_samples string, place int, contamination double, f1 double, test_rows bigint")
    return results.orderBy(
        F.desc_nulls_last("f1"), "trees", "place", "contamination").drop("place")


def feature_importance(df: DataFrame, key: str, ignore: list[str] = (), trees: int = 50,
                       depth: int = 10, seed: int = 42, top: int = 30) -> DataFrame:
    """Random-forest importances of all columns, gaps as -999 and texts as codes, ranked.

    The coded rows are written first: the fit reads them once per level of its trees.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    filled = fill_constant(drop_identifiers(df, ("TransactionID", key, *ignore)))
    texts = text_columns(filled)
    features = [c for c in numeric_columns(filled) + texts if c != "isFraud"]
    coded = label_encode(filled, texts).select(*features, F.col("isFraud").cast("double").alias("isFraud"))
    with scratch_folder(df.sparkSession, "importances") as folder:
        frame = written(coded, "coded", folder)
        vectors = VectorAssembler(inputCols=features, outputCol="features").transform(frame)
        model = RandomForestClassifier(
            labelCol="isFraud", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed,
        ).fit(vectors.select("features", "isFraud"))
    weights = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    ranked = df.sparkSession.createDataFrame(weights, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"), "feature").limit(top)
