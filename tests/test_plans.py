"""Rank selection and quantiles against brute force, with hot values and many distinct values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwarden.operators import cleaning
from cardwarden.operators.cleaning import label_encode
from cardwarden.operators.evaluation import (
    area_under_roc, class_report, classification_metrics, evaluation_summary, model_metrics, roc_auc,
    score_counts,
)
from cardwarden.operators.model_selection import stratified_split
from cardwarden.operators.profiling import correlation_matrix
from cardwarden.plans import quantiles
from cardwarden.plans.quantiles import column_sketches, exact_quantiles
from cardwarden.plans.selection import (
    cut_keys, first_rows, last_rows, latest_per_key, long_bucket, recent_per_key, sequence_numbers,
)

PROBS = [0.0, 0.035, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["spread", "hot", "two_ends", "heavy_tail"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(7)
    n = 50_000
    v = rng.random(n) * 100
    if kind == "hot":
        v[: n // 3] = 42.0
    elif kind == "two_ends":
        v = np.r_[np.zeros(n // 2 - 50), np.ones(n // 2 - 50), rng.random(100)]
    elif kind == "heavy_tail":
        v = np.exp(rng.normal(0, 6, n))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").union(
        spark.sql("select cast(null as double)"))
    df = df.withColumn("w", -F.col("v")).persist()
    got = exact_quantiles(df, {"v": PROBS, "w": [0.5]})
    assert np.allclose(got["v"], np.quantile(v, PROBS), rtol=1e-12, atol=1e-12)
    assert np.allclose(got["w"], np.quantile(-v, [0.5]), rtol=1e-12, atol=1e-12)
    df.unpersist()


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, {"v": [0.5]})["v"] == [None]
    assert exact_quantiles(df, {}) == {}


def test_sequence_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("t"))
    rows = sequence_numbers(df, ["k"]).collect()
    assert len(rows) == 1000 and all(r["k"] == r["sequence"] for r in rows)


def test_label_codes(spark):
    df = spark.createDataFrame(
        [("b", "z"), ("a", None), (None, "y"), ("c", "y")], "p string, q string")
    encoded = label_encode(df, ["p", "q"]).collect()
    assert sorted(tuple(r) for r in encoded) == [(0, 0), (1, 2), (2, 1), (3, 1)]
    assert label_encode(df, []) is df


def test_encoding_reads_the_rows_once_besides_the_dictionary(spark, tmp_path):
    texts = [F.sha2((F.col("id") * (k + 3)).cast("string"), 256).alias(f"t{k}") for k in range(5)]
    spark.range(12_000).select("id", *texts).write.parquet(str(tmp_path / "facts"))
    encoded = label_encode(spark.read.parquet(str(tmp_path / "facts")), [f"t{k}" for k in range(5)])
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    scans = [f for f in encoded.inputFiles() if "/facts/" in f]
    assert len(scans) == len(set(scans)) and plan.count("Relation [id#") == 1
    assert encoded.agg(F.countDistinct("t4"), F.max("t4")).first()[:] == (12_000, 11_999)


def test_cleaning_counts_gaps_once(spark, tmp_path):
    spark.range(1000).select(
        F.when(F.col("id") % 10 > 0, F.col("id")).alias("a"), F.when(F.col("id") > 990, 1).alias("sparse"),
        F.when(F.col("id") % 3 > 0, F.lit("x")).alias("t"), F.lit("full").alias("u")).write.parquet(
        str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d"))
    out = cleaning.clean(rows)
    assert out.columns == ["a", "t", "u"]
    assert out.agg(*[F.count(c) for c in out.columns]).first()[:] == (1000, 1000, 1000)
    assert out.filter("a = 500").count() == 100 and cleaning.clean(rows.limit(0)).count() == 0


@pytest.mark.parametrize("width", [6, 60])
def test_correlations_of_constant_gappy_and_wide_frames(spark, width):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, width)) + 1e6
    data[:, 1] = 0.1
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:, 2] = np.nan
    rows = [[None if np.isnan(x) and i % 2 else float(x) for x in r] for i, r in enumerate(data)]
    names = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_matrix(df, names).collect()}
    assert len(got) == width * width
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            if {i, j} & {1, 2}:
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(data[both, i], data[both, j])[0, 1]) < 1e-9
    assert {r["corr"] for r in correlation_matrix(df.limit(0), names).collect()} <= {None}


def test_first_and_last_rows(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 31 % 17).alias("x"))
    last = {r["id"] for r in last_rows(df, ["id"], 300, F.floor(F.col("id") / 100)).collect()}
    first = {r["id"] for r in first_rows(df, ["id"], 250, F.floor(F.col("id") / 100)).collect()}
    assert last == set(range(4700, 5000)) and first == set(range(250))
    assert last_rows(df, ["id"], 10_000, F.floor(F.col("id") / 100)).count() == 5000


def test_split_is_exact_per_label_and_stable(spark):
    df = spark.range(10_000).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 29 == 0).cast("int").alias("isFraud"))
    first = stratified_split(df, "k")
    counts = {(r["isFraud"], r["is_test"]): r["count"]
              for r in first.groupBy("isFraud", "is_test").count().collect()}
    assert counts == {(0, True): 1931, (0, False): 7724, (1, True): 69, (1, False): 276}
    again = stratified_split(df.repartition(5), "k")
    assert first.filter("is_test").select("k").exceptAll(again.filter("is_test").select("k")).isEmpty()


# tn, fp, fn, tp and the published F1
PUBLISHED = [
    (110910, 3065, 3081, 1052, 0.2550), (110919, 3056, 3060, 1073, 0.2597),
    (111048, 2927, 2916, 1217, 0.2941),
]


@pytest.mark.parametrize("tn,fp,fn,tp,f1", PUBLISHED)
def test_published_confusion_matrices(spark, tn, fp, fn, tp, f1):
    confusion = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    assert round(classification_metrics(confusion).first()["f1"], 4) == f1
    report = {r["class"]: r for r in class_report(confusion).collect()}
    assert round(report["fraud"]["f1"], 4) == f1
    assert report["legit"]["support"] == tn + fp and report["weighted avg"]["support"] == tn + fp + fn + tp


def test_single_class_has_no_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "isFraud int, fraud_score double")
    assert roc_auc(df).first()["auc_roc"] is None
    assert model_metrics(df).count() == 0
    summary = evaluation_summary(df).first()
    assert summary["class_warning"] is not None and summary["sample_warning"] is not None


@pytest.mark.parametrize("keys", [None, ["g"]])
def test_auc_against_all_pairs(spark, keys):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame(
        [(int(a), float(b), "x") for a, b in zip(y, s)], "isFraud int, fraud_score double, g string")
    pos, neg = s[y == 1], s[y == 0]
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    got = roc_auc(df, keys=keys).first()["auc_roc"]
    assert abs(got - pairs / (len(pos) * len(neg))) < 1e-12


def test_far_score_does_not_gather_the_rest_in_one_partition(spark):
    rng = np.random.default_rng(4)
    scores = np.append(rng.random(4000), 1e9)
    df = spark.createDataFrame([(int(i % 3 == 0), float(x)) for i, x in enumerate(scores)],
                               "isFraud int, fraud_score double")
    advisory = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = score_counts(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", advisory)
    sizes = [r["count"] for r in counts.groupBy("part").count().collect()]
    assert sum(sizes) == 4001 and max(sizes) < 2 * 4001 / len(sizes) and len(sizes) > 4
    y = np.arange(4001) % 3 == 0
    pos, neg = scores[y], np.sort(scores[~y])
    expected = np.searchsorted(neg, pos).sum() / (len(pos) * len(neg))
    assert abs(area_under_roc(counts).first()["auc_roc"] - expected) < 1e-12


def test_metrics_row_scans_its_input_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 4 == 0).cast("int").alias("isFraud"),
                            (F.col("id") / 100).alias("fraud_score")).write.parquet(str(tmp_path / "s"))
    row = model_metrics(spark.read.parquet(str(tmp_path / "s")))
    assert not [f for f in row.inputFiles() if f.startswith(f"file://{tmp_path}")]
    first = row.first()
    assert first["samples_evaluated"] == 100 and first["true_positives"] + first["false_negatives"] == 25


def test_single_class_has_no_report(spark):
    single = spark.createDataFrame([(5, 2, 0, 0)], "tn long, fp long, fn long, tp long")
    assert class_report(single).count() == 0


def test_cut_keys_per_group_with_a_hot_group(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.xxhash64("id").alias("h"))
    quota = df.groupBy("g").agg(F.ceil(F.count("*") / 3).alias("take"))
    cuts = {r["g"]: r["cut_key"] for r in cut_keys(df, ["g"], "h", long_bucket(F.col("h")), quota).collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["g"], []).append(r["h"])
    assert set(cuts) == set(rows)
    assert all(sum(h <= cuts[g] for h in hs) == -(-len(hs) // 3) for g, hs in rows.items())


def test_latest_and_recent_of_a_hot_key(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    latest = {r["k"]: r["t"] for r in latest_per_key(df, ["k"], [F.col("t")]).collect()}
    assert latest[0] == 5997 and len(latest) == 4001
    recent = recent_per_key(df, ["k"], [F.col("t")], 4).filter("k = 0").orderBy("recency").collect()
    assert [r["t"] for r in recent] == [5997, 5994, 5991, 5988]


def test_quantiles_of_stored_sketches_and_odd_values(spark):
    rng = np.random.default_rng(9)
    rows = [(int(d), float(x), float(np.round(x)), float("nan") if k % 50 == 0 else float(x))
            for k, (d, x) in enumerate(zip(rng.integers(0, 5, 20_000), rng.normal(0, 1e6, 20_000)))]
    df = spark.createDataFrame(rows, "day int, a double, b double, c double").withColumns(
        {"i": F.col("b").cast("bigint"), "same": F.lit(7), "gone": F.lit(None).cast("double")}).persist()
    stored = column_sketches(df, ["a", "b", "c", "i", "same", "gone"], ["day"]).persist()
    assert stored.count() == 30
    wanted = {c: PROBS for c in ("a", "b", "i", "same", "gone")} | {"c": [0.0, 0.5, 0.97, 0.99, 1.0]}
    got = exact_quantiles(df, wanted, stored)
    values = np.array([r[1] for r in rows])
    assert np.allclose(got["a"], np.quantile(values, PROBS)) and np.allclose(got["b"], np.quantile(np.round(values), PROBS))
    assert got["i"] == got["b"] and got["same"] == [7.0] * len(PROBS) and got["gone"] == [None] * len(PROBS)
    assert np.allclose(got["c"], np.sort([r[3] for r in rows])[[0, 10_000, 19_399, 19_799, 19_999]], equal_nan=True, atol=2e3)
    df.unpersist(), stored.unpersist()


def test_quantiles_take_two_scans_and_mend_a_wrong_sketch(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(10)
    v = rng.random(30_000)
    path = str(tmp_path / "t")
    spark.createDataFrame([(float(x), float(-x), 1.0) for x in v], "v double, w double, u double").write.parquet(path)
    df, scans, real = spark.read.parquet(path), [], quantiles._values_at_ranks
    monkeypatch.setattr(quantiles, "_values_at_ranks", lambda d, b: (scans.append(len(b)), real(d, b))[1])
    assert np.allclose(exact_quantiles(df, {"v": PROBS, "w": PROBS})["v"], np.quantile(v, PROBS))
    assert len(scans) == 1
    wrong = column_sketches(df.withColumn("v", F.col("v") + 5), ["v"])  # every bracket lies too high
    assert np.allclose(exact_quantiles(df, {"v": [0.1, 0.5]}, wrong)["v"], np.quantile(v, [0.1, 0.5]))
    assert len(scans) == 3
