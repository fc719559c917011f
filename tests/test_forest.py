"""Properties of the forest that do not depend on random numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwarden.operators import forest as FO
from cardwarden.operators.forest import (
    ForestParams, anomaly_score, average_path, draw_samples, fit_forest, grow_forest, grow_tree,
    with_scores,
)
from cardwarden.streaming.lifecycle import ModelStore

FEATURES = ["f0", "f1", "f2"]
SMALL = ForestParams(trees=40, max_samples=64, contamination=0.05)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3))
    x[0] = [25.0, -25.0, 25.0]
    rows = [(str(i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k string, f0 double, f1 double, f2 double").repartition(
        4).persist()


@pytest.fixture(scope="module")
def forest(points):
    return fit_forest(points, "k", FEATURES, SMALL)


def test_average_path():
    assert list(average_path([0, 1, 2])) == [0.0, 0.0, 1.0]
    assert abs(float(average_path(256)) - 10.2448) < 1e-3


def test_tree_shape():
    x = np.random.default_rng(0).normal(size=(128, 4))
    x[:, 3] = 1.0
    t = grow_tree(x, np.random.default_rng(1))
    inner = t["left"] >= 0
    assert t["depth"].max() <= 7 and t["size"][0] == 128
    assert not (t["feature"][inner] == 3).any()
    assert (t["size"][t["left"][inner]] + t["size"][t["right"][inner]] == t["size"][inner]).all()
    assert (t["size"][~inner] >= 1).all() and t["size"][~inner].sum() == 128
    grown = grow_tree(np.ones((16, 2)), np.random.default_rng(1))
    assert len(grown["node_id"]) == 1


def test_path_sums_walk_like_a_single_tree():
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 3))
    trees = [grow_tree(x, np.random.default_rng(i)) for i in range(3)]
    packed = FO._pack(pd.concat([pd.DataFrame({"tree_id": i, **t}) for i, t in enumerate(trees)]))
    probe = rng.normal(size=(7, 3))

    def walk(t, row):
        node = 0
        while t["left"][node] >= 0:
            node = t["right"][node] if row[t["feature"][node]] > t["cut"][node] else t["left"][node]
        return t["path_length"][node]

    expected = [sum(walk(t, row) for t in trees) for row in probe]
    assert np.allclose(FO.path_sums(probe, packed, block=2), expected)


@pytest.mark.parametrize("n,trees,size", [(600, 40, 64), (600, 5, 64), (50, 6, 50), (600, 9, 64)])
def test_samples_are_whole_and_without_replacement(points, n, trees, size):
    rows = points.filter(F.col("k").cast("int") < n)
    drawn = draw_samples(rows, "k", FEATURES, n, trees, size, 42)
    stats = drawn.groupBy("tree_id").agg(
        F.count("*").alias("n"), F.countDistinct("pick").alias("d")).collect()
    assert len(stats) == trees and all(r["n"] == size and r["d"] == size for r in stats)


def test_far_point_ranks_first_and_scores_are_in_range(points, forest):
    scored = with_scores(points, forest)
    worst = scored.orderBy("anomaly_score").first()
    assert worst["k"] == "0" and worst["prediction"] == -1 and worst["score"] > 0.5
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 < low < high < 0


def test_offset_leaves_the_contamination_below(points, forest):
    flagged = with_scores(points, forest).filter("prediction = -1").count()
    assert abs(flagged - 0.05 * 600) <= 1


def test_layout_does_not_change_the_trees(points, forest):
    other = grow_forest(points.repartition(7, "f1"), "k", FEATURES, SMALL)
    assert other.nodes.exceptAll(forest.nodes).isEmpty()


def test_scaling_a_feature_leaves_scores(points, forest):
    scaled = points.withColumn("f1", F.col("f1") * 1024)
    other = fit_forest(scaled, "k", FEATURES, SMALL)
    a = {r["k"]: r["s"] for r in points.select("k", anomaly_score(forest).alias("s")).collect()}
    b = {r["k"]: r["s"] for r in scaled.select("k", anomaly_score(other).alias("s")).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_size_of_a_forest_is_limited():
    with pytest.raises(ValueError):
        ForestParams(trees=1001, max_samples=2000)
    assert ForestParams(trees=500, max_samples=2048).rows_per_tree == 2048


def test_feature_subsets(points):
    grown = grow_forest(points, "k", FEATURES, ForestParams(trees=10, max_samples=32, max_features=0.67))
    used = grown.nodes.filter("feature >= 0").groupBy("tree_id").agg(
        F.countDistinct("feature").alias("n")).agg(F.max("n")).first()[0]
    assert used <= 2


def test_no_rows_is_an_error(points):
    with pytest.raises(ValueError):
        grow_forest(points.filter("false"), "k", FEATURES)


def test_no_model_scores_minus_one(points):
    row = with_scores(points, None).first()
    assert row["score"] == -1.0 and row["prediction"] is None


def test_store_round_trip(spark, points, forest, tmp_path):
    store = ModelStore(spark, str(tmp_path / "model"))
    assert store.load() is None
    store.save(forest, "session-a", 10.0)
    loaded = store.load()
    assert loaded.version == 1 and loaded.warmed_up("session-a") and not loaded.warmed_up("b")
    a = points.select("k", anomaly_score(forest).alias("s"))
    b = points.select("k", anomaly_score(loaded.forest).alias("s"))
    assert a.exceptAll(b).isEmpty()
    store.save(forest, "session-b", 20.0)
    assert store.load().version == 2
    from cardwarden.session import delete_path

    delete_path(spark, str(tmp_path / "model" / "nodes" / "2"))
    assert store.load() is None
