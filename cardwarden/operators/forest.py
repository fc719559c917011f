"""Isolation forest (Liu, Ting and Zhou 2008) fitted and applied as Spark jobs.

Sampling, scaling statistics, scoring and the offset are distributed over rows;
building is distributed over trees, each from its own bounded sample.
"""

from __future__ import annotations

import math
import sys
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden import constants as C
from cardwarden.functions import scalars as S
from cardwarden.plans.quantiles import exact_quantiles
from cardwarden.plans.selection import cut_keys, long_bucket, sequence_numbers
from cardwarden.session import scratch_folder, scratch_path, written

# executors get the array code inside the task, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AUTO_SAMPLES = 256
#: Bound on trees x rows per tree. A forest has at most twice as many nodes, 40 bytes each.
MAX_TREE_ROWS = 2_000_000

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("cut", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("path_length", T.DoubleType()),
])


@dataclass(frozen=True)
class ForestParams:
    trees: int = 300
    max_samples: int | str = 1024
    max_features: float = 1.0
    contamination: float = C.CONTAMINATION
    seed: int = 42

    def __post_init__(self):
        if self.trees * self.rows_per_tree > MAX_TREE_ROWS:
            raise ValueError(
                f"trees x max_samples is {self.trees * self.rows_per_tree}, above {MAX_TREE_ROWS}: "
                "the nodes of a forest are sent to every task")

    @property
    def rows_per_tree(self) -> int:
        return AUTO_SAMPLES if self.max_samples == "auto" else int(self.max_samples)


@dataclass(frozen=True)
class Forest:
    """A fitted forest: nodes as a table, the rest as a few scalars."""

    nodes: DataFrame
    features: list[str]
    means: list[float]
    stds: list[float]
    n_samples: int
    sample_size: int
    params: ForestParams = field(default_factory=ForestParams)
    offset: float | None = None

    def row(self) -> dict:
        return {
            "features": self.features, "means": self.means, "stds": self.stds,
            "n_samples": self.n_samples, "sample_size": self.sample_size, "offset": self.offset,
            **{k: v for k, v in asdict(self.params).items() if k != "max_samples"},
            "max_samples": str(self.params.max_samples),
        }


def average_path(size):
    """Mean path length of an unsuccessful search among ``size`` rows."""
    size = np.asarray(size, dtype=np.float64)
    big = np.maximum(size, 3.0)
    general = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(size <= 1, 0.0, np.where(size == 2, 1.0, general))


def scaling(df: DataFrame, features: list[str]) -> tuple[int, list[float], list[float]]:
    """Row count, means and population deviations (0 counts as 1) in one pass.

    Ten digits are kept: they do not depend on the order of summation, so neither
    do the trees, and the scale itself does not matter to a tree.
    """
    row = df.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    means = [float(f"{row[f'm{i}'] or 0.0:.10g}") for i in range(len(features))]
    stds = [float(f"{row[f's{i}'] or 1.0:.10g}") for i in range(len(features))]
    return row["n"], means, stds


def draw_samples(df: DataFrame, key: str, features: list[str], n: int, trees: int,
                 sample_size: int, seed: int) -> DataFrame:
    """One sample without replacement per tree: (tree_id, pick, features).

    Rows are put in a random order by a keyed hash and cut into disjoint blocks of
    ``sample_size``, one per tree; when the rows do not reach for all trees, further
    orders give further blocks. Either way about trees x sample_size keys are numbered
    (the features join later), over range partitions and however large the table, and
    the draw does not depend on layout. Keys must be unique.
    """
    blocks = max(1, min(trees, n // sample_size))
    orders = math.ceil(trees / blocks)
    wanted = blocks * sample_size
    source = df
    if orders == 1:
        hashed = df.withColumn("__pick", F.xxhash64(F.lit(seed), F.lit(0), F.col(key)))
        quota = df.sparkSession.createDataFrame([(0, wanted)], "all_rows int, take bigint")
        cut = cut_keys(hashed.withColumn("all_rows", F.lit(0)), ["all_rows"], "__pick",
                       long_bucket(F.col("__pick")), quota).first()["cut_key"]
        source = hashed.filter(F.col("__pick") <= F.lit(cut)).drop("__pick")
    orders_of_row = F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))
    ordered = source.select(key, orders_of_row.alias("__order")).withColumn(
        "pick", F.xxhash64(F.lit(seed), F.col("__order"), F.col(key)))
    # every order holds the same rows, so the place in it follows from the number over all
    per_order = wanted if orders == 1 else n
    placed = sequence_numbers(ordered, ["__order", "pick", key]).withColumn(
        "__place", F.col("sequence") - F.col("__order") * F.lit(per_order)).filter(
        F.col("__place") < wanted)
    block = F.floor(F.col("__place") / F.lit(sample_size))
    tree = (F.col("__order") * F.lit(blocks) + block).cast("int")
    assigned = placed.select(key, "pick", tree.alias("tree_id")).filter(F.col("tree_id") < trees)
    return assigned.join(source.select(key, *features), key).select("tree_id", "pick", *features)


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_features: float = 1.0) -> dict:
    """Grow one tree level by level; all nodes of a level are split in one set of array steps.

    A node takes a uniform feature among those that vary in it and a uniform cut
    between their extremes; it is a leaf when nothing varies or the height limit is hit.
    """
    n, d = x.shape
    usable = np.arange(d)
    if max_features < 1.0:
        usable = np.sort(rng.choice(d, max(1, int(max_features * d)), replace=False))
    limit = math.ceil(math.log2(max(n, 2)))
    node_of, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    active = np.array([0])
    feature, cut, left = [np.array([-1])], [np.array([np.inf])], [np.array([-1])]
    size, depth = [np.array([n])], [np.array([0])]
    total = 1
    for level in range(limit):
        order = np.argsort(node_of[rows], kind="stable")
        rows = rows[order]
        owner = node_of[rows]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        active = owner[starts]
        sub = x[np.ix_(rows, usable)]
        low, high = np.minimum.reduceat(sub, starts), np.maximum.reduceat(sub, starts)
        varies = high > low
        split = varies.any(axis=1)
        if not split.any():
            break
        draw = np.where(varies, rng.random(varies.shape), -1.0)
        pick = draw.argmax(axis=1)
        at = np.arange(len(active))
        a, b = low[at, pick], high[at, pick]
        threshold = a + rng.random(len(active)) * (b - a)
        threshold = np.where(threshold >= b, a, threshold)
        counts = np.diff(np.r_[starts, len(rows)])
        slot = np.repeat(at, counts)
        keep = split[slot]
        goes_right = x[rows, usable[pick[slot]]] > threshold[slot]
        parents = active[split]
        children = total + 2 * np.arange(len(parents))
        all_feature, all_cut, all_left = (np.concatenate(v) for v in (feature, cut, left))
        all_feature[parents], all_cut[parents] = usable[pick[split]], threshold[split]
        all_left[parents] = children
        child_of = np.full(len(active), -1)
        child_of[split] = children
        rows, goes_right, slot = rows[keep], goes_right[keep], slot[keep]
        node_of[rows] = child_of[slot] + goes_right
        added = 2 * len(parents)
        sizes = np.bincount(node_of[rows] - total, minlength=added)
        feature = [all_feature, np.full(added, -1)]
        cut, left = [all_cut, np.full(added, np.inf)], [all_left, np.full(added, -1)]
        size.append(sizes)
        depth.append(np.full(added, level + 1))
        total += added
    size, depth = np.concatenate(size), np.concatenate(depth)
    left = np.concatenate(left)
    return {
        "node_id": np.arange(total), "feature": np.concatenate(feature),
        "cut": np.concatenate(cut), "left": left, "right": np.where(left < 0, -1, left + 1),
        "size": size, "depth": depth,
        "path_length": np.where(left < 0, depth + average_path(size), 0.0),
    }


def _tree_builder(features: list[str], means: list[float], stds: list[float],
                  seed: int, max_features: float):
    mean, std = np.array(means), np.array(stds)

    def build(key: tuple, sample: pa.Table) -> pa.Table:
        tree_id = key[0].as_py()
        x = np.column_stack([sample[c].to_numpy() for c in features]).astype(np.float64)
        # the sample arrives in any order; the hash order makes the tree reproducible
        order = np.lexsort((x[:, 0], sample["pick"].to_numpy()))
        nodes = grow_tree(
            (x[order] - mean) / std, np.random.default_rng([seed, tree_id]), max_features)
        columns = {"tree_id": np.full(len(nodes["node_id"]), tree_id), **nodes}
        return pa.table({
            f.name: pa.array(columns[f.name], pa.float64() if f.dataType == T.DoubleType() else pa.int32())
            for f in NODE_SCHEMA.fields})

    return build


def grow_forest(df: DataFrame, key: str, features: list[str],
                params: ForestParams = ForestParams()) -> Forest:
    """Fit the trees; the nodes are a lazy plan, the offset is not set yet."""
    n, means, stds = scaling(df, features)
    if n == 0:
        raise ValueError("cannot fit a forest on no rows")
    sample_size = min(params.rows_per_tree, n)
    samples = draw_samples(df, key, features, n, params.trees, sample_size, params.seed)
    build = _tree_builder(features, means, stds, params.seed, params.max_features)
    # growing is bound by processors, not bytes: a fixed width keeps trees from being coalesced
    width = min(params.trees, spread_width(df.sparkSession))
    nodes = samples.repartition(width, "tree_id").groupBy("tree_id").applyInArrow(
        build, NODE_SCHEMA)
    return Forest(nodes, list(features), means, stds, n, sample_size, params)


def stored_nodes(forest: Forest, path: str) -> Forest:
    """The same forest with its nodes written to, and read back from, a table."""
    forest.nodes.write.mode("overwrite").parquet(path)
    nodes = forest.nodes.sparkSession.read.schema(NODE_SCHEMA).parquet(path)
    return Forest(nodes, forest.features, forest.means, forest.stds, forest.n_samples,
                  forest.sample_size, forest.params, forest.offset)


def fit_forest(df: DataFrame, key: str, features: list[str],
               params: ForestParams = ForestParams(), nodes_path: str | None = None) -> Forest:
    """Fit and calibrate: the offset is the contamination quantile of all training scores."""
    path = nodes_path or scratch_path(df.sparkSession, "forest-nodes")
    forest = stored_nodes(grow_forest(df, key, features, params), path)
    return calibrated(forest, df, params.contamination)


def spread_width(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's partitions, at least one per core, before scoring.

    Walking hundreds of trees costs far more per row than moving its features, and files
    say nothing about that cost.
    """
    conf = df.sparkSession.conf
    return df.repartition(max(spread_width(df.sparkSession), int(conf.get("spark.sql.shuffle.partitions"))))


def calibrated(forest: Forest, training: DataFrame, contamination: float) -> Forest:
    """The offset over all training scores, which are written once: quantiles read them twice."""
    with scratch_folder(training.sparkSession, "calibration") as folder:
        inputs = spread(training.select(*forest.features))
        scores = written(inputs.select(anomaly_score(forest).alias("s")), "scores", folder)
        offset = exact_quantiles(scores, {"s": [contamination]})["s"][0]
    return Forest(forest.nodes, forest.features, forest.means, forest.stds, forest.n_samples,
                  forest.sample_size, forest.params, offset)


# --- scoring ----------------------------------------------------------------------------


def _pack(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Node columns as flat arrays over all trees. A leaf points to itself under a cut nothing passes."""
    nodes = nodes.sort_values(["tree_id", "node_id"])
    counts = nodes.groupby("tree_id").size().to_numpy()
    roots = np.r_[0, np.cumsum(counts)[:-1]]
    base = np.repeat(roots, counts)
    left = nodes["left"].to_numpy(np.int64)
    here = np.arange(len(nodes))
    return {
        "roots": roots.astype(np.intp),
        "feature": np.maximum(nodes["feature"].to_numpy(np.intp), 0),
        "cut": nodes["cut"].to_numpy(np.float64),
        "left": np.where(left < 0, here, base + left).astype(np.intp),
        "path": nodes["path_length"].to_numpy(np.float64),
        "levels": int(nodes["depth"].max()),
    }


def path_sums(x: np.ndarray, packed: dict[str, np.ndarray], block: int = 256) -> np.ndarray:
    """Summed path length over the trees, for blocks of rows and all trees at once.

    All trees of a block of rows go down one level per step, in buffers that are
    reused and small enough to stay in the cache.
    """
    n, d = x.shape
    feature, cut, left, path = (packed[k] for k in ("feature", "cut", "left", "path"))
    shape = (min(block, n), len(packed["roots"]))
    nodes, slots = np.empty(shape, np.intp), np.empty(shape, np.intp)
    values, cuts, right = np.empty(shape), np.empty(shape), np.empty(shape, bool)
    out = np.empty(n)
    for start in range(0, n, block):
        rows = np.ascontiguousarray(x[start:start + block])
        b, flat = len(rows), rows.ravel()
        base = (np.arange(b) * d)[:, None]
        node, slot, value, at, goes = nodes[:b], slots[:b], values[:b], cuts[:b], right[:b]
        node[:] = packed["roots"]
        for _ in range(packed["levels"]):
            np.take(feature, node, out=slot, mode="clip")
            slot += base
            np.take(flat, slot, out=value, mode="clip")
            np.take(cut, node, out=at, mode="clip")
            np.greater(value, at, out=goes)
            np.take(left, node, out=slot, mode="clip")
            np.add(slot, goes, out=node)
        out[start:start + b] = path.take(node).sum(axis=1)
    return out


def anomaly_score(forest: Forest, trees: int | None = None) -> Column:
    """Score column, -1 (most anomalous) to 0, over the forest's feature columns.

    The nodes are sent to the tasks once; their number is bounded by the parameters (see
    ``MAX_TREE_ROWS``), not by the data. ``trees`` limits the score to the first trees.
    """
    spark = forest.nodes.sparkSession
    used = forest.params.trees if trees is None else trees
    mean, std = np.array(forest.means), np.array(forest.stds)
    inputs = [F.col(c).cast("double") for c in forest.features]
    nodes = forest.nodes.filter(F.col("tree_id") < used).toArrow()
    total = _path_udf(spark.sparkContext.broadcast(_pack(nodes.to_pandas())), mean, std)(*inputs)
    scale = float(average_path(forest.sample_size)) or 1.0
    return -F.pow(F.lit(2.0), -(total / F.lit(used)) / F.lit(scale))


def _path_udf(shared, mean: np.ndarray, std: np.ndarray):
    @F.pandas_udf(T.DoubleType())
    def path_sum(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
        return pd.Series(path_sums((x - mean) / std, shared.value))

    return path_sum


def with_scores(df: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds ``anomaly_score``, ``decision``, ``prediction`` (-1/1) and ``score`` in [0, 1].

    Without a model ``score`` is -1.0 and the rest is null.
    """
    if forest is None or forest.offset is None:
        return df.withColumns({
            "anomaly_score": F.lit(None).cast("double"), "decision": F.lit(None).cast("double"),
            "prediction": F.lit(None).cast("int"), "score": F.lit(-1.0)})
    offset = F.lit(forest.offset)
    scored = df.withColumn("anomaly_score", anomaly_score(forest))
    return with_decision(scored, offset).withColumn(
        "score", S.anomaly_probability(F.col("anomaly_score"), offset))


def with_decision(scored: DataFrame, offset: Column) -> DataFrame:
    """Decision value (score minus offset) and the -1/1 prediction; below the offset is an anomaly."""
    decision = F.col("anomaly_score") - offset
    return scored.withColumns({
        "decision": decision,
        "prediction": F.when(decision < 0, F.lit(-1)).otherwise(F.lit(1)),
    })


def forest_from_row(spark: SparkSession, nodes: DataFrame, row) -> Forest:
    """A forest out of its node table and its stored scalar row."""
    samples = row["max_samples"]
    params = ForestParams(
        row["trees"], samples if samples == "auto" else int(samples), row["max_features"],
        row["contamination"], row["seed"])
    return Forest(nodes, list(row["features"]), list(row["means"]), list(row["stds"]),
                  row["n_samples"], row["sample_size"], params, row["offset"])
