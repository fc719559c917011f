"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A document is the set of its word n-grams and of n-grams of word shapes (case, digits, end
punctuation, repetition). Indicators are scaled by the class log-count ratio of their n-gram,
vectors are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve fitted on rows kept out of the descent turns margins into scores.

The fit uses a bounded sample of labelled rows; every document is scored in one map pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, chunks, joined, quoted, utf8, with_columns, written

BITS = 17
#: At most so many labelled rows are used for fitting.
MAX_LABELLED = 12_000

_SPACE, _LOWER, _UPPER, _DIGIT, _MARK = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[0x61:0x7B] = _LOWER
    out[0x80:] = _LOWER
    out[0x41:0x5B] = _UPPER
    out[0x30:0x3A] = _DIGIT
    return out


_CLASS = _classes()
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def indicators(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text number, feature)`` pairs of a chunk of texts, as two sorted arrays."""
    data, starts = joined(texts)
    kind = _CLASS[data]
    solid = kind != _SPACE
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.searchsorted(starts, first, side="right") - 1

    # a word's hash: the sum of its bytes, each mixed with its place in the word
    word = np.repeat(np.arange(len(first)), end - first)
    place = np.flatnonzero(solid)
    within = (place - first[word]).astype(np.uint64)
    terms = _mixed((_FOLD[data[place]] + np.uint64(1)) * _BASE + within * np.uint64(0xD6E8FEB86659FD93))
    hashes = _mixed(np.add.reduceat(terms, np.flatnonzero(np.diff(word, prepend=-1))))

    counted = [np.add.reduceat((kind == k).view(np.uint8)[place].astype(np.int64),
                               np.flatnonzero(np.diff(word, prepend=-1))) for k in (1, 2, 3, 4)]
    lower, upper, digit, mark = counted
    case = np.where(lower + upper == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2 + (upper > 1), 4)))
    last, before = data[end - 1], data[np.maximum(end - 2, 0)]
    ends = np.where(kind[end - 1] == _MARK, last, 0).astype(np.int64)
    doubled = (ends > 0) & (end - first > 1) & (before == last)
    same_text = np.concatenate([[False], owner[1:] == owner[:-1]])
    again = same_text & np.concatenate([[False], hashes[1:] == hashes[:-1]])
    shape = ((((case * 2 + (digit > 0)) * 256 + ends) * 2 + doubled) * 2 + again) * 2 + (mark > 2)
    shapes = _mixed(shape.astype(np.uint64) * _BASE + np.uint64(77))

    grams, owners = [hashes, shapes], [owner, owner]
    for n in (2, 3):
        if len(owner) >= n:
            inside = owner[n - 1:] == owner[:len(owner) - n + 1]
            mix = np.zeros(len(owner) - n + 1, np.uint64)
            for k in range(n):
                mix = _mixed(mix * np.uint64(31) + shapes[k:len(shapes) - n + 1 + k] + np.uint64(n))
            grams.append(mix[inside])
            owners.append(owner[n - 1:][inside])
    features = (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)
    pairs = np.unique(np.concatenate(owners) << bits | features)
    return pairs >> bits, pairs & ((1 << bits) - 1)


@dataclass
class Model:
    """Score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights . x / |scale . x| + bias."""

    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        bits = len(self.weights).bit_length() - 1
        owner, feature = indicators(texts, bits)
        dot = np.bincount(owner, self.weights[feature], len(texts))
        norm = np.sqrt(np.bincount(owner, self.scale[feature] ** 2, len(texts)))
        return dot / np.where(norm > 0, norm, 1.0) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.slope * self.margins(texts) + self.shift, -700, 700)
        return 1.0 / (1.0 + np.exp(-z))


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, size: int,
                    smoothing: float = 1.0) -> np.ndarray:
    """Per feature the log of its smoothed share among positives over that among negatives."""
    counts = [smoothing + np.bincount(np.concatenate([np.empty(0, np.int64)] + [
        r for r, y in zip(rows, label) if y == side]), minlength=size) for side in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray,
                            cost: float = 1.0, epochs: int = 12, seed: int = 7
                            ) -> tuple[np.ndarray, float]:
    """Weights (already times ``scale``) and bias of the L2-regularised hinge-loss model.

    Each step solves one dual variable exactly within its box. Classes weigh alike; the bias is
    a weight of a constant indicator.
    """
    sign = np.where(label == 1, 1.0, -1.0)
    share = np.array([max(1, int((label == 0).sum())), max(1, int((label == 1).sum()))])
    upper = cost * len(label) / (2.0 * share[(label == 1).astype(int)])
    values = []
    for r in rows:
        x = scale[r]
        values.append(x / max(1e-12, float(np.sqrt((x * x).sum()))))
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    chance = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in chance.permutation(len(rows)).tolist():
            r, x = rows[i], values[i]
            gradient = sign[i] * (float(weights[r] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / (float(x @ x) + 1.0), 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[r] += step * x
                bias += step
                alpha[i] = new
    return weights * scale, bias


def logistic_curve(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps on smoothed targets."""
    positives = int(label.sum())
    target = np.where(label == 1, (positives + 1) / (positives + 2), 1 / (len(label) - positives + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500)))
        gap, weight = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([gap @ margin, gap.sum()]) + 1e-6 * np.array([slope, 0.0])
        h = np.array([[weight @ (margin * margin) + 1e-6, weight @ margin],
                      [weight @ margin, weight.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 4.0 / max(1e-12, float(np.abs(move).max())))
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(shift)


def fit_rows(rows: list[np.ndarray], label: np.ndarray, bits: int = BITS) -> Model:
    """The model of labelled indicator sets; every fourth row is kept for the logistic curve."""
    size = 1 << bits
    if not 0 < label.sum() < len(label):
        share = (label.sum() + 0.5) / (len(label) + 1.0)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    kept_out = np.arange(len(label)) % 4 == 3
    if not 0 < label[kept_out].sum() < kept_out.sum() or not 0 < label[~kept_out].sum() < (~kept_out).sum():
        kept_out = np.zeros(len(label), bool)
    fitting = [r for r, k in zip(rows, kept_out) if not k]
    ratio = log_count_ratio(fitting, label[~kept_out], size)
    weights, bias = dual_coordinate_descent(fitting, ratio, label[~kept_out])
    probe = kept_out if kept_out.any() else ~kept_out
    margin = np.array([weights[r].sum() / max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) + bias
                       for r, k in zip(rows, probe) if k])
    return Model(weights, ratio, bias, *logistic_curve(margin, label[probe]))


def held_out(key: str = "doc_id"):
    """Whether a row belongs to the fifth that no model learns from; a null key counts as ''."""
    return F.crc32(F.coalesce(quoted(key).cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled keys outside the held-out fifth, in the order of a hash.

    Conflicting labels of a key count as their rounded mean. A threshold on the hash leaves
    about twice the limit before the final cut, so no task sorts the table.
    """
    rows = labels.filter(quoted(key).isNotNull() & quoted(label).isNotNull() & ~held_out(key)).select(
        quoted(key).alias("__key"), quoted(label).cast("double").alias("y"))
    known = written(rows.groupBy("__key").agg(F.round(F.avg("y")).cast("int").alias("y"))
                    .withColumn("h", F.xxhash64(F.col("__key").cast("string"))), "labelled")
    total = known.count()
    span = 1 << 20
    part = span if total <= 2 * limit else -(-2 * limit * span // total)
    near = known.filter(F.pmod("h", F.lit(span)) < part)
    return near.orderBy(F.pmod("h", F.lit(span)), "h", "__key").limit(limit).select("__key", "y")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", limit: int = MAX_LABELLED, bits: int = BITS) -> Model:
    """A model from at most ``limit`` labelled documents, fitted in one task.

    Without labels the score is one half; with labels of one class only, near that class.
    Nothing but the text is an input.
    """
    sample = F.broadcast(written(labelled_sample(labels, key, label, limit), "sample"))
    # a key may name many rows; equal ones are one example
    rows = docs.select(quoted(key).alias("__key"), quoted(text).cast("string").alias("text")).join(
        sample, "__key").select("text", "y", F.xxhash64("__key", "text").alias("h"))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("y", T.IntegerType()),
                           T.StructField("features", T.BinaryType())])

    def featurise(batches):
        for batch in batches:
            h, y = (batch_column(batch, c).to_pylist() for c in ("h", "y"))
            at = 0
            for part in chunks(utf8(batch_column(batch, "text"))):
                owner, feature = indicators(part, bits)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                sets = [feature[lo:hi].astype(np.int32).tobytes()
                        for lo, hi in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at:at + len(part)], pa.int64()), pa.array(y[at:at + len(part)], pa.int32()),
                     pa.array(sets, pa.binary())], names=schema.names)
                at += len(part)

    examples = written(rows.mapInArrow(featurise, schema), "examples")
    chosen = written(examples.select("h").distinct().orderBy("h").limit(limit), "chosen")
    kept = examples.join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    shape = T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("scale", T.BinaryType()),
                          T.StructField("rest", T.ArrayType(T.DoubleType()))])

    def solve(group):
        group = group.sort_by("h")
        sets = [np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("features").to_pylist()]
        model = fit_rows(sets, np.array(group.column("y").to_pylist(), np.int64), bits)
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()),
                         "scale": pa.array([model.scale.tobytes()], pa.binary()),
                         "rest": pa.array([[model.bias, model.slope, model.shift]], pa.list_(pa.float64()))})

    found = kept.groupBy(F.lit(0).alias("one")).applyInArrow(solve, shape).collect()
    if not found:
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0, 0.0)
    return Model(np.frombuffer(found[0]["weights"]), np.frombuffer(found[0]["scale"]), *found[0]["rest"])


def with_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score",
                 predicted: str = "predicted", threshold: float = 0.3) -> DataFrame:
    """Adds the score (0 to 1) and the prediction; columns of these names are replaced.

    Null and empty texts get the score of a document without n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights, model.scale, model.bias, model.slope, model.shift))

    def compute(batch):
        held = Model(*shared.value)
        parts = [held.scores(part) for part in chunks(utf8(batch_column(batch, text)))]
        values = np.concatenate(parts)
        return [pa.array(values), pa.array((values >= threshold).astype(np.int32))]

    return with_columns(docs, text, [T.StructField(score, T.DoubleType()),
                                     T.StructField(predicted, T.IntegerType())], compute)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents predicted good, in their own columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    model = fit(docs, labels, key, text)
    scored = with_quality(plain, model, names[text], "__score", "__good")
    return scored.filter(F.col("__good") == 1).select(
        *[F.col(n).alias(c) for c, n in names.items()])
