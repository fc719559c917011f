"""Model storage, the switch between models, and when to train."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cardwarden import constants as C
from cardwarden.operators.forest import (
    NODE_SCHEMA, Forest, ForestParams, calibrated, forest_from_row, grow_forest, stored_nodes,
)
from cardwarden.session import delete_path, path_exists
from cardwarden.sinks.daytable import children

log = logging.getLogger(__name__)

MODEL_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("session_id", T.StringType()),
    T.StructField("trained_at", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("stds", T.ArrayType(T.DoubleType())),
    T.StructField("n_samples", T.LongType()), T.StructField("sample_size", T.LongType()),
    T.StructField("offset", T.DoubleType()), T.StructField("trees", T.LongType()),
    T.StructField("max_samples", T.StringType()), T.StructField("max_features", T.DoubleType()),
    T.StructField("contamination", T.DoubleType()), T.StructField("seed", T.LongType()),
])


@dataclass(frozen=True)
class ActiveModel:
    """The model a micro-batch uses: its version, the session that trained it, the forest."""

    version: int
    session_id: str
    trained_at: float
    forest: Forest

    def warmed_up(self, session_id: str) -> bool:
        """Only a model trained on this session's own rows may raise alerts."""
        return self.session_id == session_id


class ModelStore:
    """Versioned node tables and one scalar row per version; the row is written last and is the switch.

    The last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path, keep

    def _nodes_path(self, version: int) -> str:
        return os.path.join(self.path, f"nodes/{version}")

    def _rows_path(self) -> str:
        return os.path.join(self.path, "models")

    def train(self, rows: DataFrame, key: str, features: list[str], params: ForestParams,
              session_id: str, now: float) -> ActiveModel:
        """Fit on the rows, store the nodes, then publish the version."""
        latest = self._latest_row()
        version = 1 if latest is None else latest["version"] + 1
        grown = grow_forest(rows, key, features, params)
        forest = calibrated(stored_nodes(grown, self._nodes_path(version)), rows,
                            params.contamination)
        return self.publish(forest, version, session_id, now)

    def save(self, forest: Forest, session_id: str, now: float) -> ActiveModel:
        """Store a forest fitted elsewhere."""
        latest = self._latest_row()
        version = 1 if latest is None else latest["version"] + 1
        return self.publish(stored_nodes(forest, self._nodes_path(version)), version, session_id, now)

    def publish(self, forest: Forest, version: int, session_id: str, now: float) -> ActiveModel:
        row = {"version": version, "session_id": session_id, "trained_at": now, **forest.row()}
        self.spark.createDataFrame([tuple(row[f] for f in MODEL_SCHEMA.names)], MODEL_SCHEMA).coalesce(
            1).write.mode("overwrite").parquet(os.path.join(self._rows_path(), str(version)))
        self._drop_old(version)
        return ActiveModel(version, session_id, now, forest)

    def versions(self) -> list[int]:
        """Published versions, newest first."""
        names = [s.getPath().getName() for s in children(self.spark, self._rows_path())]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _drop_old(self, newest: int) -> None:
        """Keep the last few versions: batches in flight score with the one before, an operator can go back."""
        for version in self.versions():
            if version <= newest - self.keep:
                delete_path(self.spark, os.path.join(self._rows_path(), str(version)))
                delete_path(self.spark, self._nodes_path(version))

    def _latest_row(self):
        """The newest row that is complete."""
        for version in self.versions():
            row = self.spark.read.schema(MODEL_SCHEMA).parquet(os.path.join(self._rows_path(), str(version))).first()
            if row is not None:
                return row
        return None

    def load(self) -> ActiveModel | None:
        """The newest complete model, ``None`` when there is none or it cannot be read."""
        try:
            row = self._latest_row()
            if row is None or not path_exists(self.spark, self._nodes_path(row["version"])):
                return None
            nodes = self.spark.read.schema(NODE_SCHEMA).parquet(self._nodes_path(row["version"]))
            forest = forest_from_row(self.spark, nodes, row)
            return ActiveModel(row["version"], row["session_id"], row["trained_at"], forest)
        except Exception as error:  # a broken model must not stop the stream
            log.warning("no usable model: %s", error)
            return None


@dataclass(frozen=True)
class TrainingPolicy:
    """When the first training and the periodic ones happen; checked after each batch."""

    warmup_size: int = C.WARMUP_SIZE
    window_size: int = C.WINDOW_SIZE
    retrain_seconds: float = C.RETRAIN_SECONDS

    def __post_init__(self):
        if self.warmup_size > self.window_size:
            raise ValueError("warmup_size above window_size: periodic training could never start")

    def warmup_due(self, model: ActiveModel | None, session_id: str, rows_seen: int) -> bool:
        fresh = model is not None and model.warmed_up(session_id)
        return not fresh and rows_seen >= self.warmup_size

    def retrain_due(self, model: ActiveModel | None, session_id: str, rows_seen: int,
                    now: float) -> bool:
        return (
            model is not None and model.warmed_up(session_id)
            and now - model.trained_at >= self.retrain_seconds
            and min(rows_seen, self.window_size) >= self.warmup_size
        )

    def with_sizes(self, **sizes) -> "TrainingPolicy":
        return replace(self, **sizes)
