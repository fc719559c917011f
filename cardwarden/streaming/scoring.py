"""The scoring stream: each micro-batch becomes stored raw, enriched, alert and feature rows."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cardwarden import constants as C
from cardwarden import schemas
from cardwarden.functions.features import feature_columns
from cardwarden.operators.dashboards import observed_counters
from cardwarden.operators.forest import ForestParams, anomaly_score
from cardwarden.functions import scalars as S
from cardwarden.operators.joins import profiles_in_use, with_profile
from cardwarden.operators.projections import (
    alert_projection, enriched_projection, raw_projection, score_feed,
)
from cardwarden.plans.selection import first_per_key
from cardwarden.session import delete_path, path_exists
from cardwarden.sinks.daytable import children, create_file, read_file
from cardwarden.sinks.feeds import as_feed, no_profiles, publish, to_topic
from cardwarden.sinks.outbox import Outbox
from cardwarden.sinks.tables import (
    append_batch, append_first_wins, batch_days, batch_folders, batch_path, not_stored_before,
    stored_table,
)
from cardwarden.sources.events import accepted, parse_events, quarantined, with_arrival
from cardwarden.streaming.memory import split_witnesses, with_witnesses
from cardwarden.streaming.lifecycle import ActiveModel, ModelStore, TrainingPolicy

log = logging.getLogger(__name__)

KEY = "transaccionID"


def new_session_id() -> str:
    """Sorts by start time, unique per start."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return f"s{stamp}-{uuid.uuid4().hex[:8]}"


@dataclass
class ScoringJob:
    """Settings and the per-batch work of the scoring stream. Holds no row data on the driver."""

    spark: SparkSession
    folder: str
    profiles: Callable[[], DataFrame] | None = None
    policy: TrainingPolicy = field(default_factory=TrainingPolicy)
    forest: ForestParams = field(default_factory=ForestParams)
    threshold: float = C.THRESHOLD
    feed_format: str = "json"
    feed_options: dict[str, str] = field(default_factory=dict)
    feeds: tuple[str, ...] = ("alerts", "scores")
    #: Instead of files: sends ``(number, key, value)`` rows of a feed to an append-only sink, and asks it for its highest number.
    feed_send: Callable[[str, DataFrame], None] | None = None
    feed_sent: Callable[[str], int | None] | None = None
    clock: Callable[[], float] = time.time
    #: How long the stream's own state remembers ids, whatever day they come back under; ``None`` for not at all.
    memory: str | None = "7 days"
    #: Whether a restarted query goes on with its last session: warm-up, window and trained model included.
    resume: bool = False
    session_id: str = field(default_factory=new_session_id)

    def __post_init__(self):
        S.is_suspicious(F.lit(0.0), self.threshold)
        self.models = ModelStore(self.spark, self.path("model"))
        self._scorer: tuple[int, Column] | None = None
        self._begin_session(self.session_id)

    def _begin_session(self, session_id: str, checkpoint: str | None = None) -> None:
        self.session_id, self._checkpoint = session_id, checkpoint
        self._writer = None if checkpoint else session_id
        self._seen, self._warmup_until, self._first_batch = 0, -1, None
        self._tail: list[tuple[int, int]] = []

    @property
    def writer(self) -> str:
        """Names the source of batch numbers: the query that a checkpoint belongs to, else the session.

        A restarted query repeats its last batch under the same name and number.
        """
        if self._writer is None:
            text = self.spark.read.text(os.path.join(self._checkpoint, "metadata")).first()["value"]
            self._writer = json.loads(text)["id"]
        return self._writer

    def path(self, table: str) -> str:
        return os.path.join(self.folder, table)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of parsed records (with the corrupt-record column).

        Rows that other batches have stored go first; all outputs come from what is left. An
        output is either appended on the days that do not have this batch yet, or replaces the
        batch's own folder, so repeating a batch changes nothing, on whatever day it is repeated:
        rows without a readable time lie in a partition of their own.
        """
        try:
            self._process(batch, batch_id)
        finally:
            delete_path(self.spark, self._staging_path(batch_id))

    def _staging_path(self, batch_id: int) -> str:
        return batch_path(self.path("staging"), self.writer, batch_id)

    def _staged(self, rows: DataFrame, batch_id: int, step: str) -> DataFrame:
        """Rows of a batch as a table, computed once, and read in the job's own session.

        A stream's session plans without adaptive execution: each shuffle of a batch would have as many tasks as the
        state has partitions, and each of them would write a file per day. Cached rows keep those partitions too.
        """
        path = os.path.join(self._staging_path(batch_id), step)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        staged, new_ids = split_witnesses(self._staged(with_arrival(batch), batch_id, "messages"), KEY)
        event_day = F.to_date(F.col("fecha_hora_transaccion").try_cast("timestamp_ntz"))
        keyed = accepted(staged, KEY)
        if new_ids is not None:
            keyed = keyed.join(new_ids, KEY, "left_semi")
        first = first_per_key(keyed, [KEY], [F.col("arrival")]).withColumn("day", event_day)
        rows = self._staged(first, batch_id, "rows")
        self._quarantine(staged)
        days = batch_days(rows)
        fresh = not_stored_before(
            rows, self.path("transactions_raw"), KEY, self.writer, batch_id, days)
        if fresh is not rows:
            fresh = self._staged(fresh, batch_id, "fresh")
        model = self.models.load()
        if not fresh.isEmpty():
            self._score_and_store(fresh, model, batch_id, days)
            # last, because it decides what is new in a repeated batch
            append_batch(raw_projection(fresh, None, "day"), self.path("transactions_raw"), KEY, self.writer, batch_id, days)
            self._train_if_due(model)

    def _quarantine(self, staged: DataFrame) -> None:
        """Each bad record once, whatever is replayed; batches without any touch nothing."""
        bad = quarantined(staged, KEY).withColumn("digest", F.sha2("record", 256))
        if not bad.isEmpty():
            append_first_wins(bad, self.path("quarantine"), "digest", [F.col("reason")], F.current_date())

    def _score_and_store(self, rows: DataFrame, model: ActiveModel | None, batch_id: int,
                         days: list) -> None:
        known = no_profiles(self.spark) if self.profiles is None else self.profiles()
        joined = with_profile(rows, profiles_in_use(rows, known))
        features = joined.select(
            KEY, "arrival", "day", *feature_columns(),
            F.struct(*[F.col(c) for c in joined.columns if c not in (KEY, "day")]).alias("tx"))
        score = F.lit(-1.0)
        if model is not None:
            offset = F.lit(model.forest.offset)
            score = F.coalesce(
                S.anomaly_probability(self._score_column(model), offset), F.lit(-1.0))
        scored = self._staged(features.withColumn("score", score), batch_id, "scored")
        warmed_up = model is not None and model.warmed_up(self.session_id)
        version = F.lit(None if model is None else model.version).cast("bigint")
        enriched = enriched_projection(
            scored.select(KEY, "day", "tx.*", "score"), warmed_up, self.threshold, None, "score", "day"
        ).withColumn("model_version", version)
        alerts = alert_projection(enriched, None, "day")
        # all three tables lie under the day of the event, where duplicates are looked for
        for name, frame in (("transactions_enriched", enriched), ("fraud_alerts", alerts)):
            append_batch(frame, self.path(name), None, self.writer, batch_id, days)
        self._publish("alerts", alerts.drop("day"), batch_id)
        self._publish("scores", score_feed(enriched), batch_id)
        self._publish("enriched", enriched.drop("day"), batch_id)
        # the counters ride on the one write that reads every scored row exactly once
        marked = scored.withColumns({
            "fraud_score": S.stored_score(F.col("score")),
            "is_suspicious": S.is_suspicious(F.col("score"), self.threshold),
            "is_warmed_up": F.lit(warmed_up)})
        counted, counters = observed_counters(marked, f"batch-{self.session_id}-{batch_id}")
        counted.select(
            KEY, *schemas.FEATURE_NAMES, "arrival", F.lit(self.session_id).alias("session_id"),
        ).write.mode("overwrite").parquet(batch_path(self.path("features"), self.writer, batch_id))
        self._note_batch(batch_id, counters.get["rows"])
        self._log_batch(batch_id, counters.get)

    def _score_column(self, model: ActiveModel) -> Column:
        """The score expression of a model; its nodes are shipped once per version, not per batch."""
        if self._scorer is None or self._scorer[0] != model.version:
            self._scorer = (model.version, anomaly_score(model.forest))
        return self._scorer[1]

    def _publish(self, feed: str, rows: DataFrame, batch_id: int) -> None:
        """Send one feed if it is switched on: through an outbox to a topic (``topic.<feed>``) or other
        append-only sink, else as files of the batch."""
        if feed not in self.feeds:
            return
        options = {k: v for k, v in self.feed_options.items() if not k.startswith("topic.")}
        if f"topic.{feed}" in self.feed_options:
            options["topic"] = self.feed_options[f"topic.{feed}"]
        if self.feed_send is None and self.feed_format != "kafka":
            publish(rows, self.feed_format, options, batch_path(self.path(f"feed_{feed}"), self.writer, batch_id), KEY)
            return
        outbox = Outbox(self.spark, self.path(f"outbox_{feed}"))
        outbox.put(as_feed(rows, KEY), self.writer, batch_id)

        def send(due: DataFrame) -> None:
            if self.feed_send is not None:
                self.feed_send(feed, due)
            else:
                to_topic(due, options)

        outbox.publish(send, None if self.feed_sent is None else lambda: self.feed_sent(feed))

    def _log_batch(self, batch_id: int, counters: dict) -> None:
        log.info("batch %s %s", batch_id, counters)
        row = (self.session_id, counters["rows"], counters["alerts"], counters["total_scored"],
               counters["total_at_threshold"])
        self.spark.createDataFrame(
            [row], "session_id string, rows bigint, alerts bigint, total_scored bigint, "
                   "total_at_threshold bigint",
        ).coalesce(1).write.mode("overwrite").parquet(
            batch_path(self.path("batch_log"), self.writer, batch_id))

    # --- training between batches -----------------------------------------------------

    def _note_batch(self, batch_id: int, rows: int) -> None:
        """Remember where the warm-up ends and the window begins: a few numbers per session.

        Features of batches that neither needs any more are removed.
        """
        if self._first_batch is None:
            self._first_batch = batch_id
            self._drop_features(lambda number: number < batch_id)
        if self._tail and self._tail[-1][0] == batch_id:  # a repeated attempt
            self._seen -= self._tail.pop()[1]
        if self._seen < self.policy.warmup_size:
            self._warmup_until = batch_id
        self._seen += rows
        self._tail.append((batch_id, rows))
        passed = []
        while sum(n for _, n in self._tail[1:]) >= self.policy.window_size:
            passed.append(self._tail.pop(0)[0])
        gone = [number for number in passed if number > self._warmup_until]
        if gone:
            self._drop_features(lambda number: number in gone)
        self._save_session(batch_id)

    def _session_path(self, batch_id: int) -> str:
        return os.path.join(self.path("session"), f"written_by={self.writer}", f"{batch_id:012d}")

    def _save_session(self, batch_id: int) -> None:
        """The few numbers of ``_note_batch`` as they are after a batch; the last two batches' are kept."""
        state = {"session_id": self.session_id, "seen": self._seen, "warmup_until": self._warmup_until,
                 "first_batch": self._first_batch, "tail": self._tail}
        delete_path(self.spark, self._session_path(batch_id))  # of an earlier attempt
        create_file(self.spark, self._session_path(batch_id), json.dumps(state))
        for old in self._saved_sessions()[2:]:
            delete_path(self.spark, self._session_path(old))

    def _saved_sessions(self) -> list[int]:
        folder = os.path.dirname(self._session_path(0))
        return sorted((int(s.getPath().getName()) for s in children(self.spark, folder)
                       if s.getPath().getName().isdigit()), reverse=True)

    def _resume_session(self) -> None:
        """Go on where the query's last session stopped; a repeated batch is counted once."""
        for batch_id in self._saved_sessions():
            try:
                state = json.loads(read_file(self.spark, self._session_path(batch_id)))
            except ValueError:
                continue
            self.session_id, self._seen, self._warmup_until = state["session_id"], state["seen"], state["warmup_until"]
            self._first_batch, self._tail = state["first_batch"], [tuple(t) for t in state["tail"]]
            return

    def _drop_features(self, condition: Callable[[int], bool]) -> None:
        for number, path in batch_folders(self.spark, self.path("features"), self.writer):
            if condition(number):
                delete_path(self.spark, path)

    def session_features(self) -> DataFrame:
        schema = T.StructType(
            [T.StructField(KEY, T.StringType())]
            + [T.StructField(name, T.DoubleType()) for name in schemas.FEATURE_NAMES]
            + [T.StructField("arrival", T.LongType()), T.StructField("session_id", T.StringType()),
               T.StructField("written_by", T.StringType()), T.StructField("batch_id", T.LongType())])
        return self.spark.read.schema(schema).parquet(self.path("features")).filter(
            (F.col("written_by") == self.writer) & (F.col("session_id") == self.session_id))

    def warmup_rows(self) -> DataFrame:
        """The first rows of the session; only the batches that hold them are read."""
        return self.session_features().filter(F.col("batch_id") <= self._warmup_until).orderBy(
            "batch_id", "arrival").limit(self.policy.warmup_size)

    def window_rows(self) -> DataFrame:
        """The last rows of the session; only the batches that hold them are read."""
        return self.session_features().filter(F.col("batch_id") >= self._tail[0][0]).orderBy(
            F.desc("batch_id"), F.desc("arrival")).limit(self.policy.window_size)

    def _train_if_due(self, model: ActiveModel | None) -> None:
        now = self.clock()
        if self.policy.warmup_due(model, self.session_id, self._seen):
            self._train(self.warmup_rows(), now)
        elif self.policy.retrain_due(model, self.session_id, self._seen, now):
            self._train(self.window_rows(), now)

    def _train(self, rows: DataFrame, now: float) -> None:
        """A failed training keeps the current model."""
        training = rows.persist()
        try:
            self.models.train(training, KEY, schemas.FEATURE_NAMES, self.forest, self.session_id, now)
        except Exception as error:
            log.error("training failed, the current model stays: %s", error)
        finally:
            training.unpersist()

    # --- stream -----------------------------------------------------------------------

    def start(self, raw: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Run over a stream of messages. Every start is a session of its own, unless it resumes the last one."""
        self._begin_session(new_session_id(), checkpoint)
        if self.resume and path_exists(self.spark, os.path.join(checkpoint, "metadata")):
            self._resume_session()
        parsed = parse_events(raw, schemas.TRANSACTION)
        if self.memory is not None:
            parsed = with_witnesses(parsed, KEY, self.memory)
        return (
            parsed.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
        )

    def table(self, name: str) -> DataFrame | None:
        return stored_table(self.spark, self.path(name))
