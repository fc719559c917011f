"""The data jobs as functions and commands: clean, statistics, train, evaluate, stream, retention."""

from __future__ import annotations

import argparse
import os
import time
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden import schemas
from cardwarden.operators import cleaning, evaluation, joins, profiling
from cardwarden.operators.forest import ForestParams, fit_forest
from cardwarden.operators.model_selection import (
    MODELS, compare_models, evaluate_forest, feature_importance, grid_search, model_frame,
    stratified_split, train_contamination,
)
from cardwarden.session import build_session, scratch_folder, scratch_path, written
from cardwarden.sinks import reports
from cardwarden.sinks.tables import drop_expired, drop_old_batches, full_refresh, stored_table
from cardwarden.sources.events import kafka_options, read_events
from cardwarden.sources.files import read_csv, read_parquet
from cardwarden.streaming.dimensions import card_table, start_upserts, user_table
from cardwarden.streaming.lifecycle import ModelStore
from cardwarden.streaming.runner import StreamGroup
from cardwarden.streaming.scoring import ScoringJob, new_session_id

OFFLINE_KEY = "TransactionID"


def clean_files(spark: SparkSession, transactions: str, identities: str, out: str,
                csv: str | None = None) -> DataFrame:
    """Join transactions with identities, drop sparse columns, fill gaps, store the result.

    ``csv`` is a second place for the result, as text with a header.
    """
    joined = joins.with_identity(
        read_csv(spark, transactions), read_csv(spark, identities), OFFLINE_KEY)
    with scratch_folder(spark, "clean") as folder:
        # written once before the passes that measure gaps, medians and modes
        full_refresh(cleaning.clean(written(joined, "joined", folder)), out)
    cleaned = read_parquet(spark, out)
    if csv:
        reports.write_csv(cleaned, csv)
    return cleaned


def statistics(spark: SparkSession, cleaned: str, out: str) -> None:
    """Global, numeric, categorical and correlation statistics of the 25 chosen columns."""
    rows = read_parquet(spark, cleaned, [*C.TOP_25_FEATURES, "isFraud"])
    chosen = [c for c in rows.columns if c != "isFraud"]
    numeric = [c for c in cleaning.numeric_columns(rows) if c in chosen]
    texts = [c for c in cleaning.text_columns(rows) if c in chosen]
    reports.write_report(profiling.statistics_report(rows, numeric, texts), out)


def train(spark: SparkSession, cleaned: str, out: str, model: str = "top_25") -> DataFrame:
    """Split, fit one of the named models, store it and return its quality on the test rows."""
    columns, trees, samples, share = MODELS[model]
    with scratch_folder(spark, "train") as folder:
        split = stratified_split(read_parquet(spark, cleaned), OFFLINE_KEY)
        chosen = columns or [c for c in split.columns if c not in (OFFLINE_KEY, "isFraud", "is_test")]
        frame, features = model_frame(split, chosen, [OFFLINE_KEY, "isFraud", "is_test"])
        frame = written(frame, "frame", folder)
        rows = frame.filter(~F.col("is_test"))
        params = ForestParams(trees, samples, share, train_contamination(rows))
        forest = fit_forest(rows, OFFLINE_KEY, features, params, scratch_path(spark, "nodes", folder))
        ModelStore(spark, out).save(forest, f"offline-{model}", time.time())
        return evaluate_forest(forest, frame.filter("is_test"), model)


def experiments(spark: SparkSession, cleaned: str, out: str) -> None:
    """All named models, the grid over the 15-column set, and the feature ranking."""
    rows = read_parquet(spark, cleaned)
    reports.write_report({
        "models": compare_models(rows, OFFLINE_KEY, []),
        "grid": grid_search(rows, OFFLINE_KEY),
        "importance": feature_importance(rows, OFFLINE_KEY),
    }, out)


def evaluate(spark: SparkSession, enriched: str, metrics: str | None = None,
             threshold: float = C.THRESHOLD, min_samples: int = C.MIN_EVALUATION_ROWS,
             model_version: str = C.MODEL_VERSION, include_warmup: bool = False) -> dict[str, DataFrame]:
    """Summary, confusion counts, per-class report and the metrics row of a stored enriched table."""
    rows = evaluation.evaluable(stored_table(spark, enriched), not include_warmup)
    confusion = evaluation.confusion_counts(evaluation.with_prediction(rows, threshold))
    frames = {
        "summary": evaluation.evaluation_summary(rows, threshold, min_samples),
        "confusion": evaluation.classification_metrics(confusion),
        "report": evaluation.class_report(confusion),
        "metrics": evaluation.model_metrics(rows, threshold, model_version),
    }
    if metrics:
        reports.append_metrics(frames["metrics"], metrics)
    return frames


#: Tables of a stream folder under event days, and those in one folder per batch.
DATED = ("transactions_raw", "transactions_enriched", "fraud_alerts", "quarantine")
BATCHED = ("features", "batch_log", "feed_alerts", "feed_scores", "feed_enriched")


def retention(spark: SparkSession, folder: str, today: str | None = None) -> dict[str, list[str] | int]:
    """Drop what is older than its retention: whole days of stored tables, old batches of the rest.

    Days are event days; quarantined records go by the day they came. Tables without a period
    of their own keep as long as the enriched table. Dimensions drop folded rows themselves.
    """
    now = date.fromisoformat(today) if today else datetime.now(timezone.utc).date()

    def oldest(table: str) -> str:
        days = C.RETENTION_DAYS.get(table, C.RETENTION_DAYS["transactions_enriched"])
        return (now - timedelta(days=days)).isoformat()

    dropped: dict[str, list[str] | int] = {
        t: drop_expired(spark, os.path.join(folder, t), oldest(t)) for t in DATED}
    return dropped | {t: drop_old_batches(spark, os.path.join(folder, t), oldest(t)) for t in BATCHED}


def stream_group(spark: SparkSession, servers: str, folder: str, topics: dict[str, str],
                 max_offsets: int = 200, trigger: str = "5 seconds") -> StreamGroup:
    """The scoring, user and card streams over topics; profiles come from the user table."""
    when = {"processingTime": trigger}
    users, cards = user_table(spark, os.path.join(folder, "users")), card_table(
        spark, os.path.join(folder, "cards"))

    def profiles() -> DataFrame:
        return users.snapshot().select(*schemas.PROFILE.names)

    job = ScoringJob(
        spark, folder, profiles=profiles, feed_format="kafka", session_id=new_session_id(),
        feed_options={"kafka.bootstrap.servers": servers, "topic.alerts": topics["alerts"],
                      "topic.scores": topics["scores"], "topic.enriched": topics["enriched"]},
        feeds=("alerts", "scores", "enriched"))

    def source(topic: str) -> DataFrame:
        return read_events(spark, "kafka", kafka_options(servers, topics[topic], max_offsets))

    def checkpoint(name: str) -> str:
        return os.path.join(folder, "checkpoints", name)

    return StreamGroup(spark, {
        "transactions": lambda: job.start(source("transactions"), checkpoint("transactions"), when),
        "users": lambda: start_upserts(
            source("users"), schemas.USER, users, checkpoint("users"), when),
        "cards": lambda: start_upserts(
            source("cards"), schemas.CARD, cards, checkpoint("cards"), when),
    })


TOPICS = {
    "transactions": "transactions.raw", "users": "users", "cards": "cards",
    "alerts": "fraud.alerts", "scores": "fraud.scores", "enriched": "transactions.enriched",
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cardwarden.jobs")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, paths in {
        "clean": ["transactions", "identities", "out"], "statistics": ["cleaned", "out"],
        "experiments": ["cleaned", "out"], "train": ["cleaned", "out"], "evaluate": ["enriched"],
        "stream": ["servers", "folder"], "retention": ["folder"],
    }.items():
        command = commands.add_parser(name)
        for path in paths:
            command.add_argument(path)
        if name == "clean":
            command.add_argument("--csv")
        if name == "train":
            command.add_argument("--model", choices=sorted(MODELS), default="top_25")
        if name == "evaluate":
            command.add_argument("--metrics")
            command.add_argument("--threshold", type=float, default=C.THRESHOLD)
            command.add_argument("--min-samples", type=int, default=C.MIN_EVALUATION_ROWS)
            command.add_argument("--model-version", default=C.MODEL_VERSION)
            command.add_argument("--include-warmup", action="store_true")
        if name == "stream":
            for topic, default in TOPICS.items():
                command.add_argument(f"--{topic}-topic", default=default)
    args = vars(parser.parse_args(argv))
    job = args.pop("job")
    spark = build_session(f"cardwarden-{job}")
    if job == "clean":
        clean_files(spark, **args)
    elif job == "statistics":
        statistics(spark, **args)
    elif job == "experiments":
        experiments(spark, **args)
    elif job == "train":
        train(spark, **args).show(truncate=False)
    elif job == "retention":
        print(retention(spark, **args))
    elif job == "evaluate":
        for frame in evaluate(spark, **args).values():
            frame.show(truncate=False)
    else:
        topics = {t: args[f"{t}_topic"] for t in TOPICS}
        group = stream_group(spark, args["servers"], args["folder"], topics).start()
        try:
            group.await_termination()
        finally:
            group.stop()


if __name__ == "__main__":
    main()
