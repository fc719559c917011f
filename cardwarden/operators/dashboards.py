"""Monitoring queries over enriched rows and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cardwarden import constants as C
from cardwarden.functions.scalars import exact_mean
from cardwarden.sinks.tables import DimensionTable
from cardwarden.sources.events import with_arrival


def _counters() -> list:
    scored = F.col("fraud_score").isNotNull()
    return [
        F.count("*").alias("rows"),
        F.count_if(F.col("is_warmed_up") & F.col("is_suspicious")).alias("alerts"),
        F.count_if(scored).alias("total_scored"),
        F.count_if(scored & F.col("is_suspicious")).alias("total_at_threshold"),
    ]


def batch_counters(enriched: DataFrame) -> DataFrame:
    """Rows, alerts written, rows scored, and scores at the threshold whether or not warmed up."""
    return enriched.agg(*_counters())


def session_counters(log: DataFrame) -> DataFrame:
    """Running totals per session after each of its batches, from the batch log."""
    so_far = Window.partitionBy("session_id").orderBy("batch_id").rowsBetween(
        Window.unboundedPreceding, 0)
    return log.select("session_id", "batch_id", *[
        F.sum(c).over(so_far).alias(c) for c in ("rows", "alerts", "total_scored", "total_at_threshold")])


def observed_counters(enriched: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same counters collected while the frame is written: no extra pass."""
    observation = Observation(name)
    return enriched.observe(observation, *_counters()), observation


def fraud_rate_drift(tx: DataFrame, time: str = "fecha_hora_transaccion", every: str = "1 day",
                     expected: float = C.RULE_BASE) -> DataFrame:
    """Fraud rate per time window and its running value against the expected rate."""
    per_window = tx.groupBy(F.window(time, every).alias("w")).agg(
        F.count("*").alias("n"), F.sum("isFraud").alias("frauds"))
    so_far = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_window.select(F.col("w.start").alias("window_start"), "n", "frauds")
        .withColumns({
            "rate": F.col("frauds") / F.col("n"),
            "running_rate": F.sum("frauds").over(so_far) / F.sum("n").over(so_far),
        })
        .withColumn("drift", F.col("running_rate") - F.lit(expected))
    )


RATES = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("n", T.LongType()),
    T.StructField("frauds", T.LongType()), T.StructField("rate", T.DoubleType())])


def fraud_rate_stream(tx: DataFrame, time: str, every: str = "1 day",
                      late: str = "1 hour") -> DataFrame:
    """The per-window rate over a stream; the watermark bounds the state."""
    timed = tx.withColumn(time, F.col(time).cast("timestamp"))  # what a watermark accepts
    return (
        timed.withWatermark(time, late).groupBy(F.window(time, every).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("isFraud").alias("frauds"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "frauds",
                (F.col("frauds") / F.col("n")).alias("rate"))
    )


def rate_table(spark, path: str) -> DimensionTable:
    return DimensionTable(spark, path, "window_start", RATES, buckets=1)


def start_fraud_rates(tx: DataFrame, time: str, table: DimensionTable, checkpoint: str,
                      session_id: str, trigger: dict | None = None, every: str = "1 day") -> StreamingQuery:
    """Keep the rate of every window current, the open ones included: one upsert per changed window."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.upsert(with_arrival(batch), session_id, batch_id)

    return (
        fraud_rate_stream(tx, time, every).writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def dimension_breakdown(enriched: DataFrame, dimensions: list[str], every: str = "1 day") -> DataFrame:
    """Rows, suspicious rows and mean score per dimension value and time window."""
    long = enriched.select("processed_at", "fraud_score", *dimensions).unpivot(
        ["processed_at", "fraud_score"], dimensions, "dimension", "value")
    return (
        long.groupBy(F.window("processed_at", every).alias("w"), "dimension", "value")
        .agg(F.count("*").alias("n"),
             F.count_if(F.col("fraud_score") >= C.THRESHOLD).alias("suspicious"),
             exact_mean(F.col("fraud_score")).alias("mean_score"))
        .select(F.col("w.start").alias("window_start"), "dimension", "value", "n", "suspicious",
                "mean_score")
    )


def alert_triage(alerts: DataFrame) -> DataFrame:
    """Alerts, share of all alerts and mean minutes to review per status."""
    per_status = alerts.groupBy("status").agg(
        F.count("*").alias("n"), F.avg("review_minutes").alias("mean_minutes"))
    total = Window.partitionBy()
    return per_status.withColumn("share", F.col("n") / F.sum("n").over(total))


def handled_share(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("n"),
        F.avg((F.col("status") != "flagged").cast("int")).alias("handled_share"))


def top_alerts(alerts: DataFrame, k: int, score: str = "fraud_score", time: str = "alerted_at",
               key: str = "transaccionID") -> DataFrame:
    """Highest scores first, then the most recent."""
    return alerts.orderBy(F.desc(score), F.desc(time), key).limit(k)


def latest_alerts(alerts: DataFrame, k: int, time: str = "alerted_at",
                  key: str = "transaccionID") -> DataFrame:
    return alerts.orderBy(F.desc(time), key).limit(k)
