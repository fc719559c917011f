"""Stored documents as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden import schemas
from cardwarden.functions import scalars as S
from cardwarden.functions.features import engineered


def utc_now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def raw_projection(tx: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    return tx.select(
        "transaccionID", "usuarioID", "tarjetaID", "fecha_hora_transaccion", "TransactionAmt",
        "TransactionDT", "isFraud", (utc_now() if now is None else now).alias("ingested_at"), *more)


def enriched_projection(tx: DataFrame, warmed_up: bool, threshold: float = C.THRESHOLD,
                        now: Column | None = None, score: str = "score", *more: str) -> DataFrame:
    """The 37-column enriched document. Suspicion uses the unrounded score, storage rounds it.

    ``more`` names columns of ``tx`` that are kept behind it.
    """
    computed = {
        **engineered(),
        "fraud_score": S.stored_score(F.col(score)),
        "is_suspicious": S.is_suspicious(F.col(score), threshold),
        "model_ready": F.lit(warmed_up),
        "is_warmed_up": F.lit(warmed_up),
        "processed_at": utc_now() if now is None else now,
    }
    return tx.withColumns(computed).select(*schemas.ENRICHED_COLUMNS, *more)


def alert_projection(enriched: DataFrame, now: Column | None = None, *more: str) -> DataFrame:
    """One pending alert per suspicious row of a warmed-up model."""
    gate = F.col("is_warmed_up") & F.col("is_suspicious")
    return enriched.filter(gate).select(
        "transaccionID", "usuarioID", "tarjetaID", "TransactionAmt", "fraud_score",
        "zscore_amt", "velocity", F.col("isFraud").alias("isFraud_label"),
        (utc_now() if now is None else now).alias("alerted_at"),
        F.lit("flagged").alias("status"),
        F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), *more)


def score_feed(enriched: DataFrame) -> DataFrame:
    return enriched.filter("fraud_score is not null").select("transaccionID", "fraud_score")
