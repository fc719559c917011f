"""Streams that keep the user and card dimensions current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cardwarden import schemas
from cardwarden.sinks.tables import DimensionTable
from cardwarden.sources.events import accepted, parse_events, with_arrival
from cardwarden.streaming.scoring import new_session_id


def start_upserts(raw: DataFrame, schema: T.StructType, table: DimensionTable, checkpoint: str,
                  trigger: dict | None = None, compact_every: int = 100) -> StreamingQuery:
    """Messages to the latest row per key. Appended rows are folded in every so many batches."""
    session_id = new_session_id()

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.upsert(accepted(with_arrival(batch), table.key), session_id, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(grace=True)

    return (
        parse_events(raw, schema).writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def user_table(spark: SparkSession, path: str) -> DimensionTable:
    return DimensionTable(spark, path, "usuarioID", schemas.USER)


def card_table(spark: SparkSession, path: str) -> DimensionTable:
    return DimensionTable(spark, path, "tarjetaID", schemas.CARD)
