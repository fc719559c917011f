"""Keyed memory of a stream: which ids it has seen, kept in its state store.

The state lives in the query's checkpoint, one small entry per id, and goes when the id is older than
the memory. It says in which micro-batch an id came first; which of the rows in that batch is the first
one is decided by arrival, in the batch. Both come from one read of the source: the stream is united
with one witness per new id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECEIVED, WITNESS = "received_at", "is_witness"


def with_witnesses(parsed: DataFrame, key: str, memory: str) -> DataFrame:
    """All rows of a stream, and for each id that comes for the first time within ``memory`` a row that says so.

    The clock is the micro-batch's, which a repeated batch takes from the log, so late, early and
    undated events are remembered alike.
    """
    stamped = parsed.withColumn(RECEIVED, F.current_timestamp())
    witness = stamped.filter(F.col(key).isNotNull()).select(key, RECEIVED).withWatermark(
        RECEIVED, memory).dropDuplicatesWithinWatermark([key]).select(key, F.lit(True).alias(WITNESS))
    return stamped.drop(RECEIVED).withColumn(WITNESS, F.lit(False)).unionByName(witness, allowMissingColumns=True)


def split_witnesses(batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of a micro-batch, and the ids that are new to the stream (``None`` without a memory)."""
    if WITNESS not in batch.columns:
        return batch, None
    return batch.filter(~F.col(WITNESS)).drop(WITNESS), batch.filter(WITNESS).select(key)


