"""Keyed JSON event streams: reader options, parsing and the split of malformed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
POSITION = ("partition", "offset")


def kafka_options(servers: str, topic: str, max_offsets: int = 200) -> dict[str, str]:
    """Bounded micro-batches from the newest offset on, tolerant of lost segments."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": str(max_offsets),
    }


def read_events(spark: SparkSession, fmt: str, options: dict[str, str] | None = None,
                path: str | None = None, schema: T.StructType | None = None,
                streaming: bool = True) -> DataFrame:
    """A frame with a ``value`` column from any source Spark knows (kafka, text, parquet...)."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def parse_events(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Bytes to text to typed columns, plus the text of records that did not fit the schema.

    The source position (partition, offset) is kept where the source has one, so
    later steps can order rows by arrival.
    """
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    data = F.from_json(
        F.col("value").cast("string"), full,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    position = [c for c in POSITION if c in raw.columns]
    return raw.select(*position, data.alias("data")).select(*position, "data.*")


def accepted(parsed: DataFrame, key: str) -> DataFrame:
    """Records that carry their key; a wrong-typed field stays null."""
    return parsed.filter(F.col(key).isNotNull()).drop(CORRUPT)


def quarantined(parsed: DataFrame, key: str) -> DataFrame:
    """Records that failed to parse in part or whole, with the reason."""
    reason = F.when(F.col(key).isNull(), "unreadable").otherwise("wrong_type")
    return parsed.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(key), F.col(CORRUPT).alias("record"), reason.alias("reason"))


def with_arrival(df: DataFrame) -> DataFrame:
    """One sortable arrival number per row of a micro-batch."""
    if all(c in df.columns for c in POSITION):
        number = F.col("offset") * F.lit(1 << 16) + F.col("partition")
        return df.withColumn("arrival", number).drop(*POSITION)
    return df.drop(*POSITION).withColumn("arrival", F.monotonically_increasing_id())
