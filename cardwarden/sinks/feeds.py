"""Keyed JSON feeds and the sinks used when storage is off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cardwarden import schemas


# keep microseconds: the JSON writer cuts timestamps to milliseconds by default
JSON_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def as_feed(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON text in ``value``, timestamps included, with an optional ``key``."""
    value = F.to_json(F.struct("*"), JSON_TIMES).alias("value")
    return df.select(value) if key is None else df.select(
        F.col(key).cast("string").alias("key"), value)


def publish(df: DataFrame, fmt: str, options: dict[str, str] | None, path: str, key: str | None = None) -> None:
    """Replace the files of a path (``json``, ``parquet``...): a batch's own path makes them replay-safe."""
    as_feed(df, key).write.format(fmt).options(**(options or {})).mode("overwrite").save(path)


def to_topic(numbered: DataFrame, options: dict[str, str]) -> None:
    """Send ``(number, key, value)`` rows to a topic; the number goes along as a header."""
    number = F.struct(F.lit("number").alias("key"), F.col("number").cast("string").cast("binary").alias("value"))
    numbered.select("key", "value", F.array(number).alias("headers")).write.format("kafka").options(**options).save()


def discard(df: DataFrame) -> None:
    """Compute everything and store nothing."""
    df.write.format("noop").mode("overwrite").save()


def no_profiles(spark: SparkSession) -> DataFrame:
    """The empty profile source: every lookup misses."""
    return spark.createDataFrame([], schemas.PROFILE)
