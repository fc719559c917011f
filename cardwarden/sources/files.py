"""Batch files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
             schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files: inference reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df
