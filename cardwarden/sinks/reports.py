"""Result files and the metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(frames: dict[str, DataFrame], folder: str) -> None:
    """Named result frames as JSON folders next to each other."""
    for name, frame in frames.items():
        write_json(frame, f"{folder.rstrip('/')}/{name}")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append the row of one evaluation; an undefined evaluation gives no row."""
    metrics.write.mode("append").parquet(path)
