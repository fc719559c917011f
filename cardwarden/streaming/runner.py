"""Several streams started, supervised and stopped together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class StreamGroup:
    """Named stream starters; waiting ends when any of them ends."""

    def __init__(self, spark: SparkSession, starters: dict[str, Callable[[], StreamingQuery]]):
        self.spark, self.starters = spark, starters
        self.queries: dict[str, StreamingQuery] = {}

    def start(self) -> "StreamGroup":
        self.spark.streams.resetTerminated()  # streams that ended before do not count
        for name, starter in self.starters.items():
            self.queries[name] = starter()
        return self

    def await_termination(self, timeout: int | None = None) -> bool | None:
        if not self.queries:
            raise RuntimeError("the streams are not started: call start() first")
        return self.spark.streams.awaitAnyTermination(timeout)

    def stop(self) -> None:
        for query in self.queries.values():
            query.stop()
