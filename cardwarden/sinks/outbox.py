"""Feeds to append-only sinks (topics): an outbox with gapless numbers and a stored mark of what was sent.

A batch's rows are put into the outbox once, whatever is repeated: entries are numbered files that are created,
never changed, and each says which batch every writer has put last. Rows have consecutive numbers over
all entries. Publishing sends what lies above the mark and then moves the mark. If it dies in between, the sink itself is
asked for the highest number it holds, so nothing is sent twice; a sink that cannot tell gets those rows again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.plans.selection import sequence_numbers
from cardwarden.session import delete_path
from cardwarden.sinks.daytable import children, create_file, read_file

ROWS = T.StructType([T.StructField("number", T.LongType()), T.StructField("key", T.StringType()),
                     T.StructField("value", T.StringType())])


class Outbox:
    """Rows ``(key, value)`` on their way to one sink."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _part(self, name: str) -> str:
        return os.path.join(self.path, name)

    def _files(self, folder: str) -> list[tuple[int, dict]]:
        """Numbered files of a folder, newest first; one whose writer died half-way is left out."""
        numbers = sorted((int(s.getPath().getName()) for s in children(self.spark, self._part(folder))
                          if s.getPath().getName().isdigit()), reverse=True)
        found = []
        for n in numbers:
            try:
                found.append((n, json.loads(read_file(self.spark, self._part(f"{folder}/{n:012d}")))))
            except ValueError:
                continue
        return found

    def _create(self, folder: str, number: int, held: dict) -> bool:
        return create_file(self.spark, self._part(f"{folder}/{number:012d}"), json.dumps(held))

    def _next_number(self, folder: str) -> int:
        names = [s.getPath().getName() for s in children(self.spark, self._part(folder))]
        return 1 + max((int(n) for n in names if n.isdigit()), default=-1)

    def put(self, feed: DataFrame, writer: str, batch_id: int) -> bool:
        """Add a batch's rows (``key``, ``value``), numbered by key; ``False`` if they are there already."""
        def known(entry: dict | None) -> bool:
            return entry is not None and entry["written"].get(writer, -1) >= batch_id

        newest = next((e for _, e in self._files("entries")), None)
        if known(newest):
            return False
        name = uuid.uuid4().hex
        rows = self._part(f"rows/{name}")
        sequence_numbers(feed.select("key", "value"), ["key", "value"]).select(
            F.col("sequence").alias("number"), "key", "value").write.parquet(rows)
        count = self.spark.read.schema(ROWS).parquet(rows).count()
        while True:
            number, newest = self._next_number("entries"), next((e for _, e in self._files("entries")), None)
            if known(newest):
                delete_path(self.spark, rows)
                return False
            first = 0 if newest is None else newest["first"] + newest["count"]
            written = ({} if newest is None else newest["written"]) | {writer: batch_id}
            if self._create("entries", number, {"first": first, "count": count, "rows": name, "written": written}):
                return True

    def published(self) -> int:
        """How many rows have been sent and marked."""
        return next((m["published"] for _, m in self._files("marks")), 0)

    def publish(self, send: Callable[[DataFrame], None], sent: Callable[[], int | None] | None = None) -> int:
        """Send the rows above the mark, entry by entry in order, and move the mark; how many were sent.

        ``send`` gets ``(number, key, value)``. ``sent`` asks the sink for the highest number it holds
        (``None`` for none).
        """
        mark = self.published()
        if sent is not None:
            highest = sent()
            mark = max(mark, 0 if highest is None else highest + 1)
        before, total = mark, mark
        for _, entry in reversed(self._files("entries")):
            end = entry["first"] + entry["count"]
            if end <= mark:
                continue
            rows = self.spark.read.schema(ROWS).parquet(self._part(f"rows/{entry['rows']}"))
            due = rows.withColumn("number", F.col("number") + F.lit(entry["first"])).filter(F.col("number") >= mark)
            send(due.repartitionByRange("number").sortWithinPartitions("number"))
            mark = total = end
            self._mark(mark)
        if total == before and mark > self.published():
            self._mark(mark)
        self._drop_sent(mark)
        return total - before

    def _mark(self, published: int) -> None:
        number = self._next_number("marks")
        if not self._create("marks", number, {"published": published}):
            raise RuntimeError(f"{self.path} has two publishers")
        for old, _ in self._files("marks")[2:]:
            delete_path(self.spark, self._part(f"marks/{old:012d}"))

    def _drop_sent(self, mark: int) -> None:
        """Remove entries that are sent, but for the newest, which knows what each writer has put."""
        for number, entry in self._files("entries")[1:]:
            if entry["first"] + entry["count"] <= mark:
                delete_path(self.spark, self._part(f"rows/{entry['rows']}"))
                delete_path(self.spark, self._part(f"entries/{number:012d}"))
