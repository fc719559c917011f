"""Topics kept as log segments in files: a streaming source with partitions, offsets and bounded batches.

A topic is a folder ``partition=<p>/base=<first offset>/`` with one text file each, a message per line. The source
takes the options of the broker's source (``subscribe``, ``startingOffsets``, ``maxOffsetsPerTrigger``,
``failOnDataLoss``) and gives the same columns, so a stream runs on either. ``write_segments`` makes such a topic.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cardwarden.plans.selection import sequence_numbers

FORMAT = "segments"
SCHEMA = "partition int, offset bigint, value string"


def write_segments(df: DataFrame, path: str, partition: Column, order: list[str], segment_rows: int = 100_000) -> None:
    """Append-ordered messages (``value``) as a topic: offsets from 0 in each partition, by ``order``."""
    keyed = df.withColumn("partition", partition.cast("int"))
    numbered = sequence_numbers(keyed, ["partition", *order])
    first = numbered.groupBy("partition").agg(F.min("sequence").alias("first"))
    offset = F.col("sequence") - F.col("first")
    placed = numbered.join(F.broadcast(first), "partition").select(  # a row for each partition of a topic
        "partition", (offset - offset % segment_rows).alias("base"), offset.alias("offset"), "value")
    placed.repartition("partition", "base").sortWithinPartitions("partition", "base", "offset").select(
        "partition", "base", "value").write.partitionBy("partition", "base").text(path)


@dataclass
class Slice(InputPartition):
    """Offsets ``[start, end)`` of one partition."""

    partition: int
    start: int
    end: int


class SegmentReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = f"{options['path'].rstrip('/')}/{options['subscribe']}"
        self.most = int(options.get("maxOffsetsPerTrigger", "0")) or None
        self.from_start = options.get("startingOffsets", "latest") == "earliest"
        self.strict = options.get("failOnDataLoss", "true").lower() == "true"
        self.progress = options.get("progressFile")
        self.at: dict[str, int] | None = None

    # --- files ------------------------------------------------------------------------

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _segments(self) -> dict[int, list[tuple[int, str]]]:
        """Per partition its segments as (first offset, file), in order."""
        system, root = self._open()
        found: dict[int, list[tuple[int, str]]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = info.path[len(root):].strip("/").split("/")
            if info.type == fs.FileType.File and len(parts) == 3 and not parts[2].startswith((".", "_")):
                found.setdefault(int(parts[0].removeprefix("partition=")), []).append((int(parts[1].removeprefix("base=")), info.path))
        return {p: sorted(s) for p, s in found.items()}

    def _lines(self, file: str) -> list[str]:
        with self._open()[0].open_input_stream(file) as stream:
            return stream.read().decode().splitlines()

    def _bounds(self) -> dict[str, tuple[int, int]]:
        """Per partition the first offset that is there and the one after the last."""
        return {str(p): (s[0][0], s[-1][0] + len(self._lines(s[-1][1]))) for p, s in self._segments().items()}

    # --- offsets ----------------------------------------------------------------------

    def initialOffset(self) -> dict:
        self.at = {p: low if self.from_start else high for p, (low, high) in self._bounds().items()}
        return dict(self.at)

    def latestOffset(self) -> dict:
        """At most ``maxOffsetsPerTrigger`` messages further than the last batch, shared by the partitions by what they hold."""
        if self.at is None:
            self.at = self._stored()
        bounds = self._bounds()
        due = {p: max(0, high - self.at.get(p, low)) for p, (low, high) in bounds.items()}
        total = sum(due.values())
        if self.most is not None and total > self.most:
            shares = {p: n * self.most // total for p, n in due.items()}
            for p in sorted(due, key=lambda p: (-(due[p] - shares[p]), int(p)))[:self.most - sum(shares.values())]:
                shares[p] += 1
            due = shares
        self.at = {p: self.at.get(p, bounds[p][0]) + n for p, n in due.items()} | {
            p: n for p, n in self.at.items() if p not in bounds}
        return dict(self.at)

    def _stored(self) -> dict[str, int]:
        """Where a restarted query stands: the end of the last batch that was planned, which Spark repeats if need be."""
        if self.progress:
            system = self._open()[0]
            if system.get_file_info(self.progress).type == fs.FileType.File:
                with system.open_input_stream(self.progress) as stream:
                    return json.loads(stream.read())
        return self.initialOffset()

    def _store(self, end: dict[str, int]) -> None:
        self.at = {p: max(n, (self.at or {}).get(p, 0)) for p, n in end.items()}
        if self.progress:
            with self._open()[0].open_output_stream(self.progress) as out:
                out.write(json.dumps(end).encode())

    def commit(self, end: dict) -> None:
        """Nothing to let go of: segments stay."""

    # --- rows -------------------------------------------------------------------------

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self._store(end)
        bounds = self._bounds()
        slices = []
        for p, high in end.items():
            low = start.get(p, 0)
            there = bounds.get(p, (high, high))[0]
            if low < min(there, high):
                if self.strict:
                    raise ValueError(f"offsets {low} to {there} of partition {p} are lost")
                low = min(there, high)
            if low < high:
                slices.append(Slice(int(p), low, high))
        return slices

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        segments = self._segments().get(partition.partition, [])
        for k, (base, file) in enumerate(segments):
            after = segments[k + 1][0] if k + 1 < len(segments) else partition.end
            if base >= partition.end or after <= partition.start:
                continue
            low = max(0, partition.start - base)
            lines = self._lines(file)[low:partition.end - base]
            offsets = pa.array(range(base + low, base + low + len(lines)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.partition] * len(lines), pa.int32()), offsets, pa.array(lines, pa.string())],
                names=["partition", "offset", "value"])


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SegmentReader:
        return SegmentReader(self.options)


def register(spark: SparkSession) -> str:
    """Make the source known to a session; its format name."""
    spark.dataSource.register(SegmentSource)
    return FORMAT
