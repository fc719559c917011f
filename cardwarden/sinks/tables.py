"""Stored tables on plain parquet: first-write-wins appends, keyed upserts, full refresh, retention."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.operators.joins import not_yet_stored
from cardwarden.plans.selection import first_per_key, latest_per_key
from cardwarden.session import delete_path, path_exists
from cardwarden.sinks.daytable import UNDATED, DayTable, children, create_file, day_text, read_file


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table, an empty frame of the given schema when there is none yet, else ``None``."""
    if path_exists(spark, path):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    return spark.createDataFrame([], schema) if schema is not None else None


def batch_days(df: DataFrame) -> list:
    """The distinct days of a micro-batch, ``None`` for undated rows: what stored tables are pruned by."""
    return [r["day"] for r in df.select("day").distinct().collect()]


def on_days(days: list) -> Column:
    """The condition that a row lies on one of the days; literals, so whole partitions are skipped."""
    dated = [d for d in days if d is not None]
    condition = F.col("day").isin(dated) if dated else F.lit(False)
    return condition | F.col("day").isNull() if None in days else condition


def not_stored_before(rows: DataFrame, path: str, key: str, writer: str, batch_id: int,
                      days: list) -> DataFrame:
    """The rows of a micro-batch whose key no other batch has stored on the batch's days.

    What an earlier attempt of the same batch has stored does not count, so every attempt
    decides alike. Only files that may hold one of the keys are opened.
    """
    return DayTable(rows.sparkSession, path, key).not_stored(rows, writer, batch_id, days, on_days(days))


def append_batch(rows: DataFrame, path: str, key: str | None, writer: str, batch_id: int, days: list) -> list[str]:
    """Append a batch's rows on those of its days that do not have the batch yet, and merge small files.

    With ``key`` the table can be asked for keys (``not_stored_before``).
    """
    table = DayTable(rows.sparkSession, path, key)
    held = table.manifests(map(day_text, days))
    missing = [d for d in days if not held[day_text(d)].has(writer, batch_id)]
    return table.append(rows.filter(on_days(missing)), writer, batch_id) if missing else []


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """One version of a table with manifests, all files of another; ``None`` when there is none yet."""
    if not path_exists(spark, path):
        return None
    table = DayTable(spark, path)
    return table.read() if any(m.version for m in table.manifests(table.days()).values()) else spark.read.parquet(path)


def batch_path(path: str, writer: str, batch_id: int) -> str:
    return os.path.join(path, f"written_by={writer}", f"batch_id={batch_id}")


def append_first_wins(df: DataFrame, path: str, key: str, order: list[Column] | None = None,
                      day: Column | None = None) -> None:
    """Append the rows whose key the table does not hold yet; the first row of a batch wins.

    Without an order the batch is taken to hold each key once already. All stored keys are
    read: this is for tables of few rows. ``day`` partitions the table for retention.
    """
    spark = df.sparkSession
    out = df if day is None else df.withColumn("day", day.cast("date"))
    if path_exists(spark, path):
        # the key keeps its written type: only that column is read
        stored = spark.read.schema(T.StructType([df.schema[key]])).parquet(path)
        out = not_yet_stored(out, stored, key, order)
    elif order is not None:
        out = first_per_key(out, [key], order)
    if day is None:
        out.write.mode("append").parquet(path)
    else:
        out.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace the whole table."""
    df.write.mode("overwrite").parquet(path)


def _changed_on(status) -> str:
    return datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc).date().isoformat()


def drop_expired(spark: SparkSession, path: str, oldest_day: str) -> list[str]:
    """Remove whole day partitions older than the given day (``yyyy-mm-dd``).

    Rows without a day go by the time their files were stored; a table without manifests
    loses them when nothing has been added since that day.
    """
    dropped = []
    for status in children(spark, path):
        name = status.getPath().getName()
        if not name.startswith("day="):
            continue
        day = name[4:]
        if day == UNDATED and DayTable(spark, path).manifest(day).version:
            before = datetime.fromisoformat(oldest_day).replace(tzinfo=timezone.utc).timestamp()
            if DayTable(spark, path).expire(day, before):
                dropped.append(day)
        elif (_changed_on(status) if day == UNDATED else day) < oldest_day:
            delete_path(spark, status.getPath().toString())
            dropped.append(day)
    return sorted(dropped)


def batch_folders(spark: SparkSession, path: str, writer: str) -> list[tuple[int, str]]:
    """(batch number, folder) of what a writer holds in a table of batch folders."""
    held = [s.getPath() for s in children(spark, os.path.join(path, f"written_by={writer}"))]
    return [(int(p.getName()[9:]), p.toString()) for p in held if p.getName().startswith("batch_id=")]


def drop_old_batches(spark: SparkSession, path: str, oldest_day: str) -> int:
    """Remove the batch folders of a table (``written_by=/batch_id=``) last changed before a day."""
    dropped = 0
    for writer in children(spark, path):
        if writer.getPath().getName().startswith("written_by="):
            for batch in children(spark, writer.getPath().toString()):
                if _changed_on(batch) < oldest_day:
                    dropped += delete_path(spark, batch.getPath().toString())
    return dropped


class DimensionTable:
    """A keyed dimension kept current by upserts.

    A micro-batch appends only its own rows, so its cost does not grow with the
    dimension. Reading lays the later rows over the last compacted version, whole
    row by whole row: the newest row per key wins, its nulls included. A version is a
    small file that names, for each hash bucket of keys, the folder that holds it; ``compact``
    rewrites only buckets with appended rows and then creates the file of the new version. Folders
    are written once and never changed. Folded rows and all but the last two versions are removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets
        self._delta_schema = T.StructType(
            schema.fields + [T.StructField("arrival", T.LongType()),
                             T.StructField("session_id", T.StringType()),
                             T.StructField("batch_id", T.LongType())])

    def _part(self, name: str) -> str:
        return os.path.join(self.path, name)

    def upsert(self, batch: DataFrame, session_id: str, batch_id: int) -> None:
        """Store the last row per key of a batch; a retry replaces it. Session ids sort by time."""
        last = latest_per_key(batch, [self.key], [F.col("arrival")])
        last.select(*self.schema.names, "arrival").write.mode("overwrite").parquet(
            self._part(f"deltas/session_id={session_id}/batch_id={batch_id}"))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in children(self.spark, self._part("versions"))]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _pointer_path(self, version: int) -> str:
        return self._part(f"versions/{version}/pointer.json")

    def _pointer(self, versions: list[int] | None = None) -> dict | None:
        """The newest complete version: its number, the last batch in it, and its bucket folders."""
        for version in self._versions() if versions is None else versions:
            try:
                return json.loads(read_file(self.spark, self._pointer_path(version)))
            except (ValueError, Py4JJavaError):  # its writer died half-way
                continue
        return None

    def _bucket_path(self, bucket: str, version: int) -> str:
        return self._part(f"buckets/{version}/bucket={bucket}")

    def _base(self, pointer: dict, buckets: list[str] | None = None) -> DataFrame:
        held = pointer["buckets"]
        paths = [self._bucket_path(b, held[b]) for b in (held if buckets is None else buckets) if b in held]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _deltas_after(self, pointer: dict | None) -> DataFrame:
        deltas = read_table(self.spark, self._part("deltas"), self._delta_schema)
        if pointer is None:
            return deltas
        later = (F.col("session_id") > pointer["session_id"]) | (
            (F.col("session_id") == pointer["session_id"])
            & (F.col("batch_id") > pointer["batch_id"]))
        return deltas.filter(later)

    def _newer(self, pointer: dict | None) -> DataFrame:
        order = [F.col("session_id"), F.col("batch_id"), F.col("arrival")]
        return latest_per_key(self._deltas_after(pointer), [self.key], order).select(*self.schema.names)

    def _laid_over(self, base: DataFrame, newer: DataFrame) -> DataFrame:
        return base.join(newer.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(newer)

    def snapshot(self) -> DataFrame:
        """Current rows, one per key."""
        pointer = self._pointer()
        newer = self._newer(pointer)
        return newer if pointer is None else self._laid_over(self._base(pointer), newer)

    def compact(self, grace: bool = False) -> int | None:
        """Fold appended rows into the buckets of their keys and name the new version; ``None`` when nothing is new.

        With ``grace``, rows folded in just now stay until the next time, for readers that
        have planned with the previous version.
        """
        versions = self._versions()
        pointer = self._pointer(versions)
        newest = self._deltas_after(pointer).agg(
            F.max(F.struct("session_id", "batch_id")).alias("top")).first()["top"]
        if newest is None:
            return None
        version = 1 + (versions[0] if versions else 0)
        count = self.buckets if pointer is None else pointer["n_buckets"]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(count)).alias("bucket")
        newer = self._newer(pointer).persist()
        try:
            changed = [str(r["bucket"]) for r in newer.select(bucket).distinct().collect()]
            rows = newer if pointer is None else self._laid_over(self._base(pointer, changed), newer)
            rows.select("*", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                self._part(f"buckets/{version}"))
        finally:
            newer.unpersist()
        held = ({} if pointer is None else pointer["buckets"]) | {b: version for b in changed}
        self._publish({"version": version, "session_id": newest["session_id"], "batch_id": newest["batch_id"],
                       "n_buckets": count, "buckets": held})
        folded = pointer if grace else {"session_id": newest["session_id"], "batch_id": newest["batch_id"]}
        if folded is not None:
            self._drop_deltas(folded["session_id"], folded["batch_id"])
        self._drop_versions([held, {} if pointer is None else pointer["buckets"]], [version, *versions])
        return version

    def _publish(self, pointer: dict) -> None:
        if not create_file(self.spark, self._pointer_path(pointer["version"]), json.dumps(pointer)):
            raise RuntimeError(f"version {pointer['version']} of {self.path} was written by another compaction")

    def _drop_versions(self, kept: list[dict], versions: list[int]) -> None:
        """Remove all but the last two version files, and bucket folders that neither names."""
        for old in versions[2:]:
            delete_path(self.spark, self._part(f"versions/{old}"))
        named = {(str(v), b) for held in kept for b, v in held.items()}
        for version in children(self.spark, self._part("buckets")):
            number = version.getPath().getName()
            folders = [s.getPath() for s in children(self.spark, version.getPath().toString()) if s.isDirectory()]
            left = [f for f in folders if (number, f.getName().removeprefix("bucket=")) in named]
            for gone in ([version.getPath()] if not left else [f for f in folders if f not in left]):
                delete_path(self.spark, gone.toString())

    def _drop_deltas(self, session_id: str, batch_id: int) -> None:
        """Remove the deltas up to a batch of a session."""
        for session in children(self.spark, self._part("deltas")):
            name = session.getPath().getName().removeprefix("session_id=")
            if name < session_id:
                delete_path(self.spark, session.getPath().toString())
            elif name == session_id:
                for batch in children(self.spark, session.getPath().toString()):
                    number = batch.getPath().getName().removeprefix("batch_id=")
                    if number.isdigit() and int(number) <= batch_id:
                        delete_path(self.spark, batch.getPath().toString())
