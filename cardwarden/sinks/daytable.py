"""Day tables of micro-batches: a manifest of live files per day, key filters, compaction.

A table has a folder per event day (rows without a day share one). Beside the Parquet files a day holds
numbered manifests; the newest complete one says which files are live and which batch each writer has
stored last. Manifests are created, never changed, so a reader that has planned with one keeps its version,
a batch is either in a day or not, and a repeated batch finds itself there. Each file may have a key filter
(Bloom bits over hashes of its keys), so that a lookup opens only files that can hold a key. Small files of
a day are merged once there are ``max_files`` of them; replaced files are deleted after a time of grace.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.operators.joins import not_yet_stored
from cardwarden.session import delete_path, path_exists

UNDATED = "__HIVE_DEFAULT_PARTITION__"
#: Keys of a batch that are held against key filters; a larger batch opens all files of its days.
KEYS_AT_ONCE = 1_000_000
#: Bits of a filter per key, and bits set for each: about one in a hundred absent keys seems present.
KEY_BITS, PROBES = 10, 7


def children(spark: SparkSession, path: str) -> list:
    """File system entries right below a path."""
    if not path_exists(spark, path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root))


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; ``False`` if another writer was first."""
    system, target = _file_system(spark, path)
    try:
        out = system.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str:
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    system, path = _file_system(spark, source)
    destination = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(destination.getParent())
    if not system.rename(path, destination):
        raise OSError(f"cannot move {source} to {target}")


@dataclass(frozen=True)
class Manifest:
    """What a day holds: live files with size and time of commit, their filters, the last batch per writer."""

    version: int = 0
    files: dict[str, tuple[int, float]] = field(default_factory=dict)
    filters: tuple[str, ...] = ()
    written: dict[str, int] = field(default_factory=dict)
    #: files replaced by others and when
    retired: dict[str, float] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"files": self.files, "filters": self.filters, "written": self.written, "retired": self.retired})

    @classmethod
    def of(cls, version: int, text: str) -> Manifest:
        held = json.loads(text)
        return cls(version, {n: tuple(v) for n, v in held["files"].items()}, tuple(held["filters"]),
                   held["written"], held["retired"])

    def has(self, writer: str, batch_id: int) -> bool:
        return self.written.get(writer, -1) >= batch_id


FILTERS = T.StructType([T.StructField("day", T.DateType()), T.StructField("file", T.StringType()),
                        T.StructField("bits", T.BinaryType())])


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def filter_bits(hashes: np.ndarray) -> bytes:
    """A Bloom filter over 64-bit key hashes."""
    bits = np.zeros(8 * -(-max(1, len(hashes)) * KEY_BITS // 8), bool)
    bits[_probes(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter cannot rule out."""
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_probes(hashes, len(held))].all(axis=1)


def key_filters(rows: DataFrame, key: str) -> DataFrame:
    """``FILTERS`` of stored rows with ``day`` and ``file``: one per file and Arrow batch, nothing is shuffled."""

    def stage(batches):
        for batch in batches:
            days, names = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            hashes = batch.column(2).to_numpy()
            found = [(days[int(np.argmax(names == n))].as_py(), n, filter_bits(hashes[names == n])) for n in sorted(set(names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.date32(), pa.string(), pa.binary()))], names=FILTERS.names)

    return rows.select("day", "file", F.xxhash64(key).alias("h")).mapInArrow(stage, FILTERS)


def _at_once(work: Callable[[str], object], days: list[str]) -> list:
    """Work on the small files of several days, a few days at a time."""
    if len(days) < 2:
        return [work(d) for d in days]
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(work, days))


def day_text(day) -> str:
    """A day as its folder names it."""
    return UNDATED if day is None else str(day)


class DayTable:
    """One table of micro-batches. With ``key`` its files get key filters."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, max_files: int = 32,
                 file_bytes: int = 128 << 20, grace_seconds: float = 600, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.key = spark, path, key
        self.max_files, self.file_bytes, self.grace_seconds, self.clock = max_files, file_bytes, grace_seconds, clock

    # --- manifests --------------------------------------------------------------------

    def _folder(self, day: str) -> str:
        return os.path.join(self.path, f"day={day}")

    def days(self) -> list[str]:
        """The days that have a folder, as text."""
        names = [s.getPath().getName() for s in children(self.spark, self.path)]
        return sorted(n[4:] for n in names if n.startswith("day="))

    def manifest(self, day: str) -> Manifest:
        """The newest complete manifest of a day; one whose writer died half-way does not count."""
        numbers = sorted((int(n[10:]) for s in children(self.spark, self._folder(day))
                          if (n := s.getPath().getName()).startswith("_manifest-")), reverse=True)
        newest = numbers[0] if numbers else 0
        for number in numbers:
            try:
                found = Manifest.of(number, read_file(self.spark, self._manifest_path(day, number)))
            except (ValueError, KeyError):
                continue
            return replace(found, version=newest)  # the next one is numbered after the broken one
        return Manifest(newest)

    def manifests(self, days: Iterable[str]) -> dict[str, Manifest]:
        """The manifests of several days."""
        named = list(days)
        return dict(zip(named, _at_once(self.manifest, named)))

    def _manifest_path(self, day: str, version: int) -> str:
        return os.path.join(self._folder(day), f"_manifest-{version:012d}")

    def _commit(self, day: str, change: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        """Apply a change to the newest manifest; another writer's commit in between is seen first."""
        while True:
            new = change(self.manifest(day))
            if new is None:
                return None
            if create_file(self.spark, self._manifest_path(day, new.version + 1), new.text()):
                old = self._manifest_path(day, new.version - 1)
                if new.version > 1:
                    delete_path(self.spark, old)
                return replace(new, version=new.version + 1)

    # --- writing ----------------------------------------------------------------------

    def _stage(self, rows: DataFrame) -> str:
        """Rows (and their key filters) in a hidden folder, by day."""
        staged = os.path.join(self.path, "_staging", uuid.uuid4().hex)
        rows.write.partitionBy("day").parquet(os.path.join(staged, "rows"))
        if self.key is not None:
            schema = T.StructType([rows.schema[self.key], T.StructField("day", T.DateType())])
            stored = self.spark.read.schema(schema).parquet(os.path.join(staged, "rows"))
            key_filters(stored.select("day", F.col("_metadata.file_name").alias("file"), self.key), self.key).write.partitionBy(
                "day").parquet(os.path.join(staged, "keys"))
        return staged

    def _adopt(self, staged: str, day: str) -> tuple[dict[str, tuple[int, float]], tuple[str, ...]]:
        """Move a staged day's files to their place; nobody reads them before a manifest names them."""
        now, files, filters = self.clock(), {}, []
        for part, target in (("rows", self._folder(day)), ("keys", os.path.join(self._folder(day), "_keys"))):
            for status in children(self.spark, os.path.join(staged, part, f"day={day}")):
                name = status.getPath().getName()
                if name.startswith(("_", ".")):
                    continue
                move(self.spark, status.getPath().toString(), os.path.join(target, name))
                if part == "rows":
                    files[name] = (int(status.getLen()), now)
                else:
                    filters.append(name)
        return files, tuple(filters)

    def append(self, rows: DataFrame, writer: str, batch_id: int) -> list[str]:
        """Store a batch's rows (with ``day``) on each day that does not have the batch yet; the days changed."""
        marked = rows.withColumns({"written_by": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint")})
        staged = self._stage(marked.hint("rebalance", "day"))
        try:
            names = [s.getPath().getName() for s in children(self.spark, os.path.join(staged, "rows"))]
            days = [n[4:] for n in names if n.startswith("day=")]
            added = dict(zip(days, _at_once(lambda day: self._add(staged, day, writer, batch_id), days)))
        finally:
            delete_path(self.spark, staged)
        for day, manifest in added.items():
            if manifest is not None and (manifest.retired or len(manifest.files) > self.max_files):
                self.compact(day)
        return [day for day, manifest in added.items() if manifest is not None]

    def _add(self, staged: str, day: str, writer: str, batch_id: int) -> Manifest | None:
        """Take a staged day over, unless the day has the batch already."""
        files, filters = self._adopt(staged, day)

        def add(m: Manifest) -> Manifest | None:
            if m.has(writer, batch_id):
                return None
            return replace(m, files=m.files | files, filters=m.filters + filters, written=m.written | {writer: batch_id})

        new = self._commit(day, add)
        if new is None:
            for name in (*files, *(f"_keys/{f}" for f in filters)):
                delete_path(self.spark, os.path.join(self._folder(day), name))
        return new

    # --- reading ----------------------------------------------------------------------

    def live_files(self, days: Iterable[str] | None = None) -> list[str]:
        """Full paths of the live files of some days (all by default)."""
        held = self.manifests(self.days() if days is None else days)
        return [os.path.join(self._folder(d), n) for d, m in held.items() for n in m.files]

    def read(self, days: Iterable | None = None, files: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame | None:
        """One version of the table, or of some days or files; ``None`` where there are no rows."""
        if files is None:
            files = self.live_files(None if days is None else [day_text(d) for d in days])
        if not files:
            return None
        reader = self.spark.read.option("basePath", self.path)
        if schema is not None:
            return reader.schema(schema).parquet(*files)
        return reader.parquet(*files).withColumn("day", F.col("day").cast("date"))

    def files_that_may_hold(self, keys: DataFrame, days: Iterable) -> list[str]:
        """Live files of the days that can hold one of the keys (a frame with the key column)."""
        folders = self.manifests(map(day_text, days))
        live = {f"{d}/{n}": os.path.join(self._folder(d), n) for d, m in folders.items() for n in m.files}
        filters = [os.path.join(self._folder(d), "_keys", n) for d, m in folders.items() for n in m.filters]
        if not live or self.key is None or not filters:
            return list(live.values())
        hashed = keys.select(F.xxhash64(self.key).alias("h")).distinct().limit(KEYS_AT_ONCE + 1).toArrow().column("h").to_numpy()
        if len(hashed) > KEYS_AT_ONCE:
            return list(live.values())

        def stage(batches):
            for batch in batches:
                held = [bool(may_hold(b.as_py(), hashed).any()) for b in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_())], names=["file", "held"])

        # a file has the same name on all days of its batch
        place = F.concat(F.regexp_extract("_metadata.file_path", "/day=([^/]+)/", 1), F.lit("/"), F.col("file")).alias("file")
        found = self.spark.read.schema("file string, bits binary").parquet(*filters).select(place, "bits").mapInArrow(
            stage, "file string, held boolean").groupBy("file").agg(F.max("held").alias("held")).collect()
        ruled_out = {r["file"] for r in found if not r["held"]}
        return sorted(path for name, path in live.items() if name not in ruled_out)

    def not_stored(self, rows: DataFrame, writer: str, batch_id: int, days: Iterable, condition: Column | None = None) -> DataFrame:
        """The rows whose key no other batch has stored on the days."""
        field = rows.schema[self.key]
        schema = T.StructType([field, T.StructField("written_by", T.StringType()),
                               T.StructField("batch_id", T.LongType()), T.StructField("day", T.DateType())])
        stored = self.read(files=self.files_that_may_hold(rows, days), schema=schema)
        if stored is None:
            return rows
        if condition is not None:
            stored = stored.filter(condition)
        others = stored.filter((F.col("written_by") != writer) | (F.col("batch_id") != batch_id)).select(self.key)
        return not_yet_stored(rows, others, self.key, None)

    # --- upkeep -----------------------------------------------------------------------

    def compact(self, day: str) -> Manifest | None:
        """Merge the small files of a day when it has more than ``max_files``; ``None`` when it has not.

        The old manifest names the old files until the new one is there; they are deleted after ``grace_seconds``.
        """
        before = self.manifest(day)
        small = {n: v for n, v in before.files.items() if v[0] < self.file_bytes}
        if len(before.files) <= self.max_files or len(small) < 2:
            return self._sweep(day)
        merged = self.read(files=[os.path.join(self._folder(day), n) for n in small])
        size = sum(v[0] for v in small.values())
        staged = self._stage(merged.repartition(1 + size // self.file_bytes))
        try:
            if before.filters and len(small) < len(before.files):
                old = self.spark.read.schema("file string, bits binary").parquet(
                    *[os.path.join(self._folder(day), "_keys", n) for n in before.filters])
                stay = old.filter(F.col("file").isin([n for n in before.files if n not in small]))
                stay.coalesce(1).write.mode("append").parquet(os.path.join(staged, "keys", f"day={day}"))
            files, filters = self._adopt(staged, day)
        finally:
            delete_path(self.spark, staged)
        newest = max(v[1] for v in small.values())
        files = {n: (v[0], newest) for n, v in files.items()}

        def swap(m: Manifest) -> Manifest | None:
            if not small.keys() <= m.files.keys():
                return None  # another compaction was first
            now = self.clock()
            return replace(m, files={n: v for n, v in m.files.items() if n not in small} | files,
                           filters=tuple(f for f in m.filters if f not in before.filters) + filters,
                           retired=m.retired | {n: now for n in (*small, *(f"_keys/{f}" for f in before.filters))})

        if self._commit(day, swap) is None:
            for name in files:
                delete_path(self.spark, os.path.join(self._folder(day), name))
            return None
        return self._sweep(day)

    def _sweep(self, day: str) -> Manifest | None:
        """Delete replaced files whose time of grace is over."""
        now = self.clock()
        due = {n for n, since in self.manifest(day).retired.items() if now - since >= self.grace_seconds}
        if not due:
            return None
        for name in due:
            delete_path(self.spark, os.path.join(self._folder(day), name))
        return self._commit(day, lambda m: replace(m, retired={n: t for n, t in m.retired.items() if n not in due}))

    def expire(self, day: str, before: float) -> int:
        """Let go of files committed before a time: for the rows without a day. How many went."""
        gone = {n for n, (_, at) in self.manifest(day).files.items() if at < before}
        if not gone:
            return 0

        def without(m: Manifest) -> Manifest:
            left = {n: v for n, v in m.files.items() if n not in gone}
            return replace(m, files=left, filters=m.filters if left else ())

        left = self._commit(day, without)
        for name in (*gone, *([] if left.files else ["_keys"])):
            delete_path(self.spark, os.path.join(self._folder(day), name))
        return len(gone)
