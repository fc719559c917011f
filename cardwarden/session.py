"""Session construction, the shared scratch folder and path checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cardwarden", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone pinned to UTC."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # keyed stream state on disk, not on the heap
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # call-site capture costs more than planning on frames of many columns
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches; a local one only where the session names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="cardwarden-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return os.path.join(shared_folder(spark), f"scratch-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A fresh path for an intermediate table."""
    return os.path.join(folder or scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder for intermediate tables that is deleted at the end, also after an error."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        delete_path(spark, path)


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder (or in ``folder``), for plans read several times.

    Cuts the lineage, survives lost executors and gives later joins a measured size.
    """
    path = scratch_path(df.sparkSession, label, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application has written below the shared folder.

    Frames that read such tables cannot be computed any more.
    """
    delete_path(spark, scratch_root(spark))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system its scheme names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
