"""Exact rank-based selection without sorting a large group in one task.

A sort key that spreads evenly (a hash) is cut into buckets. Counting rows per
bucket is a pre-aggregated shuffle; the running totals say which bucket holds
the wanted rank; only the rows of that bucket are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden.session import shared_folder, written

BUCKET_BITS = 16


def hex_bucket(hex_key: Column, bits: int = BUCKET_BITS) -> Column:
    """Leading bits of a hex digest; keeps the order of the digest."""
    digits = bits // 4
    return F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("int")


def long_bucket(hash_key: Column, bits: int = BUCKET_BITS) -> Column:
    """Leading bits of a signed 64-bit hash; keeps the signed order."""
    return F.shiftright(hash_key, 64 - bits).cast("int")


def cut_keys(df: DataFrame, groups: list[str], key: str, bucket: Column,
             quota: DataFrame) -> DataFrame:
    """Per group, the key whose rank equals the group's quota: ``(groups..., cut_key)``.

    ``quota`` holds one row per group with a ``take`` column. Rows whose key is at
    or below the cut are exactly the ``take`` lowest, given unique keys.
    """
    keyed = df.select(*groups, key, bucket.alias("bucket"))
    running = Window.partitionBy(*groups).orderBy("bucket")
    counts = (
        keyed.groupBy(*groups, "bucket").agg(F.count("*").alias("rows"))
        .withColumn("upto", F.sum("rows").over(running))
    )
    # one row per group, written: the join with all rows then knows its size
    edges = written(
        counts.join(quota, groups)
        .filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("rows") < F.col("take")))
        .select(*groups, "bucket", (F.col("take") - F.col("upto") + F.col("rows")).alias("need")),
        "edges")
    in_edge = keyed.join(edges, [*groups, "bucket"])
    ranked = in_edge.withColumn(
        "rank_in_edge", F.row_number().over(Window.partitionBy(*groups).orderBy(key)))
    return written(ranked.filter(F.col("rank_in_edge") == F.col("need")).select(
        *groups, F.col(key).alias("cut_key")), "cuts")


def last_rows(df: DataFrame, order: list[str], n: int, coarse: Column) -> DataFrame:
    """The last ``n`` rows by ``order``.

    ``coarse`` is a monotone coarsening of the first order column (an hour, a day,
    a batch number). Its counts find where the last ``n`` rows begin, so the final
    top-n sees only the tail of the table instead of every partition's candidates.
    """
    marked = df.withColumn("__coarse", coarse)
    counts = marked.groupBy("__coarse").agg(F.count("*").alias("rows"))
    from_end = Window.orderBy(F.desc("__coarse"))
    start = (
        counts.withColumn("after", F.sum("rows").over(from_end) - F.col("rows"))
        .filter(F.col("after") < n).agg(F.min("__coarse"))
    )
    tail = marked.filter(F.col("__coarse") >= start.scalar()).drop("__coarse")
    return tail.orderBy(*[F.desc(c) for c in order]).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int, coarse: Column) -> DataFrame:
    """The first ``n`` rows by ``order``; see ``last_rows``."""
    marked = df.withColumn("__coarse", coarse)
    counts = marked.groupBy("__coarse").agg(F.count("*").alias("rows"))
    from_start = Window.orderBy("__coarse")
    end = (
        counts.withColumn("before", F.sum("rows").over(from_start) - F.col("rows"))
        .filter(F.col("before") < n).agg(F.max("__coarse"))
    )
    head = marked.filter(F.col("__coarse") <= end.scalar()).drop("__coarse")
    return head.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``. The rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[c.asc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def recent_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The last ``k`` rows per key with their rank; ``k`` rows per key and task cross the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= k)


def sequence_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive numbers from 0 by a total order, without one task sorting all rows.

    Range-partition and sort, note each row's partition and place, write that down
    through a reliable checkpoint so both uses see the same layout, then add up the
    partition sizes (one row per partition).
    """
    shared_folder(df.sparkSession)
    laid_out = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    )
    placed = laid_out.select(
        *df.columns,
        F.shiftright("__place", 33).alias("__part"),
        F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)).alias("__in_part"),
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part").agg(F.count("*").alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    )
    return placed.join(starts, "__part").select(
        *df.columns, (F.col("__start") + F.col("__in_part")).alias("sequence"))
