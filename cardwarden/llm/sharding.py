"""Consistent hashing with virtual nodes and bounded loads, in DataFrame operations.

Shards own arcs of a ring through their virtual nodes. A key belongs to the first virtual
node clockwise of its own position. Shards have a bounded load: in each round a shard takes,
in ring order, as many of the keys that stand before it as it has room for; the others go on
clockwise to the next virtual node of a shard with room.

Keys of an arc are consecutive in ring order, so the rounds need only the number of keys per
arc (one row per virtual node, whatever the table's size) and turn into ranges of ring
ranks. Rows get their rank from a range-partitioned numbering and join the ranges of their arc;
no shard or arc is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.llm.common import quoted
from cardwarden.plans.selection import sequence_numbers

VIRTUAL_NODES = 64
_BUCKET_BITS = 10


def ring_position(name: Column) -> Column:
    """A place on the ring of 2^60 positions: the leading digits of the name's digest."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes in ring order; a shard's nodes depend on it alone."""
    nodes = spark.range(shards * virtual_nodes).select(
        F.floor(F.col("id") / virtual_nodes).cast("int").alias("shard"),
        (F.col("id") % virtual_nodes).alias("node"))
    placed = nodes.select(ring_position(F.concat_ws(
        "/", F.lit("shard"), F.col("shard").cast("string"), F.col("node").cast("string"))).alias("p"), "shard")
    return [(r["p"], r["shard"]) for r in placed.orderBy("p", "shard").collect()]


def load_bounds(rows: int, shards: int, slack: float) -> list[int]:
    """How many keys each shard may hold: its even share, or that times one plus ``slack``."""
    share, rest = divmod(rows, shards)
    return [max(share + (s < rest), int(rows * (1 + slack) / shards)) for s in range(shards)]


def ranges(arcs: list[tuple[int, int, int]], owners: list[int], bounds: list[int]
           ) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first rank, end rank, shard, first slot)`` from ``(arc, first rank, keys)``.

    Arc i is owned by virtual node i; the arc after the last node belongs to node 0.
    """
    room, filled = list(bounds), [0] * len(bounds)
    waiting = sorted((start, start + n, arc, arc % len(owners)) for arc, start, n in arcs)
    out = []
    while waiting:
        onward = []
        for start, end, arc, node in waiting:
            shard = owners[node]
            n = min(end - start, room[shard])
            if n:
                out.append((arc, start, start + n, shard, filled[shard]))
                room[shard] -= n
                filled[shard] += n
            if start + n < end:
                onward.append((start + n, end, arc, node))
        waiting = []
        for start, end, arc, node in onward:
            while not room[owners[node]]:
                node = (node + 1) % len(owners)
            waiting.append((start, end, arc, node))
    return out


def _inline(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({names})")


def assign_shards(rows: DataFrame, name: Column, ties: list[str], shards: int = 8,
                  virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's gapless number in its shard.

    ``name`` is the key as text (null counts as empty); rows with equal names stand at one
    position and go in the order of ``ties``. With no slack shard sizes differ by at most
    one. An empty table gives no rows; input columns called shard or slot are replaced.
    """
    spark = rows.sparkSession
    nodes = ring(spark, shards, virtual_nodes)
    owners = [shard for _, shard in nodes]
    width = 60 - _BUCKET_BITS
    # the nodes that can follow a position, per leading bits: those inside and the first after
    by_bucket, at = [], 0
    for bucket in range(1 << _BUCKET_BITS):
        while at < len(nodes) and nodes[at][0] >> width < bucket:
            at += 1
        end = at
        while end < len(nodes) and nodes[end][0] >> width == bucket:
            end += 1
        by_bucket += [(bucket, nodes[i][0] if i < len(nodes) else 1 << 60, i) for i in range(at, end + 1)]
    lookup = _inline(spark, "__bucket, p, arc", by_bucket).groupBy("__bucket").agg(
        F.sort_array(F.collect_list(F.struct("p", "arc"))).alias("__next"))
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    placed = rows.select(*[quoted(c) for c in own]).withColumn(
        "__p", ring_position(F.coalesce(name, F.lit("")))).withColumn(
        "__bucket", F.shiftright("__p", width)).withColumn("__tie", F.monotonically_increasing_id())
    on_arc = placed.join(F.broadcast(lookup), "__bucket").withColumn(
        "__arc", F.element_at(F.filter("__next", lambda n: n["p"] >= F.col("__p")), 1)["arc"]
    ).select(*[quoted(c) for c in own], "__p", "__arc", "__tie")
    ranked = sequence_numbers(on_arc, ["__p", *ties, "__tie"])
    counted = ranked.groupBy("__arc").agg(F.min("sequence").alias("first"), F.count("*").alias("n"))
    arcs = [(r["__arc"], r["first"], r["n"]) for r in counted.collect()]
    total = sum(n for _, _, n in arcs)
    plan = ranges(arcs, owners, load_bounds(total, shards, slack)) or [(-1, 0, 0, 0, 0)]
    held = _inline(spark, "__arc, __from, __end, __shard, __slot", plan)
    inside = (F.col("sequence") >= F.col("__from")) & (F.col("sequence") < F.col("__end"))
    return ranked.join(F.broadcast(held), "__arc").filter(inside).select(
        *[quoted(c) for c in own], F.col("__shard").cast("int").alias("shard"),
        (F.col("__slot") + F.col("sequence") - F.col("__from")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text",
                    virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)``: all documents, shard sizes at most one row apart.

    Size is the text's UTF-8 bytes plus one; a null text has none.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(quoted(key).alias("__key"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    return assign_shards(rows, F.col("__key").cast("string"), ["__key", "text_crc32", "size"],
                         shards, virtual_nodes).withColumnRenamed("__key", key)
