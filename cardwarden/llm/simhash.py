"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two fingerprints that differ in at most d bits differ in at most d of their eight bytes, so
they share at least T = 8 - d bytes at the same positions. Posting lists of single positional
bytes hold 1/256 of all fingerprints each, and a tally over them grows with the square of the
table. The index therefore keys its lists by the tally itself: every choice of T positions
with their bytes is a posting, and two fingerprints meet in one exactly when T positional bytes
are shared. A posting leaves only d bytes free, so it holds at most 256^d distinct
fingerprints (65,536 for d = 2) however many documents there are. Within a posting, pairs are
verified by their differing bits; a spanning set of links is emitted instead of all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, quoted, utf8, with_columns, written
from cardwarden.llm.components import connected_components

SEED = 42
_ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; a text of fewer words is one shingle, none has none."""
    w = text.translate(_ASCII_LOWER).split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    digest = xxhash.xxh64_intdigest
    if len(w) <= n:
        return np.array([digest(line, SEED)], np.uint64)
    starts = [0, *(ends[:-n] + 1).tolist()]
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[n - 1:].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The signed 64 bits that are set in more than half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero when there are no words."""
    return simhash(shingle_hashes(text, n))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint_bits",
                     n: int = 3) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer; null and wordless texts have zero."""

    def compute(batch):
        values = [fingerprint(body, n) for body in utf8(batch_column(batch, text))]
        return [pa.array(values, pa.int64())]

    return with_columns(docs, text, [T.StructField(out, T.LongType())], compute)


def _links_within(values: np.ndarray, free: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links among fingerprints of one posting, which differ only in the ``free`` bits.

    Few members are tallied and verified pair by pair; in a long posting each member looks up
    the fingerprints within its distance, so the work stays in proportion to the members.
    """
    m = len(values)
    unsigned = values.view(np.uint64)
    if m <= 64:
        differ = unsigned[:, None] ^ unsigned[None, :]
        tally = 8 - np.count_nonzero(differ[..., None].view(np.uint8), axis=-1)
        near = (tally >= 8 - distance) & (np.bitwise_count(differ) <= distance)
        i, j = np.nonzero(np.triu(near, 1))
    else:
        order = np.argsort(unsigned)
        ranked = unsigned[order]
        bits = [np.uint64(1) << np.uint64(b) for b in range(64) if free >> b & 1]
        found = []
        for k in range(1, distance + 1):
            for chosen in combinations(bits, k):
                other = unsigned ^ np.bitwise_or.reduce(np.array(chosen, np.uint64))
                at = np.minimum(np.searchsorted(ranked, other), m - 1)
                hit = np.flatnonzero(ranked[at] == other)
                found.append((hit, order[at[hit]]))
        i, j = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return values[:0], values[:0]
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(m))
    return values[member], values[label[member]]


def fingerprint_links(fingerprints: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints that connect all pairs within ``distance`` bits.

    One row per choice of positions and fingerprint crosses the shuffle; rows of a posting
    come sorted, so a task holds one posting at a time.
    """
    if not 0 < distance <= 2:
        raise ValueError("a posting is bounded for distances 1 and 2")
    masks = []
    for free in combinations(range(8), distance):
        masks.append(sum(0xFF << (8 * p) for p in free))
    signed = [(~m & (1 << 64) - 1) - (1 << 64) * (not m >> 63 & 1) for m in masks]
    keys = F.explode(F.array(*[
        F.struct(F.lit(c).cast("tinyint").alias("choice"),
                 F.col(column).bitwiseAND(F.lit(keep)).alias("shared"))
        for c, keep in enumerate(signed)]))
    postings = fingerprints.select(F.col(column).alias("fp"), keys.alias("key")).select(
        "key.choice", "key.shared", "fp")
    dealt = postings.repartition("choice", "shared").sortWithinPartitions("choice", "shared")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def stage(batches):
        empty = np.empty(0, np.int64)
        held = (np.empty(0, np.int8), empty, empty)

        def links(choice, shared, fp, complete):
            """Links of all postings but the last, unless complete; the rest is handed back."""
            edge = np.flatnonzero((np.diff(choice) != 0) | (np.diff(shared) != 0)) + 1
            bounds = np.concatenate([[0], edge, [len(fp)]])
            last = len(bounds) - 1 if complete else len(bounds) - 2
            sizes = np.diff(bounds[:last + 1])
            a, b = [empty], [empty]
            for k in np.flatnonzero(sizes > 1).tolist():
                lo, hi = bounds[k], bounds[k + 1]
                x, y = _links_within(fp[lo:hi], masks[choice[lo]], distance)
                a.append(x)
                b.append(y)
            cut = bounds[last]
            return np.concatenate(a), np.concatenate(b), (choice[cut:], shared[cut:], fp[cut:])

        for batch in batches:
            now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)])
                   for h, c in zip(held, batch.columns)]
            if not len(now[0]):
                continue
            a, b, held = links(*now, False)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if len(held[0]):
            a, b, _ = links(*held, True)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(stage, schema)


def fingerprint_components(rows: DataFrame, key: str, column: str, distance: int = 2) -> DataFrame:
    """``(column, first_key, keeper)`` for each distinct fingerprint: the smallest key reachable
    over links, and the fingerprint of its component that holds this key.

    Keys sort with nulls last; a component of null keys only has a null first key.
    """
    distinct = written(rows.groupBy(column).agg(F.min(key).alias("own")), "fingerprints")
    return reached_keys(distinct, fingerprint_links(distinct.select(column), column, distance), column)


def reached_keys(distinct: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """``(column, first_key, keeper)`` of ``distinct(column, own)`` nodes over ``links(a, b)``."""
    links = written(links, "near")
    roots = written(connected_components(links), "components")
    linked = written(distinct.join(roots.withColumnRenamed("node", column), column), "linked")
    rank = F.struct(F.col("own").isNull().alias("missing"), F.col("own").alias("own"),
                    F.col(column).alias("fp"))
    first = written(linked.groupBy("root").agg(F.min(rank).alias("f")).select(
        "root", F.col("f.own").alias("first_key"), F.col("f.fp").alias("keeper")), "first")
    reached = written(linked.join(first, "root").select(
        F.col(column).alias("__linked"), "first_key", "keeper"), "reached")
    alone = F.col("__linked").isNull()
    return written(distinct.join(reached, F.col(column) == F.col("__linked"), "left").select(
        column, F.when(alone, F.col("own")).otherwise(F.col("first_key")).alias("first_key"),
        F.coalesce("keeper", column).alias("keeper")), "reach")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3,
                    distance: int = 2) -> DataFrame:
    """``(key, fingerprint, component_id)`` per row of ``docs``.

    Rows with equal fingerprints are one node, so copies cost one row each. Null, empty and
    wordless texts have fingerprint zero and link like any other; repeated rows give repeated
    rows; further columns are ignored; an empty table gives no rows.
    """
    source = docs.select(quoted(key).alias("__key"), quoted(text).cast("string").alias("__text"))
    rows = written(with_fingerprint(source, "__text", "__fp", n).select("__key", "__fp"), "rows")
    reach = fingerprint_components(rows, "__key", "__fp", distance)
    return rows.join(reach, "__fp").select(
        F.col("__key").alias(key),
        F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"),
        F.col("first_key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3,
             distance: int = 2) -> DataFrame:
    """One document of each component, the one with the smallest key, in its own columns.

    A component without any key keeps one of its rows; of repeated rows with the kept key and
    fingerprint one stays. The texts are shuffled by key and fingerprint, not by fingerprint
    alone, so a group of copies is spread.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key_name, text_name = f"c{columns.index(key)}", f"c{columns.index(text)}"
    rows = written(with_fingerprint(renamed, text_name, "__fp", n), "documents")
    reach = fingerprint_components(rows.select(key_name, "__fp"), key_name, "__fp", distance)
    keepers = written(reach.filter("keeper = __fp").select(_id("first_key"), "__fp"), "keepers")
    kept = rows.withColumn("__id", _id(key_name)).join(keepers, ["__id", "__fp"], "left_semi")
    return kept.dropDuplicates(["__id", "__fp"]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def _id(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("__id")
