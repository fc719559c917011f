"""Exact top-k inner products by norm buckets with pruning from local cosine thresholds.

Vectors are laid out by descending length and cut into buckets. A query carries a lower bound
of its k-th score; in a bucket this bound, over the lengths of query and longest vector, is a
local cosine threshold. Above one, the bucket cannot contribute. Where it is high, the
query's largest coordinates confine a vector's coordinates to a range and few vectors remain
(coordinate pruning); where it is low, only the lengths confine them (length pruning). What
remains is verified by exact integer products.

Queries are a stated set: they go out in blocks of bounded size, one pass over the buckets
each; a pass returns at most k rows per query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, quoted, written

BUCKET_ROWS = 2048
#: Bytes of query components in one broadcast block.
QUERY_BYTES = 16 << 20
#: The longest vectors, whose products give every query its first bound.
SEED_ROWS = 1024
#: From this local cosine threshold on coordinates prune better than lengths.
COORDINATE_FROM = 0.7
FOCUS = 3
_SLACK = 1e-9


def scaled(df: DataFrame, key: str, vector: str, factor: float = 1024.0) -> DataFrame:
    """``(id, comps, norm)``: components times ``factor`` rounded down.

    Null ids, null vectors and vectors holding null or non-finite components take no part. Rows
    that share an id all stay: as candidates each is a row of its own, as queries they share one list.
    """
    x = quoted(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(quoted(key).isNotNull() & x.isNotNull()).filter(finite).select(
        quoted(key).cast("bigint").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * factor)).alias("comps"))
    square = F.aggregate("comps", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm", F.sqrt(square))


def norm_buckets(vectors: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The vectors by descending length, packed: a row holds the ids and components of a bucket."""
    schema = T.StructType([T.StructField("longest", T.DoubleType()), T.StructField("width", T.IntegerType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("comps", T.BinaryType())])
    laid_out = vectors.select("id", "comps", "norm").repartitionByRange(F.desc("norm"), "id")

    def stage(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, bucket_rows):
                part = batch.slice(at, bucket_rows)
                ids, comps = packed(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch_column(part, "norm")[0].as_py()]),
                     pa.array([comps.shape[1]], pa.int32()),
                     pa.array([ids.tobytes()], pa.binary()), pa.array([comps.tobytes()], pa.binary())],
                    names=schema.names)

    return laid_out.sortWithinPartitions(F.desc("norm"), "id").mapInArrow(stage, schema)


def packed(rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix of components, short vectors filled up with zeros."""
    column = rows.column("comps") if isinstance(rows, pa.Table) else batch_column(rows, "comps")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    ids = rows.column("id") if isinstance(rows, pa.Table) else batch_column(rows, "id")
    return ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.to_numpy(), out


def _fit(matrix: np.ndarray, width: int) -> np.ndarray:
    if matrix.shape[1] >= width:
        return matrix
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


class QueryBlock:
    """Queries with their running k best and the bound that follows from them."""

    def __init__(self, ids: np.ndarray, comps: np.ndarray, k: int, exact: str, bound: np.ndarray | None = None):
        self.ids, self.comps, self.k, self.exact = ids, comps, k, exact
        self.norm = np.sqrt((comps.astype(np.float64) ** 2).sum(1))
        self.bound = np.full(len(ids), -np.inf) if bound is None else bound

    def products(self, chosen: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Exact integer products; ``exact`` names a float type only where every sum fits it."""
        width = max(self.comps.shape[1], matrix.shape[1])
        return _fit(self.comps[chosen], width).astype(self.exact) @ _fit(matrix, width).astype(self.exact).T

    def seed(self, ids: np.ndarray, comps: np.ndarray) -> None:
        """Bounds from the products with a few vectors."""
        for at in range(0, len(self.ids), 256):
            part = np.arange(at, min(at + 256, len(self.ids)))
            scores = np.where(ids[None, :] == self.ids[part, None], -np.inf, self.products(part, comps))
            if scores.shape[1] >= self.k:
                self.bound[part] = np.partition(scores, -self.k, 1)[:, -self.k]

    def scan(self, buckets) -> dict[int, list[tuple[int, int]]]:
        """The k best ``(score, id)`` of the buckets per query number, none below its bound."""
        bound = self.bound.copy()
        best: dict[int, list[tuple[int, int]]] = {}
        direction = self.comps / np.where(self.norm > 0, self.norm, 1.0)[:, None]
        focus = np.argsort(-np.abs(direction), axis=1)[:, :FOCUS]

        def take(q: int, scores: np.ndarray, ids: np.ndarray) -> None:
            good = np.flatnonzero((scores >= bound[q]) & (ids != self.ids[q]))
            if not len(good):
                return
            if len(good) > self.k:
                good = good[np.lexsort((ids[good], -scores[good]))[:self.k]]
            held = sorted([*best.get(q, []), *zip((-scores[good]).tolist(), ids[good].tolist())])[:self.k]
            best[q] = held
            if len(held) == self.k:
                bound[q] = max(bound[q], -held[-1][0])

        for longest, ids, comps in buckets:
            norms = np.sqrt((comps.astype(np.float64) ** 2).sum(1))
            reach = self.norm * longest
            local = np.where(reach > 0, bound / np.where(reach > 0, reach, 1.0),
                             np.where(bound > 0, np.inf, -np.inf))
            alive = np.flatnonzero(local <= 1.0 + _SLACK)
            by_coordinate = alive[local[alive] >= COORDINATE_FROM]
            by_length = alive[local[alive] < COORDINATE_FROM]
            if len(by_coordinate):
                unit = comps / np.where(norms > 0, norms, 1.0)[:, None]
            for q in by_coordinate.tolist():
                t = min(1.0, local[q])
                keep = norms * self.norm[q] >= bound[q] * (1 - _SLACK)
                for f in focus[q].tolist():
                    c = direction[q, f]
                    spread = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-7
                    value = unit[:, f] if f < unit.shape[1] else np.zeros(len(ids))
                    # beyond the cosine of q's own angle the range has no end on that side
                    low = c * t - spread if c > -t else -np.inf
                    high = c * t + spread if c < t else np.inf
                    keep &= (value >= low) & (value <= high)
                some = np.flatnonzero(keep)
                if len(some):
                    take(q, self.products(np.array([q]), comps[some])[0], ids[some])
            # vectors come by descending length: those too short for a query are a tail
            for at in range(0, len(by_length), 256):
                part = by_length[at:at + 256]
                shortest = (np.maximum(bound[part], 0) / np.maximum(self.norm[part], 1e-300)).min()
                n = len(norms) if not np.isfinite(shortest) else int(
                    np.searchsorted(-norms, -shortest * (1 - _SLACK), side="right"))
                if not n:
                    continue
                scores = self.products(part, comps[:n])
                for row in np.flatnonzero((scores >= bound[part, None]).any(1)).tolist():
                    take(int(part[row]), scores[row], ids[:n])
        return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, query_bytes: int = QUERY_BYTES,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``scaled`` vectors: each query's k highest products.

    Candidates are all rows of other ids; ties go to the smaller id; a query with fewer
    candidates returns them all. Empty vectors score zero, short ones count as filled up with
    zeros. Raises ``OverflowError`` where products could exceed 64 bits.
    """
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    buckets = written(norm_buckets(vectors, bucket_rows), "buckets")
    queries = vectors.filter(is_query)
    size = vectors.agg(F.max("norm").alias("norm"), F.max(F.size("comps")).alias("width")).first()
    longest, width = size["norm"] or 0.0, max(1, size["width"] or 1)
    if longest ** 2 >= 2.0 ** 62:
        raise OverflowError("inner products could exceed 64 bits")
    exact = "float64" if longest ** 2 < 2.0 ** 52 else "int64"
    blocks = max(1, -(-queries.count() * width * 8 // query_bytes))
    seeds = packed(vectors.orderBy(F.desc("norm"), "id").limit(SEED_ROWS).toArrow())
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.LongType())])
    found = None
    for b in range(blocks):
        block = QueryBlock(*packed(queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()),
                           k, exact)
        block.seed(*seeds)
        shared = spark.sparkContext.broadcast((block.ids, block.comps, k, exact, block.bound))

        def stage(batches, shared=shared):
            def unpacked():
                for batch in batches:
                    for row in batch.to_pylist():
                        ids = np.frombuffer(row["ids"], np.int64)
                        yield row["longest"], ids, np.frombuffer(row["comps"], np.int64).reshape(
                            len(ids), row["width"])

            block = QueryBlock(*shared.value)
            best = block.scan(unpacked())
            rows = [(int(block.ids[q]), i, -int(s)) for q, held in best.items() for s, i in held]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows[at:at + 10_000])], names=schema.names)

        part = buckets.mapInArrow(stage, schema)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
