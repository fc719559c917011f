"""Written intermediate tables, pass-through Arrow stages and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.session import scratch_path

#: Rows taken out of an Arrow batch at a time, so that only a slice exists twice.
SLICE = 256
#: Rows of a batch whose new columns exist at a time.
ROWS = 1024


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame after one trip through Parquet in the shared folder.

    Cuts the lineage, survives lost executors, and gives later joins a measured size
    and an exchange of their own, which adaptive execution can split when a key is hot.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame less the columns whose names are about to be added."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one slice at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    for at in range(0, len(raw), SLICE):
        yield from raw.slice(at, SLICE).to_pylist()


def with_columns(df: DataFrame, source: str, fields: list[T.StructField],
                 compute: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Adds columns that ``compute`` derives from each Arrow batch; all other columns pass through.

    Columns of the input that bear the new names (in any case) are replaced, unless one of
    them is ``source`` itself.
    """
    names = [f.name for f in fields]
    if source.lower() in {n.lower() for n in names}:
        raise ValueError(f"a new column may not replace its source {source}")
    base = without(df, *names)
    schema = T.StructType([*base.schema.fields, *fields])
    arrow_names = schema.names

    def stage(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=arrow_names)

    return base.mapInArrow(stage, schema)


def batch_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _word_bytes() -> bytes:
    keep = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        keep[b] = b
    for b in range(0x41, 0x5B):
        keep[b] = b + 32
    return bytes(keep)


WORD_BYTES = _word_bytes()


def words(text: bytes | None) -> list[bytes]:
    """Words of digits, ASCII letters (lower-cased) and all characters beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


def chunks(texts: Iterator[bytes | None], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Consecutive texts (null as empty) in lists of about ``limit`` bytes."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a line feed after each, and where each text begins."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), starts
