"""Cost-balanced packing of token streams into fixed-length sequences.

Documents are tokenised, closed with an end id and cut into pieces of at most the sequence
length. Pieces are packed in blocks of bounded token count inside the task that tokenised
them, so nothing is shuffled and memory does not depend on the table. In a block there are
exactly as many sequences as its tokens need; pieces go, in descending order of length, to
the sequence of lowest estimated cost (linear in tokens plus quadratic in each piece) that
has room, and are cut only when no sequence has room for the whole piece. Padding is thus less
than one sequence per block.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, quoted, utf8

#: Tokens packed together; 4 bytes each are held.
BLOCK_TOKENS = 4 << 20
END_ID = 0

#: Characters beyond those whose classes (letter, digit, space) are the same in every Unicode version.
_UNSETTLED = re.compile("[^\x00-ɏ]")


@dataclass(frozen=True)
class Encoder:
    """A vocabulary as a ``tokenizers`` file, and optionally the same one as ranks.

    The ranks encode about four times as fast and give the same ids; texts with characters
    whose Unicode class may differ between libraries always go to ``tokenizers``. With
    ``added_tokens`` their strings in a text become their ids, as ``tokenizers`` has it by
    default; without it they are ordinary text.
    """

    vocabulary: str
    ranks: str | None = None
    pattern: str | None = None
    added_tokens: bool = False

    def loaded(self) -> Callable[[str], np.ndarray]:
        """The files read, as a function from text to ids."""
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(self.vocabulary)
        exact.encode_special_tokens = not self.added_tokens
        added = [t.content for t in exact.get_added_tokens_decoder().values()] if self.added_tokens else []
        slow = re.compile("|".join([_UNSETTLED.pattern, *map(re.escape, added)]))
        fast = None
        if self.ranks is not None:
            import tiktoken

            with open(self.ranks, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if fast is not None and not slow.search(text):
                return np.array(fast.encode_ordinary(text), np.uint32)
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

        return encode


def pack_block(lengths: np.ndarray, capacity: int, linear: float = 1.0,
               quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """``(piece, from, length, sequence, offset)`` of all pieces of one block.

    Ties of cost go to the sequence of lower number, ties of length to the earlier piece.
    """
    n = -(-int(lengths.sum()) // capacity)
    cost = np.zeros(n)
    room = np.full(n, capacity, np.int64)
    placed = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        done, left = 0, int(lengths[piece])
        while left:
            open_ = np.flatnonzero(room >= left)
            if not len(open_):
                open_ = np.flatnonzero(room)
            s = int(open_[cost[open_].argmin()])
            take = min(left, int(room[s]))
            placed.append((piece, done, take, s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            done, left = done + take, left - take
    return placed


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def pack(docs: DataFrame, encoder: Encoder, capacity: int = 1024, key: str = "doc_id",
         text: str = "text", with_ids: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents with their sequences: ``PIECES`` (``ids`` only if wanted).

    ``start`` counts ids of the document before the piece, ``offset`` ids of the sequence
    before it. Sequence ids are unique and grow within a task. Null and empty texts are the end
    id alone; repeated rows are packed as documents of their own; an empty table gives no rows.
    """
    source = docs.select(quoted(key).cast("bigint").alias("key"),
                         quoted(text).cast("string").alias("text"),
                         F.spark_partition_id().alias("part"))
    schema = PIECES if with_ids else T.StructType(PIECES.fields[:-1])

    def stage(batches):
        base, encode = None, encoder.loaded()
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal base, tokens
            pieces = [(d, at, min(capacity, len(held[d][1]) - at))
                      for d in range(len(held)) for at in range(0, len(held[d][1]), capacity)]
            rows = []
            for p, done, take, s, offset in pack_block(
                    np.array([x[2] for x in pieces], np.int64), capacity):
                d, at, _ = pieces[p]
                name, ids = held[d]
                rows.append((name, at + done, take, ids[at + done:at + done + take],
                             len(ids), base + s, offset))
            base += -(-tokens // capacity)
            held.clear()
            tokens = 0
            for lo in range(0, len(rows), 4096):
                part = rows[lo:lo + 4096]
                name, start, length, ids, total, sequence, offset = zip(*part)
                columns = [pa.array(name, pa.int64()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()),
                           pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                           pa.array(total, pa.int64()), pa.array(sequence, pa.int64()),
                           pa.array(offset, pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            if base is None and batch.num_rows:
                base = batch_column(batch, "part")[0].as_py() << 33
            names = batch_column(batch, "key").to_pylist()
            for name, body in zip(names, utf8(batch_column(batch, "text"))):
                ids = encode((body or b"").decode())
                held.append((name, np.append(ids, np.uint32(END_ID))))
                tokens += len(ids) + 1
                if tokens >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return source.mapInArrow(stage, schema)
