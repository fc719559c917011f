"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Benchmark items become windows of n words. The windows are dealt into blocks of bounded
size; each block is broadcast as a hash set and all documents are scanned against it, so
the work is one map pass for a benchmark of usual size and one pass per block beyond.
A window can begin only where n consecutive words are all benchmark words, which few
places of a text satisfy; those places are looked up in the set and verified word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import (
    batch_column, quoted, utf8, with_columns, without, words, written,
)

#: Bytes of window text (and 64 for each entry) in one broadcast block.
BLOCK_BYTES = 32 << 20

STATE = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_bits", T.BinaryType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def benchmark_windows(benchmark: DataFrame, n: int = 10, item: str = "item_id",
                      text: str = "text") -> DataFrame:
    """Distinct ``(item, ngram)`` of all windows; an item of fewer than ``n`` words is one window."""
    source = benchmark.select(quoted(item).cast("string").alias("item"),
                              quoted(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("item", T.StringType()),
                           T.StructField("ngram", T.BinaryType())])

    def stage(batches):
        for batch in batches:
            for name, body in zip(batch_column(batch, "item").to_pylist(),
                                  utf8(batch_column(batch, "text"))):
                w = words(body)
                if not w:
                    continue
                grams = {b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()),
                     pa.array(list(grams), pa.binary())], names=["item", "ngram"])

    return source.mapInArrow(stage, schema).distinct()


def window_set(items: list[str | None], grams: list[bytes]) -> tuple[dict[bytes, list[str]], frozenset, list[int]]:
    """One block of windows as plain data: the n-grams with their items, their words, their lengths."""
    held: dict[bytes, list[str]] = {}
    vocabulary: set[bytes] = set()
    lengths: set[int] = set()
    for item, gram in zip(items, grams):
        if gram not in held:
            parts = gram.split(b" ")
            vocabulary.update(parts)
            lengths.add(len(parts))
        held.setdefault(gram, []).extend([] if item is None else [item])
    return held, frozenset(vocabulary), sorted(lengths)


def mark(windows: tuple[dict[bytes, list[str]], frozenset, list[int]], w: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words lie inside an occurrence of a window, and the items that occur."""
    held, vocabulary, lengths = windows
    hit = np.zeros(len(w), dtype=bool)
    found: set[str] = set()
    if not w or not lengths:
        return hit, found
    known = np.fromiter(map(vocabulary.__contains__, w), dtype=bool, count=len(w))
    unknown = np.concatenate([[0], np.cumsum(~known)])
    for n in lengths:
        if n > len(w):
            break
        for i in np.flatnonzero(unknown[n:] == unknown[:-n]).tolist():
            items = held.get(b" ".join(w[i:i + n]))
            if items is not None:
                hit[i:i + n] = True
                found.update(items)
    return hit, found


def _blocks(windows: DataFrame, block_bytes: int):
    sizes = windows.agg(F.sum(F.octet_length("ngram") + 64).alias("bytes")).first()["bytes"] or 0
    n_blocks = max(1, -(-sizes // block_bytes))
    number = F.pmod(F.xxhash64("ngram", "item"), F.lit(n_blocks))
    for k in range(n_blocks):
        rows = windows.filter(number == k).toArrow()
        yield k, n_blocks, window_set(rows.column("item").to_pylist(),
                                      rows.column("ngram").to_pylist())


def mark_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text",
                       item: str = "item_id", item_text: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``hit_bits`` (packed, a bit per word), ``items``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``; input columns of these names are replaced.

    ``items`` are ids as text, sorted. Null and wordless texts have no words and no hits.
    Items without words have no windows; an item without id marks words but is not listed.
    Repeated rows are marked each; an empty benchmark or document table gives no hits or rows.
    """
    spark = docs.sparkSession
    windows = written(benchmark_windows(benchmark, n, item, item_text), "windows")
    marked = docs
    for k, n_blocks, block in _blocks(windows, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        names = [f.name for f in STATE]
        if k:
            previous = [F.col(c).alias(f"__old_{c}") for c in names]
            marked = marked.select(*[quoted(c) for c in marked.columns if c not in names], *previous)

        def compute(batch, shared=shared, later=bool(k)):
            windows_now = shared.value
            counts, bits, items = [], [], []
            old = (batch_column(batch, "__old_hit_bits").to_pylist(),
                   batch_column(batch, "__old_items").to_pylist()) if later else None
            for row, body in enumerate(utf8(batch_column(batch, text))):
                w = words(body)
                hit, found = mark(windows_now, w)
                if old:
                    hit |= np.unpackbits(np.frombuffer(old[0][row], np.uint8), count=len(w)).astype(bool)
                    found |= set(old[1][row])
                counts.append(len(w))
                bits.append(np.packbits(hit).tobytes())
                items.append(sorted(found))
            return [pa.array(counts, pa.int64()), pa.array(bits, pa.binary()),
                    pa.array(items, pa.list_(pa.string()))]

        marked = with_columns(marked, text, STATE, compute)
        if k:
            marked = without(marked, *[f"__old_{c}" for c in names])
        if k < n_blocks - 1:
            marked = written(marked, "marked")
    marked = without(marked, "n_hit", "n_items", "items_sha256", "contaminated")
    return marked.withColumns({
        "n_hit": F.coalesce(_bit_count("hit_bits"), F.lit(0)).cast("bigint"),
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
    }).withColumn("contaminated", F.col("n_hit") > 0)


def _bit_count(column: str):
    digits = F.hex(column)
    ones = [("[1248]", 1), ("[3569AC]", 2), ("[7BDE]", 3), ("F", 4)]
    return sum((F.length(digits) - F.length(F.regexp_replace(digits, chars, ""))) * n
               for chars, n in ones)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, **options) -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    held = {f.name.lower() for f in STATE} | {"n_hit", "n_items", "items_sha256", "contaminated"}
    clash = {c: f"__kept_{c}" for c in docs.columns if c.lower() in held}
    marked = mark_contamination(docs.withColumnsRenamed(clash), benchmark, n, **options)
    return marked.filter(~F.col("contaminated")).select(
        *[quoted(clash.get(c, c)).alias(c) for c in docs.columns])


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text less everything from the first to the last word of each run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, end in edges.reshape(-1, 2).tolist():
        kept.append(text[at:spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*kept, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text",
                 **options) -> DataFrame:
    """All documents, hit words cut out of the text; adds what ``mark_contamination`` adds."""
    marked = mark_contamination(docs, benchmark, n, text, **options)

    def compute(batch):
        out = []
        for body, count, bits in zip(utf8(batch_column(batch, text)),
                                     batch_column(batch, "n_words").to_pylist(),
                                     batch_column(batch, "hit_bits").to_pylist()):
            hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)
            out.append(cut_spans(body, hit).decode() if hit.any() else body and body.decode())
        return [pa.array(out, pa.string())]

    cut = with_columns(marked, text, [T.StructField("__cut", T.StringType())], compute)
    return cut.select(*[F.col("__cut").alias(c) if c == text else quoted(c) for c in marked.columns])
