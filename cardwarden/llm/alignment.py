"""Alignment of the tokens of two vocabularies over the same bytes, with corpus-wide link counts.

Both tokenisations of a text cut it at byte offsets; offsets where both cut divide the tokens into
groups, and all tokens of a group are linked. Most groups are one token on either side with
the same bytes. Their links are counted by an array over the first vocabulary (the identity
map and a vector of document counts), which every task fills for itself. All other links are
pairs: counted by a shuffle on the pair, and brought back to their documents as lists of documents
per pair, so that a pair crosses the shuffle once for many documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, quoted, utf8, written
from cardwarden.llm.packing import Encoder

#: Links of one slice of groups, and links of a group beyond which its distinct ids are multiplied instead.
SLICE_LINKS, WIDE = 1 << 20, 4096
#: Documents' pairs that are turned into lists at a time.
CHUNK_PAIRS = 1 << 21


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    others = [b for b in range(256) if chr(b) not in table]
    return table | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabularies:
    """A byte-level BPE (with its ranks) and a piece model with byte fallback."""

    first: Encoder
    second: str

    def loaded(self) -> Aligner:
        return Aligner(self)


class Aligner:
    """Both vocabularies read: encoders, token bytes and the identity map."""

    def __init__(self, files: Vocabularies):
        import sentencepiece
        from tokenizers import Tokenizer

        self.encode_a = files.first.loaded()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.second)
        vocabulary = Tokenizer.from_file(files.first.vocabulary).get_vocab()
        of = byte_of_character()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in entry)
        self.bytes_b = [self._piece_bytes(i) for i in range(len(self.pieces))]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        by_bytes: dict[bytes, int] = {}
        for i, piece in enumerate(self.bytes_b):
            by_bytes.setdefault(piece, i)
        #: the id of the same bytes in the second vocabulary, or -1
        self.identity = np.array([by_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        self.said_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))], object)
        self.said_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], object)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Both id sequences, or nothing where either does not give back the text's bytes.

        A byte-level vocabulary always does: its tokens are cut from the bytes.
        """
        if not text:
            return None
        said = text.decode()
        a = self.encode_a(" " + said).astype(np.int64)
        b = np.array(self.pieces.encode(said), np.int64)
        whole = b" " + text
        if self.length_a[a].sum() != len(whole) or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            return None
        return a, b


@dataclass
class Groups:
    """Tokens of one text with, for each, whether it ends a group and which group it is in."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> Groups:
        end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        place = np.searchsorted(end_b, end_a)
        last_a = end_b[np.minimum(place, len(b) - 1)] == end_a
        last_b = np.zeros(len(b), bool)
        last_b[place[last_a]] = True
        return cls(a, b, last_a, last_b)

    def __post_init__(self):
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.group_b = np.cumsum(self.last_b) - self.last_b
        self.n = int(self.last_a.sum())
        self.count_a = np.bincount(self.group_a, minlength=self.n)
        self.count_b = np.bincount(self.group_b, minlength=self.n)
        self.start_a = np.cumsum(self.count_a) - self.count_a
        self.start_b = np.cumsum(self.count_b) - self.count_b

    def said(self, said_a: np.ndarray, said_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``"""
        parts = np.empty(len(self.a) + len(self.b), object)
        parts[np.arange(len(self.a)) + self.start_b[self.group_a]] = said_a[self.a + self.last_a * (len(said_a) // 2)]
        parts[np.arange(len(self.b)) + (self.start_a + self.count_a)[self.group_b]] = said_b[
            self.b + self.last_b * (len(said_b) // 2)]
        return "".join(parts.tolist())[:-1]

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct links as ``a * width + b``, sorted, and how often each occurs."""
        product = self.count_a * self.count_b
        single = product == 1
        raw, found = [self.a[self.start_a[single]] * width + self.b[self.start_b[single]]], []
        usual = np.flatnonzero((product > 1) & (product <= WIDE))
        slices = np.searchsorted(np.cumsum(product[usual]), np.arange(SLICE_LINKS, product[usual].sum(), SLICE_LINKS))
        for part in np.split(usual, slices):
            if len(part):
                at = np.repeat(np.arange(len(part)), product[part])
                nth = np.arange(len(at)) - np.repeat(np.cumsum(product[part]) - product[part], product[part])
                columns = self.count_b[part][at]
                left = self.a[self.start_a[part][at] + nth // columns]
                right = self.b[self.start_b[part][at] + nth % columns]
                raw.append(left * width + right)
            found.append(np.unique(np.concatenate(raw), return_counts=True))
            raw = [np.empty(0, np.int64)]
        for g in np.flatnonzero(product > WIDE).tolist():
            left, m = np.unique(self.a[self.start_a[g]:self.start_a[g] + self.count_a[g]], return_counts=True)
            right, n = np.unique(self.b[self.start_b[g]:self.start_b[g] + self.count_b[g]], return_counts=True)
            found.append(((left[:, None] * width + right).ravel(), (m[:, None] * n).ravel()))
        if len(found) == 1:
            return found[0]
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, place, np.concatenate([t for _, t in found]))
        return keys, times


LONGS = T.ArrayType(T.LongType())
ALIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
    T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()),
    T.StructField("same", T.ArrayType(T.IntegerType())), T.StructField("same_times", LONGS),
    T.StructField("pairs", LONGS), T.StructField("pair_times", LONGS)])


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def align(docs: DataFrame, vocabularies: Vocabularies, key: str = "doc_id", text: str = "text",
          with_groups: bool = True) -> DataFrame:
    """Per row its counts, groups and distinct links, those of equal bytes (``same``, by first id) apart.

    Null and empty texts, and texts that either vocabulary cannot give back byte by byte, have no
    tokens: zeros, an empty ``groups_sha256``. Repeated rows count as documents of their own.
    """
    source = docs.select(quoted(key).cast("bigint").alias("doc_id"), F.spark_partition_id().alias("part"),
                         quoted(text).cast("string").alias("text"))
    schema = T.StructType([f for f in ALIGNED if with_groups or f.name != "groups"])

    def stage(batches):
        aligner, row = vocabularies.loaded(), 0
        width = len(aligner.bytes_b)
        for batch in batches:
            ids, part = batch_column(batch, "doc_id").to_pylist(), batch_column(batch, "part")
            out: list[tuple] = []
            for at, body in enumerate(utf8(batch_column(batch, "text"))):
                row += 1
                number = (part[at].as_py() << 33) + row
                tokens = aligner.tokens(body or b"")
                if tokens is None:
                    found = (ids[at], number, 0, 0, 0, 0, "", "", [], [], [], [])
                else:
                    groups = Groups.of(*tokens, aligner.length_a, aligner.length_b)
                    said = groups.said(aligner.said_a, aligner.said_b)
                    links, times = groups.links(width)
                    same = aligner.identity[links // width] == links % width
                    found = (ids[at], number, len(groups.a), len(groups.b), groups.n, int(times.sum()),
                             hashlib.sha256(said.encode()).hexdigest(), said if with_groups else None,
                             (links[same] // width).astype(np.int32), times[same], links[~same], times[~same])
                out.append(found if with_groups else found[:7] + found[8:])
                if len(out) == 256:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, _arrow(f.dataType)) for c, f in zip(zip(*rows), schema)], names=schema.names)

    return source.mapInArrow(stage, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and how many each row has."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def same_counts(aligned: DataFrame) -> DataFrame:
    """``(a, n)``: documents with a link of ``a`` to its same-bytes id; one vector per task."""

    def stage(batches):
        counts = np.zeros(1, np.int64)
        for batch in batches:
            values, _ = _flat(batch.column(0))
            found = np.bincount(values, minlength=len(counts))
            found[:len(counts)] += counts
            counts = found
        a = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(counts[a])], names=["a", "n"])

    return aligned.select("same").mapInArrow(stage, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n)``: documents that hold each of the other links."""

    def stage(batches):
        for batch in batches:
            pair, n = np.unique(_flat(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(stage, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def holders(aligned: DataFrame) -> DataFrame:
    """``(pair, base, held)``: the rows that hold a pair, as distance from ``base`` and times in one number."""

    def stage(batches):
        def lists():
            pairs, rows, counts = (np.concatenate(x) for x in zip(*kept))
            for part in np.unique(rows >> 33).tolist():
                own = np.flatnonzero(rows >> 33 == part)
                own = own[np.argsort(pairs[own], kind="stable")]
                pair, base = pairs[own], int(rows[own].min())
                start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                held = pa.ListArray.from_arrays(
                    pa.array(np.append(start, len(pair)).astype(np.int32)), pa.array((rows[own] - base) << 32 | counts[own]))
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(pair[start]), pa.array(np.full(len(start), base)), held], names=["pair", "base", "held"])
                for at in range(0, len(start), 8192):
                    yield whole.slice(at, 8192)

        kept: list[tuple] = []
        size = 0
        for batch in batches:
            pair, lengths = _flat(batch_column(batch, "pairs"))
            times, _ = _flat(batch_column(batch, "pair_times"))
            kept.append((pair, np.repeat(batch_column(batch, "row").to_numpy(), lengths), times))
            size += len(pair)
            if size >= CHUNK_PAIRS:
                yield from lists()
                kept, size = [], 0
        if size:
            yield from lists()

    # rows of one task of align lie less than 2^31 apart; a link occurs less than 2^32 times in a text
    return aligned.select("row", "pairs", "pair_times").mapInArrow(stage, "pair bigint, base bigint, held array<bigint>")


def link_scores(aligned: DataFrame, width: int) -> DataFrame:
    """``(row, n_best, count_sum)`` of every row with links: over its links, how many are the most frequent
    of their first id, and the sum of their counts."""
    same = same_counts(aligned).withColumns({"a": F.col("a").cast("bigint")})
    pairs = written(pair_counts(aligned), "pairs")
    vectors = written(same, "same")
    best = vectors.unionByName(pairs.select(F.floor(F.col("pair") / width).alias("a"), "n")).groupBy("a").agg(
        F.max("n").alias("best"))
    table = best.join(vectors, "a", "left").toArrow()  # at most one row for each id of the first vocabulary
    a = table.column("a").to_numpy()
    top, own = np.zeros((2, int(a.max(initial=0)) + 1), np.int64)
    top[a] = table.column("best").to_numpy()
    own[a] = table.column("n").fill_null(0).to_numpy()

    def alike(batches):
        for batch in batches:
            ids, lengths = _flat(batch_column(batch, "same"))
            times, _ = _flat(batch_column(batch, "same_times"))
            at = np.repeat(np.arange(len(lengths)), lengths)
            yield _sums(batch_column(batch, "row").to_numpy(), at, times, own[ids], own[ids] == top[ids])

    def others(batches):
        """Sums of one chunk of documents at a time; its lists come together."""
        base, chunk = None, []

        def summed():
            distance, times, n, best = (np.concatenate(x) for x in zip(*chunk))
            near, at = np.unique(distance, return_inverse=True)
            return _sums(near + base, at, times, n, best)

        for batch in batches:
            if not batch.num_rows:
                continue
            held, lengths = _flat(batch_column(batch, "held"))
            bases = batch_column(batch, "base").to_numpy()
            n = np.repeat(batch_column(batch, "n").to_numpy(), lengths)
            first = np.repeat(batch_column(batch, "pair").to_numpy() // width, lengths)
            ends = np.cumsum(lengths)
            edge = np.flatnonzero(np.diff(bases)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(bases)]):
                if base is not None and bases[lo] != base:
                    yield summed()
                    chunk = []
                base = int(bases[lo])
                own = slice(int(ends[lo] - lengths[lo]), int(ends[hi - 1]))
                chunk.append((held[own] >> 32, held[own] & 0xFFFFFFFF, n[own], n[own] == top[first[own]]))
        if chunk:
            yield summed()

    parts = "row bigint, n_best bigint, count_sum bigint"
    regular = aligned.select("row", "same", "same_times").mapInArrow(alike, parts)
    counted = holders(aligned).join(pairs, "pair").select("pair", "base", "held", "n")
    irregular = counted.repartition("base").sortWithinPartitions("base").mapInArrow(others, parts)
    return regular.unionAll(irregular).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _sums(rows: np.ndarray, at: np.ndarray, times: np.ndarray, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    n_best, count_sum = np.zeros((2, len(rows)), np.int64)
    np.add.at(n_best, at, times * best)
    np.add.at(count_sum, at, times * count)
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(n_best), pa.array(count_sum)],
                                      names=["row", "n_best", "count_sum"])


def alignment_digests(docs: DataFrame, vocabularies: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the counts of ``align`` with ``n_best`` and ``count_sum``; columns besides ``key`` and ``text`` are left out."""
    aligned = written(align(docs, vocabularies, key, text, with_groups=False), "aligned")
    scores = link_scores(aligned, len(vocabularies.loaded().bytes_b))
    return aligned.join(scores, "row", "left").select(
        F.col("doc_id").alias(key), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")
