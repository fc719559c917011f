"""Substring dedup by automata of recurring passages.

A passage is a sequence of ``window`` words (50) or more. Every window has one anchor: the ``gram``-word
sequence in it with the least hash. Consecutive windows with the same anchor form a unit, at
most 2 * window words long, and equal windows lie at equal places of units with equal anchors.

1. Scan: all units of all documents, as digests. Anchors that occur in one document only are dropped.
2. Confirm: where all units of an anchor are equal, all their windows recur. Where they differ, the
   windows of the distinct units are compared one by one. Either way every recurring window
   gets its home, the smallest document id it starts in; runs of windows with one home are phrases.
3. Compile: phrases are dealt into shards of bounded size by the place they first occur at. A
   shard's phrases become an Aho-Corasick automaton over word numbers.
4. Stream: pieces of all documents that hold a unit with a phrase are streamed through the automata of
   the shards those phrases lie in. Shards with many pieces are copied, and their pieces dealt over the copies.
   Words covered by a phrase whose home is a smaller id are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, quoted, utf8, written

WINDOW, GRAM = 50, 12
#: Words of a document in one piece (besides the windows that begin in it), and pieces for one copy of an automaton.
PIECE, PIECES = 4096, 4096
#: Words of phrases in one automaton; a word takes about 40 bytes there.
SHARD_WORDS = 1 << 19

_SEED = 42
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Hashes(dict):
    """XXH64 of words, computed once for each of the last million distinct ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, _SEED)
        return found


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[base] = (made[0], made[1])
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Digests of any word range of one text."""

    def __init__(self, hashes: np.ndarray):
        self.sums = []
        for base in _BASES:
            up, _ = _powers(base, len(hashes) + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)])]))

    def digest(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        _, down = _powers(_BASES[which], len(self.sums[which]))
        sums = self.sums[which]
        return _mixed((sums[start + length] - sums[start]) * down[start])


def units(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(place, anchor, first digest, second digest)`` of all units of a text.

    A place packs the first window's start, the number of windows and the anchor's offset.
    """
    m, width = len(hashes) - window + 1, window - gram + 1
    if m < 1:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    roll = Rolling(hashes)
    grams = roll.digest(0, np.arange(m + width - 1), gram)
    anchor = np.empty(m, np.int64)
    for at in range(0, m, 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(grams[at:at + (1 << 15) + width - 1], width)
        part = part[:m - at]
        anchor[at:at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, m))
    offset = anchor[start] - start
    shape = (count << 8 | offset).astype(np.uint64)
    first, second = (_mixed(roll.digest(k, start, count + window - 1) + shape) for k in (0, 1))
    return (start << 16 | count << 8 | offset, grams[anchor[start]].view(np.int64),
            first.view(np.int64), second.view(np.int64))


def _start(place):
    return F.shiftright(place, 16)


def _count(place):
    return F.shiftright(place, 8).bitwiseAND(255)


def _hashes(words: list[bytes], held: _Hashes) -> np.ndarray:
    return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


SCAN = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("text_key", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()),
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("place", "anchor", "u1", "u2")]])


def scan(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Per document its word count, the digest of its words and its units (none without an id)."""

    def stage(batches):
        held = _Hashes()
        for batch in batches:
            ids = batch_column(batch, "doc").to_pylist()
            keys = batch_column(batch, "text_key").to_pylist()
            out: list[tuple] = []
            for name, key, body in zip(ids, keys, utf8(batch_column(batch, "text"))):
                words = body.split() if body else []
                found = units(_hashes(words, held) if name is not None else np.empty(0, np.uint64), window, gram)
                out.append((name, key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), *found))
                if len(out) == 512:
                    yield _batch(out, SCAN)
                    out = []
            if out:
                yield _batch(out, SCAN)

    return rows.mapInArrow(stage, SCAN)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows), schema)], names=schema.names)


WINDOWS = T.StructType([T.StructField(c, T.LongType()) for c in ("w1", "w2", "doc", "last", "u1", "u2", "nth")])


def windows_of_units(texts: DataFrame, window: int) -> DataFrame:
    """Digests of the windows of the units listed in ``texts.listed``, with the ids they span."""

    def stage(batches):
        held = _Hashes()
        for batch in batches:
            ids, listed = batch_column(batch, "doc").to_pylist(), batch_column(batch, "listed")
            for row, body in enumerate(utf8(batch_column(batch, "text"))):
                roll = Rolling(_hashes(body.split(), held))
                u = listed[row].values.flatten()
                u1, u2, place, last = (np.asarray(x) for x in u)
                n = place >> 8 & 255
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(place >> 16, n) + nth
                columns = [roll.digest(0, at, window).view(np.int64), roll.digest(1, at, window).view(np.int64),
                           np.full(len(at), ids[row]), np.repeat(last, n), np.repeat(u1, n), np.repeat(u2, n), nth]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=WINDOWS.names)

    return texts.select("doc", "text", "listed").mapInArrow(stage, WINDOWS)


LOADS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("kind", T.IntegerType()),
    T.StructField("doc", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("text", T.BinaryType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("begin", "size", "home")]])


def loads(texts: DataFrame, window: int) -> DataFrame:
    """The words of phrases (kind 0) and the pieces to stream (kind 1) with the automaton they go to.

    ``texts`` has for each document ``gives(shard, copies, at, windows, home)`` and
    ``takes(shard, copy, piece)``. Phrases of one shard in one stretch of a document travel as that
    stretch and the places in it.
    """

    def stage(batches):
        for batch in batches:
            ids, keys = batch_column(batch, "doc").to_pylist(), batch_column(batch, "text_key").to_pylist()
            gives, takes = batch_column(batch, "gives"), batch_column(batch, "takes")
            for row, body in enumerate(utf8(batch_column(batch, "text"))):
                words, out = body.split(), []
                for shard, copy, piece in ({tuple(t.values()) for t in takes[row].as_py() or ()}):
                    at = piece * PIECE
                    out.append((shard, copy, 1, ids[row], keys[row], at,
                                b" ".join(words[at:at + PIECE + 2 * window]), None, None, None))
                stretches: dict[tuple, set] = {}
                for g in gives[row].as_py() or ():
                    stretches.setdefault((g["shard"], g["copies"], g["at"] // PIECE), set()).add(
                        (g["at"], g["windows"] + window - 1, g["home"]))
                for (shard, copies, _), found in stretches.items():
                    begin, size, home = (list(x) for x in zip(*sorted(found)))
                    low, high = begin[0], max(b + s for b, s in zip(begin, size))
                    text, begin = b" ".join(words[low:high]), [b - low for b in begin]
                    out += [(shard, c, 0, ids[row], keys[row], low, text, begin, size, home) for c in range(copies)]
                for at in range(0, len(out), 64):
                    yield _batch(out[at:at + 64], LOADS)

    return texts.select("doc", "text_key", "text", "gives", "takes").mapInArrow(stage, LOADS)


COVERED = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "text_key", "begin", "end")])


def occurrences(load: DataFrame) -> DataFrame:
    """Word ranges of each streamed piece that phrases with a smaller home cover.

    The rows of an automaton lie in one task, its phrases first; a task holds one automaton at a time.
    """

    def stage(batches):
        import ahocorasick

        at_key, numbers, phrases, automaton = None, {}, {}, None

        def compiled():
            if not phrases:
                return None
            made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for sequence, home in phrases.items():
                made.add_word(sequence, (len(sequence), home))
            made.make_automaton()
            phrases.clear()
            return made

        for batch in batches:
            cols = {c: batch_column(batch, c).to_pylist() for c in LOADS.names if c != "text"}
            out: list[tuple] = []
            for row, body in enumerate(utf8(batch_column(batch, "text"))):
                key = (cols["shard"][row], cols["copy"][row])
                if key != at_key:
                    at_key, automaton = key, None
                    numbers.clear(), phrases.clear()
                if cols["kind"][row] == 0:
                    ids = [numbers.setdefault(w, len(numbers) + 1) for w in body.split()]
                    for b, s, home in zip(cols["begin"][row], cols["size"][row], cols["home"][row]):
                        phrase = tuple(ids[b:b + s])
                        phrases[phrase] = min(home, phrases.get(phrase, home))
                    continue
                automaton = automaton or compiled()
                if automaton is None:
                    continue
                doc, low = cols["doc"][row], cols["at"][row]
                ids = tuple(numbers.get(w, 0) for w in body.split())
                begin = end = 0
                for last, (size, home) in automaton.iter(ids):
                    if home >= doc:
                        continue
                    if last + 1 - size > end:
                        if end:
                            out.append((doc, cols["text_key"][row], low + begin, low + end))
                        begin, end = last + 1 - size, last + 1
                    else:
                        begin, end = min(begin, last + 1 - size), last + 1
                if end:
                    out.append((doc, cols["text_key"][row], low + begin, low + end))
            if out:
                yield _batch(out, COVERED)

    return load.mapInArrow(stage, COVERED)


CUT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("text_key", T.LongType()),
                    T.StructField("n_removed", T.LongType()), T.StructField("cut_sha", T.StringType()),
                    T.StructField("kept", T.StringType())])


def cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """What is left of the words outside ``covered(begin, end)``."""
    schema = T.StructType(CUT.fields[:None if with_text else -1])

    def stage(batches):
        for batch in batches:
            ids, keys = batch_column(batch, "doc").to_pylist(), batch_column(batch, "text_key").to_pylist()
            covered = batch_column(batch, "covered")
            for row, body in enumerate(utf8(batch_column(batch, "text"))):
                words, kept, at = body.split(), [], 0
                for begin, end in sorted((c["begin"], c["end"]) for c in covered[row].as_py()):
                    kept += words[at:begin] if begin > at else []
                    at = max(at, end)
                kept += words[at:]
                line = b" ".join(kept)
                found = (ids[row], keys[row], len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode())
                yield _batch([found[:len(schema)]], schema)

    return texts.select("doc", "text_key", "text", "covered").mapInArrow(stage, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row (and the ``kept`` words of those that lost any, else null).

    A word goes if a window over it also starts in a row with a smaller key. Null, empty and
    shorter texts lose nothing, nor do rows with a null key, which are no one's source either; rows of
    equal key keep what they share. Repeated rows get equal results; an empty table gives no rows.
    Other columns are left out.
    """
    if not gram <= window <= 120:
        raise ValueError("a window has gram to 120 words")
    rows = docs.select(quoted(key).cast("bigint").alias("doc"), F.xxhash64(quoted(text)).alias("text_key"),
                       quoted(text).cast("string").alias("text"))
    scanned = written(scan(rows, window, gram), "scan")
    posting = scanned.select("doc", "text_key", F.explode(F.arrays_zip("place", "anchor", "u1", "u2")).alias("u")).select(
        "doc", "text_key", "u.*")
    recurring = posting.groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("u1").alias("least"), F.max("u1").alias("most")
    ).filter("low < high").select("anchor", F.expr("least = most").alias("same"))
    posting = written(posting.join(recurring, "anchor").drop("anchor"), "recurring")
    unit = written(posting.groupBy("u1", "u2", "same").agg(
        F.min(F.struct("doc", "text_key", "place")).alias("first"), F.max("doc").alias("last")), "units")
    holders = posting.select("doc", "text_key").distinct()
    texts = written(rows.join(holders, ["doc", "text_key"], "left_semi"), "holders")

    differing = unit.filter("not same").groupBy("first.doc", "first.text_key").agg(
        F.collect_list(F.struct("u1", "u2", "first.place", "last")).alias("listed"))
    window_rows = written(windows_of_units(texts.join(differing, ["doc", "text_key"]), window), "windows")
    homes = window_rows.groupBy("w1", "w2").agg(F.min("doc").alias("home"), F.max("last").alias("high")).filter("home < high")
    confirmed = window_rows.join(homes, ["w1", "w2"]).filter("home < last").select("u1", "u2", "nth", "home")
    runs = written(confirmed.distinct().groupBy("u1", "u2").agg(
        F.sort_array(F.collect_list(F.struct("nth", "home"))).alias("found")), "runs")
    # the first window of a run is one whose predecessor is missing or has another home
    heads = F.expr("""transform(filter(sequence(0, size(found) - 1), i -> i = 0
        or found[i].nth <> found[i - 1].nth + 1 or found[i].home <> found[i - 1].home),
        (i, k) -> struct(i as i, k as k))""")
    phrase = F.expr("""transform(heads, h -> struct(
        found[h.i].nth as nth, found[h.i].home as home,
        cast(coalesce(get(heads, h.k + 1).i, size(found)) - h.i as bigint) as windows))""")
    several = runs.withColumn("heads", heads).select("u1", "u2", phrase.alias("phrases"))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("nth"), F.col("first.doc").alias("home"),
                           _count(F.col("first.place")).alias("windows")))
    confirmed_units = written(unit.filter("same and last > first.doc").select("u1", "u2", "first", one.alias("phrases")).unionByName(
        unit.filter("not same").join(several, ["u1", "u2"]).select("u1", "u2", "first", "phrases")), "phrases")

    size = confirmed_units.agg(F.sum(F.expr(
        f"aggregate(phrases, 0L, (n, p) -> n + p.windows + {window - 1})")).alias("n")).first()["n"] or 0
    shards = 1 + size // SHARD_WORDS
    shard = F.pmod(F.xxhash64(F.col("first.doc"), F.shiftright(_start(F.col("first.place")), 13)), F.lit(shards))
    confirmed_units = confirmed_units.withColumn("shard", shard)
    lowest = F.array_min(F.transform("phrases", lambda p: p["home"]))
    takes = written(posting.join(confirmed_units.select("u1", "u2", "shard", lowest.alias("home")), ["u1", "u2"]).filter(
        "doc > home").select("doc", "text_key", "shard", F.floor(_start(F.col("place")) / PIECE).alias("piece")).distinct(), "takes")
    copies = takes.groupBy("shard").agg(F.ceil(F.count("*") / PIECES).alias("copies"))
    takes = takes.join(copies, "shard").groupBy("doc", "text_key").agg(F.collect_list(F.struct(
        "shard", F.pmod(F.xxhash64("doc", "text_key", "piece"), F.col("copies")).alias("copy"), "piece")).alias("takes"))
    given = confirmed_units.select("first.doc", "first.text_key", _start(F.col("first.place")).alias("start"), "shard",
                                   F.explode("phrases").alias("p")).join(copies, "shard")
    gives = given.groupBy("doc", "text_key").agg(F.collect_list(F.struct(
        "shard", "copies", (F.col("start") + F.col("p.nth")).alias("at"), "p.windows", "p.home")).alias("gives"))
    routed = texts.join(gives.join(takes, ["doc", "text_key"], "full"), ["doc", "text_key"])
    load = loads(routed, window)
    dealt = load.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    covered = written(occurrences(dealt), "covered").distinct().groupBy("doc", "text_key").agg(
        F.collect_list(F.struct("begin", "end")).alias("covered"))
    changed = cut(texts.join(covered, ["doc", "text_key"]), with_text).dropDuplicates(["doc", "text_key"])
    result = scanned.select("doc", "text_key", "n_words", "sha").join(changed, ["doc", "text_key"], "left")
    columns = [F.col("doc").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
               F.coalesce("cut_sha", "sha").alias("kept_sha256")]
    return result.select(*columns, *(["kept"] if with_text else []))
