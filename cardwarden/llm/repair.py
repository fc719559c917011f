"""Least-cost repair of conversations to the roles ``(s?(ua)+)?``.

The rows of a conversation are read in order. A row can be kept, given the other role or deleted, and
empty turns can be inserted; states say which roles have been given so far. A backward pass finds
the cost of the cheapest rest from every node (a place between rows, and a state). The arcs on cheapest
ways are ranked by the audits (edit initials) that begin with them, first by one letter, then by two, four
and so on: the rank of twice a length comes from the rank of the arc and that of the best arc where the
first half ends. When the longest audit is covered, every node points along its best arc, and pointers
doubled the same way give all nodes of the least path at once.

A conversation of any length is solved in blocks: costs of block ends are kept in a backward pass, and
paths are ranked block by block in a forward one. Texts pass through a task in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, quoted, written

#: Rows ranked together.
BLOCK = 1 << 15
KEEP, REROLE, DELETE, INSERT = b"K"[0], b"R"[0], b"D"[0], b"I"[0]
LETTERS = np.array([DELETE, INSERT, KEEP, REROLE])  # in ASCII order
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
_FAR = 1 << 40

# states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after the next user or assistant turn
TURN = np.array([USER, USER, ASSISTANT, USER])
#: a row's kind: 0 must go; else 1 + initial (system, user, assistant, other) and 4 more where truncated
GO, LATE = 0, 4
_KEPT = np.full((5, 4), -1)
_KEPT[1, START] = SYSTEM
_KEPT[2, [START, SYSTEM, ASSISTANT]] = USER
_KEPT[3, USER] = ASSISTANT
#: the state after keeping a row of a kind, or -1
KEPT = np.concatenate([_KEPT, _KEPT[1:]])
ENDS = np.array([0, _FAR, _FAR, 0])


def row_costs(kinds: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The cost of the cheapest rest from each state before each row and, last, at the end.

    ``kinds`` is (rows, conversations), missing rows (-1) first; ``end`` is (conversations, 4).
    """
    n, m = kinds.shape
    cost = np.empty((n + 1, m, 4), np.int64)
    cost[n] = _with_inserts(end)
    kept_to, stays = KEPT, np.arange(4)
    for i in range(n - 1, -1, -1):
        kind, after = kinds[i], cost[i + 1]
        late = np.where(kind > LATE, TRUNCATED_COST, 0)[:, None]
        rerole = np.where((kind > GO)[:, None], after[:, TURN] + REROLE_COST + late, _FAR)
        to = kept_to[np.maximum(kind, 0)]
        keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1) + late, _FAR)
        best = np.minimum(np.minimum(after[:, stays] + DELETE_COST, rerole), keep)
        cost[i] = np.where((kind < 0)[:, None], after, _with_inserts(best))
    return cost


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    found = cost.copy()
    found[:, USER] = np.minimum(cost[:, USER], INSERT_COST + cost[:, ASSISTANT])
    found[:, ASSISTANT] = np.minimum(cost[:, ASSISTANT], INSERT_COST + cost[:, USER])
    for state in (START, SYSTEM):
        found[:, state] = np.minimum(cost[:, state], INSERT_COST + found[:, USER])
    return found


def least_paths(kinds: np.ndarray, end: np.ndarray, end_rank: np.ndarray, source: np.ndarray,
                cost: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each conversation the least cheapest audit from a state before its first row, the state
    it ends in, and the ranks of the four first nodes.

    ``end`` and ``end_rank`` are costs and ranks of what follows, by state.
    """
    n, m = kinds.shape
    node = np.arange((n + 1) * m * 4).reshape(n + 1, m, 4)
    sink = node[n]
    # every cheapest arc, in the order of its node
    tails, letters, heads = [sink.ravel()], [np.full(m * 4, -1)], [sink.ravel()]
    # at the end, where the rest is what follows, nothing is left to do in this block
    at_end = cost[n] == end

    def add(mask, tail, letter, head):
        tails.append(tail[mask])
        letters.append(np.full(mask.sum(), letter))
        heads.append(head[mask])

    if n:
        here, after, kind = cost[:n], cost[1:], kinds[:, :, None]
        late = np.where(kind > LATE, TRUNCATED_COST, 0)
        real = np.broadcast_to(kind >= 0, here.shape)
        down = node[1:]
        add(~real, node[:n], -1, down)
        add(real & (here == after + DELETE_COST) & (here < _FAR), node[:n], 0, down)
        to = KEPT[np.maximum(kinds, 0)]
        target = np.take_along_axis(after, np.maximum(to, 0), 2)
        add(real & (to >= 0) & (here == target + late) & (here < _FAR), node[:n], 2,
            np.take_along_axis(down, np.maximum(to, 0), 2))
        add(real & (kind > GO) & (here == after[:, :, TURN] + REROLE_COST + late) & (here < _FAR),
            node[:n], 3, down[:, :, TURN])
    more = cost == cost[:, :, TURN] + INSERT_COST
    more[:n] &= (kinds >= 0)[:, :, None]
    more[n] &= ~at_end
    add(more & (cost < _FAR), node, 1, node[:, :, TURN])
    tail, letter, head = (np.concatenate(x) for x in (tails, letters, heads))
    drop = np.zeros(len(tail), bool)
    drop[:m * 4] = ~(at_end | (cost[n] >= _FAR)).ravel()  # a state that must first insert is no end
    tail, letter, head = tail[~drop], letter[~drop], head[~drop]
    order = np.lexsort((letter, tail))
    tail, letter, head = tail[order], letter[order], head[order]
    ends = (letter < 0) & (tail == head)
    rank = np.where(letter >= 0, letter + 4, 0)
    rank[ends] = end_rank.ravel()[head[ends] - sink[0, 0]]

    first = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
    where = np.full(node.size, -1)
    where[tail[first]] = np.arange(len(first))
    to = head.copy()
    longest, reach = 2 * (n + 2), 1
    while True:
        low = np.minimum.reduceat(rank, first)
        best = low[where[to]]
        if reach >= longest:
            break
        # arcs are ordered by the first 2k letters of the least audit that begins with them
        chosen = first + _first_true(rank == low[where[tail]], first)
        _, rank = np.unique(rank * (int(best.max()) + 1) + best, return_inverse=True)
        to = to[chosen[where[to]]]
        reach *= 2
    chosen = first + _first_true(rank == low[where[tail]], first)
    step = np.full(node.size, -1)
    step[tail[chosen]] = head[chosen]
    said = np.full(node.size, -1)
    said[tail[chosen]] = letter[chosen]
    jumps = [step]
    while 1 << len(jumps) < longest:
        jumps.append(jumps[-1][jumps[-1]])
    path = node[0, np.arange(m), source][:, None]
    for jump in jumps[::-1]:
        path = np.stack([path, jump[path]], axis=2).reshape(m, -1)
    texts = said[path]
    audits = [LETTERS[row[row >= 0]].astype(np.uint8).tobytes() for row in texts]
    return audits, path[:, -1] % 4, low[where[node[0]]]


def _first_true(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run beginning at ``first`` the distance of its first true entry."""
    place = np.where(mask, np.arange(len(mask)), len(mask))
    return np.minimum.reduceat(place, first) - first


def audits_of(conversations: list[bytes]) -> list[tuple[int, bytes]]:
    """Cost and audit of conversations given as strings of row kinds."""
    found: list[tuple[int, bytes] | None] = [None] * len(conversations)
    order = sorted(range(len(conversations)), key=lambda i: len(conversations[i]))
    held: list[int] = []
    for i in order + [-1]:
        length = len(conversations[i]) if i >= 0 else 0
        if held and (i < 0 or length * (len(held) + 1) > BLOCK):
            _together(conversations, held, found)
            held = []
        if i >= 0:
            if length > BLOCK:
                found[i] = _in_blocks(conversations[i])
            else:
                held.append(i)
    return found


def _together(conversations: list[bytes], held: list[int], found: list) -> None:
    n = max(len(conversations[i]) for i in held)
    kinds = np.full((n, len(held)), -1)
    for k, i in enumerate(held):
        own = np.frombuffer(conversations[i], np.uint8)
        kinds[n - len(own):, k] = own
    end = np.tile(ENDS, (len(held), 1))
    cost = row_costs(kinds, end)
    audits, _, _ = least_paths(kinds, end, np.zeros_like(end), np.zeros(len(held), np.int64), cost)
    for k, i in enumerate(held):
        found[i] = (int(cost[0, k, START]), audits[k])


def _in_blocks(conversation: bytes) -> tuple[int, bytes]:
    blocks = [np.frombuffer(conversation[at:at + BLOCK], np.uint8).astype(np.int64)[:, None]
              for at in range(0, len(conversation), BLOCK)]
    ends = [(ENDS[None], np.zeros((1, 4), np.int64))]
    for block in blocks[:0:-1]:
        end, rank = ends[-1]
        cost = row_costs(block, end)
        _, _, ranks = least_paths(block, end, rank, np.array([START]), cost)
        ends.append((cost[0], np.unique(ranks, return_inverse=True)[1].reshape(1, 4)))
    state, parts, total = np.array([START]), [], None
    for block, (end, rank) in zip(blocks, ends[::-1]):
        cost = row_costs(block, end)
        total = int(cost[0, 0, START]) if total is None else total
        audit, state, _ = least_paths(block, end, rank, state, cost)
        parts += audit
    return total, b"".join(parts)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with some rows dropped, emptied, cut, repeated or given the user's role.

    The rule is the CRC-32 of ``conv_id:turn``; nulls count as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.withColumn("n", number).filter("n <> 0").select(
        "conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.explode(F.expr("if(n = 3, array(1, 2), array(1))")).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``said``, a digest of role and text, and ``seen``: whether an earlier turn of the conversation has said it.

    Equal rows of one turn are found later, where they are neighbours.
    """
    rows = rows.withColumn("said", F.unhex(F.sha2(F.concat(
        F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(rank).alias("first"))
    return rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s"))).select(
        "conv_id", "turn", "role", "text", "said", (F.col("first") < rank).alias("seen"))


ORDER = ["known", "conv_id", "row", "turn", "role", "text"]
_SPACE = " \t\n\x0b\x0c\r"
_INITIALS = {"s": 0, "u": 1, "a": 2}

FACTS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType())])


def _stream(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """A head row for each conversation, then its rows in order; a conversation lies in one task, sorted by Spark."""
    known = F.col("conv_id").isNotNull().alias("known")
    both = heads.select(known, "*", F.lit(0).alias("row")).unionByName(
        rows.select(known, "*", F.lit(1).alias("row")), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*ORDER)


def audit(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``FACTS`` of every conversation of ``heads``; a row is held as one byte."""

    def stage(batches: Iterator[pa.RecordBatch]):
        done: list[list] = []
        kinds: list[bytearray] = []
        size, facts, turns, previous = 0, None, None, None

        def solved():
            for fact, (low, high, distinct), (cost, text) in zip(done, spans, audits_of(list(map(bytes, kinds)))):
                fact[1] = high - low + 1 - distinct if distinct else 0
                fact[6:] = [cost, text.decode()]
            columns = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if f.name == "audit" else pa.int64()) for c, f in zip(columns, FACTS)], names=FACTS.names)
            done.clear(), kinds.clear(), spans.clear()

        spans: list[list] = []
        for batch in batches:
            c = {n: batch_column(batch, n).to_pylist() for n in ("conv_id", "row", "turn", "role", "text", "said", "seen")}
            for i, is_row in enumerate(c["row"]):
                if not is_row:
                    if size >= 1 << 18:
                        yield from solved()
                        size = 0
                    facts, turns, previous = [c["conv_id"][i], 0, 0, 0, 0, 0, 0, ""], [None, None, 0], None
                    done.append(facts), spans.append(turns), kinds.append(bytearray())
                    size += 1
                    continue
                turn, role, text = c["turn"][i], c["role"][i], c["text"][i].rstrip(_SPACE)
                if turn is not None and turn != turns[1]:
                    turns[:] = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                if previous and (previous[1][:1] + role[:1]) not in ("su", "ua", "au"):
                    facts[5] += 1
                repeated = previous is not None and previous[0] == turn and previous[2] == c["said"][i]
                previous = (turn, role, c["said"][i])
                kind = 1 + _INITIALS.get(role[:1], 3)
                if not text:
                    facts[2], kind = facts[2] + 1, GO
                elif c["seen"][i] or repeated:
                    facts[3], kind = facts[3] + 1, GO
                elif text[-1] not in ".!?":
                    facts[4], kind = facts[4] + 1, kind + LATE
                kinds[-1].append(kind)
                size += 1
        if done:
            yield from solved()

    return _stream(heads, rows).mapInArrow(stage, FACTS)


def repaired(facts: DataFrame, rows: DataFrame, with_text: bool) -> DataFrame:
    """``FACTS`` with the digest of the repaired lines (and the lines): each row's text is read once, in order."""
    schema = T.StructType([*FACTS.fields, T.StructField("repaired_sha256", T.StringType()),
                           *([T.StructField("repaired", T.StringType())] if with_text else [])])
    names = {USER: "user", ASSISTANT: "assistant"}

    def stage(batches: Iterator[pa.RecordBatch]):
        fact, at, state, digest, empty, lines, out = None, 0, START, None, True, [], []

        def say(line: str):
            nonlocal empty
            digest.update((line if empty else "\n" + line).encode())
            empty = False
            if with_text:
                lines.append(line)

        def edits(until_row: bool):
            """The inserts up to the next row; then that row's edit, if one is due."""
            nonlocal at, state
            edit, script = None, fact[-1]
            while at < len(script) and edit is None:
                if script[at] == "I":
                    state = int(TURN[state])
                    say(names[state] + ":")
                elif until_row:
                    edit = script[at]
                else:
                    break
                at += 1
            return edit

        def closed():
            edits(False)
            return (*fact, digest.hexdigest(), *(["\n".join(lines)] if with_text else []))

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64())
                                               for c, f in zip(zip(*found), schema)], names=schema.names)

        for batch in batches:
            c = {n: batch_column(batch, n).to_pylist() for n in (*FACTS.names, "row", "role", "text")}
            for i, is_row in enumerate(c["row"]):
                if not is_row:
                    if fact is not None:
                        out.append(closed())
                    if len(out) >= 1024:
                        yield batch_of(out)
                        out = []
                    fact = tuple(c[n][i] for n in FACTS.names)
                    at, state, digest, empty, lines = 0, START, hashlib.sha256(), True, []
                    continue
                edit, role = edits(True), c["role"][i]
                if edit == "R":
                    state = int(TURN[state])
                    say(f"{names[state]}:{c['text'][i]}")
                elif edit == "K":
                    state = int(KEPT[1 + _INITIALS[role[0]], state])
                    say(f"{role}:{c['text'][i]}")
        if fact is not None:
            out.append(closed())
        if out:
            yield batch_of(out)

    return _stream(facts, rows).mapInArrow(stage, schema)


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", damage: bool = False, with_text: bool = True) -> DataFrame:
    """One row per conversation: what is wrong with it, and its cheapest repair.

    A row is blank, else a duplicate of an earlier row's role and text, else truncated (no closing
    mark), else sound. Rows are taken by turn, nulls first, rows of one turn by role and text. Null
    roles and texts are one space, rows with a null key are one conversation. With ``damage`` the
    rows are damaged by rule first; a conversation that loses all its rows stays, with zeros.
    Other columns are left out; an empty table gives no rows.
    """
    rows = conversations.select(quoted(key).cast("bigint").alias("conv_id"), quoted(turn).cast("bigint").alias("turn"),
                                quoted(role).cast("string").alias("role"), quoted(text).cast("string").alias("text"))
    heads = rows.select("conv_id").distinct()
    whole = damaged(rows) if damage else rows.fillna(" ", ["role", "text"])
    rows = written(marked(whole), "turns")
    facts = written(audit(heads, rows), "audits")
    done = repaired(facts, rows.select("conv_id", "turn", "role", "text"), with_text)
    return done.withColumnRenamed("conv_id", key)
