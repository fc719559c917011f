"""Conversation repair, recurring passages and token alignment against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from cardwarden.llm import alignment, passages, repair
from cardwarden.llm.queries import QUERIES, both_vocabularies

SPACE = r"[^\x20\x09-\x0D]+"


# --- conversation repair -----------------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(kinds, n=None):
    """Cost and least audit, by whole strings from the end; a kind is 'x' or an initial with '!' if truncated."""
    states = ["", "s", "u", "a"]

    def settle(rest):
        for _ in range(4):
            for q in states:
                cost, text = rest[NEXT[q]]
                rest[q] = min(rest[q], (cost + 5, "I" + text))
        return rest

    rest = settle({"": (0, ""), "s": (10 ** 9, ""), "u": (10 ** 9, ""), "a": (0, "")})
    for kind in reversed(kinds):
        before = {}
        for q in states:
            ways = [(rest[q][0] + 2, "D" + rest[q][1])]
            if kind != "x":
                late = 5 * kind.endswith("!")
                cost, text = rest[NEXT[q]]
                ways.append((cost + 1 + late, "R" + text))
                own = kind[0]
                if own == NEXT[q] or (own == "s" and q == ""):
                    cost, text = rest[own]
                    ways.append((cost + late, "K" + text))
            before[q] = min(ways)
        rest = settle(before)
    return rest[""]


def brute_repair(rows, damage=True):
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        n = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damage else 19
        role, text = said(role), said(text)
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        own += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, counts = set(), [], Counter()
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            counts[fault] += 1
            initial = role[:1] if role[:1] in set("sua") else "o"
            kinds.append("x" if fault in ("blank", "duplicate") else initial + "!" * (fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(kinds)
        lines, state, rest = [], "", iter(own)
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit == "D":
                continue
            state = row[1][:1] if edit == "K" else NEXT[state]
            name = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{name}:{row[2] if row else ''}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def repair_fixture():
    rng = random.Random(11)
    said = ["Yes.", "No!", "well", "", " \t", "Is it?", "so. ", None, "an end\u00a0"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(said) if rng.random() < 0.5 else f"row {t} {c}.")
            for c in range(120) for t in range(rng.randrange(1, 14))]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Line {t}.") for c in (500, 501) for t in range(6)]
    rows += [rows[-1]] * 3 + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (600, None, None, None)]
    return rows + [(-7, 1 << 40, "user", "far."), (-7, 2, "system", "near.")]


def test_repair_matches_brute_force(spark):
    rows = repair_fixture()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int, row string")
    for damage in (True, False):
        got = sorted(map(tuple, repair.repair(frame, damage=damage, with_text=False).collect()), key=str)
        assert got == brute_repair(rows, damage)
    assert repair.repair(frame.limit(0)).count() == 0
    told = repair.repair(frame).collect()
    assert all(hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"] for r in told)


def test_a_conversation_without_rows_stays(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id bigint, turn bigint, role string, text string")
    row = repair.repair(frame, damage=True, with_text=False).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_blocks_give_the_audits_of_whole_conversations(monkeypatch):
    rng = random.Random(4)
    kinds = ["x", "s", "u", "a", "o", "s!", "u!", "a!", "o!"]
    some = [bytes(rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8]) for _ in range(rng.choice([0, 1, 2, 9, 40]))) for _ in range(400)]
    whole = repair.audits_of(some)
    assert [(c, a.decode()) for c, a in whole] == [cheapest([kinds[k] for k in s]) for s in some]
    monkeypatch.setattr(repair, "BLOCK", 7)
    assert repair.audits_of(some) == whole


def test_repair_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_repair"](spark, sf_dir).collect()), key=str)
    assert got == brute_repair([tuple(r) for r in rows])


# --- recurring passages ------------------------------------------------------------------


def brute_passages(rows, window=50):
    split = [(k, re.findall(SPACE, t or "")) for k, t in rows]
    home = {}
    for k, w in split:
        for i in range(len(w) - window + 1 if k is not None else 0):
            g = tuple(w[i:i + window])
            home[g] = min(k, home.get(g, k))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if k is not None else 0):
            if home[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    return sorted(out, key=str)


def passage_fixture(window):
    rng = random.Random(12)
    words = lambda n, v=5000: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared = [words(rng.choice([window - 1, window, window + 1, 3 * window])) for _ in range(6)]
    rows = []
    for k in range(60):
        w = words(rng.randrange(3 * window))
        for _ in range(rng.randrange(3)):
            s = list(rng.choice(shared))
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = "edit"
            at = rng.randrange(len(w) + 1)
            w[at:at] = s[rng.randrange(len(s) // 3):]
        rows.append((k, "\t".join(w) if k % 7 else "  " + "\n ".join(w) + " "))
    rows += [rows[3], (3, rows[4][1]), (100, rows[5][1]), (100, rows[5][1]), (101, "same " * 300), (102, "same " * 120),
             (103, None), (104, ""), (None, rows[2][1]), (None, None), (-5, rows[7][1]), (105, "Zo\u0308e\u00a0x " * 90)]
    rows += [(200 + k, " ".join(words(20) + shared[3] + words(20))) for k in range(40)]
    return rows + [(300, " ".join(words(9000) + shared[3] + words(500)))]


@pytest.mark.parametrize("window,gram", [(50, 12), (6, 2), (5, 5)])
def test_passages_match_brute_force(spark, monkeypatch, window, gram):
    if window < 50:  # several shards, copies and pieces
        monkeypatch.setattr(passages, "SHARD_WORDS", 500)
        monkeypatch.setattr(passages, "PIECES", 3)
    rows = passage_fixture(window)
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, doc int, place int")
    got = passages.remove_repeats(frame, window=window, gram=gram)
    assert sorted(map(tuple, got.collect()), key=str) == brute_passages(rows, window)


def test_passages_of_an_empty_table(spark):
    assert passages.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- token alignment ---------------------------------------------------------------------


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = alignment.byte_of_character()

    def cuts(parts):
        at, ends = 0, []
        for p in parts:
            at += len(p)
            ends.append(at)
        return ends

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode()

    held, count = [], Counter()
    for k, t in rows:
        a = first.encode(" " + (t or ""), add_special_tokens=False).ids
        b = second.encode(t or "")
        left, right = [bytes(of[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(left) != (" " + t).encode() or b"".join(right) != (" " + t).encode():
            held.append((k, None))
            continue
        common = set(cuts(left)) & set(cuts(right))
        groups = []
        for side, ids in ((left, a), (right, b)):
            own, parts = [], []
            for i, end in zip(ids, cuts(side)):
                own.append(i)
                if end in common:
                    parts.append(own)
                    own = []
            groups.append(parts)
        groups = list(zip(*groups))
        links = [(x, y) for p, q in groups for x in p for y in q]
        count.update(set(links))
        held.append((k, (len(a), len(b), groups, links)))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for k, h in held:
        if h is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = h
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((k, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def alignment_fixture():
    rng = random.Random(13)
    words = ["straße", "l'été", "tokenisation", "Anfang", "12345", "  ", "\n\n", "<|endoftext|>", "<s>", "<0x41>", "日本語",
             "\u2581", "ﬁ", "e\u0301", "\U0001F600", "antidisestablishment", "....", "a", "the", "\t", "don't", "ÄÖ"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\x00 x"), (104, "a" * 3000), (105, "<s></s><unk>"), (None, "null id"),
             (7, rows[7][1]), (8, rows[9][1]), (106, "\u2581 " * 5), (107, "zq" * 2000 + "\u0416" * 999)]
    return rows


def test_alignment_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 50)
    rows = alignment_fixture()
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, row int, part int").repartition(3)
    got = alignment.alignment_digests(frame, both_vocabularies())
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(rows)
    assert alignment.alignment_digests(frame.limit(0), both_vocabularies()).count() == 0


@pytest.mark.parametrize("slice_links,wide", [(1 << 20, 4096), (8, 4096), (1 << 20, 3)])
def test_links_do_not_depend_on_slices(monkeypatch, slice_links, wide):
    monkeypatch.setattr(alignment, "SLICE_LINKS", slice_links)
    monkeypatch.setattr(alignment, "WIDE", wide)
    aligner = both_vocabularies().loaded()
    for _, text in alignment_fixture():
        tokens = aligner.tokens((text or "").encode())
        if tokens is None:
            continue
        groups = alignment.Groups.of(*tokens, aligner.length_a, aligner.length_b)
        expected = Counter()
        for g in range(groups.n):
            expected.update((int(x), int(y)) for x in groups.a[groups.group_a == g] for y in groups.b[groups.group_b == g])
        width = len(aligner.bytes_b)
        keys, times = groups.links(width)
        assert {divmod(int(k), width): int(t) for k, t in zip(keys, times)} == expected


def test_alignment_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_alignment"](spark, sf_dir).collect()), key=str) == brute_alignment(rows)
