"""Decontamination, quality, packing and SimHash against brute-force versions on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from cardwarden.llm import decontamination, packing, quality, simhash, similar
from cardwarden.llm.queries import QUERIES, byte_bpe

DOCS = "doc_id bigint, text string, score string, items int, __fp int"


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def some_words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- decontamination ---------------------------------------------------------------------


def brute_decontamination(docs, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = []
    for name, text in items:
        w = split(text)
        windows += [(name, w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for name, g in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(name))
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contaminated_fixture():
    rng = random.Random(3)
    items = [(i, some_words(rng, 14)) for i in range(12)]
    items += [(90, "Kürze, WÜRZE!"), (91, None), (92, " .,;"), (93, items[0][1]), (100, items[1][1].upper())]
    docs = [(i, some_words(rng, 60)) for i in range(20)]
    docs += [(30, "x " + items[2][1] + " y " + items[0][1]), (31, None), (32, ""), (33, "...!"),
             (34, "kürze WÜRZE"), (35, "KÜRZE würze"), (36, items[1][1]), (36, items[1][1]),
             (37, " ".join(items[3][1].split()[2:13])), (None, items[4][1]),
             (38, "q " * 30_000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_hits_match_brute_force_in_one_and_in_many_blocks(spark, block_bytes):
    docs, items = contaminated_fixture()
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.mark_contamination(frame, bench, block_bytes=block_bytes)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == brute_decontamination(docs, items)
    assert {r["score"] for r in got.collect()} == {"s"}


def test_contaminated_documents_go_and_columns_stay(spark):
    docs, items = contaminated_fixture()
    frame = spark.createDataFrame([(i, t, "s", 7, 2) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontamination.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    clean = [(r[0], r[2]) for r in brute_decontamination(docs, items) if not r[5]]
    assert sorted((r["doc_id"] for r in kept.collect())) == sorted(d for d, _ in clean)
    assert {r["items"] for r in kept.collect()} == {7}


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([
        (1, "Before, One two three four five six seven eight nine TEN. After."),
        (2, "nothing ü here"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {1: "Before, . After.", 2: "nothing ü here", 3: None}


def test_empty_tables_of_documents_and_items(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = decontamination.mark_contamination(docs, bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in got) == [(1, 2, False), (2, 0, False)]
    assert decontamination.mark_contamination(docs.limit(0), bench).count() == 0


# --- SimHash -----------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    grams = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keyed):
    """keyed: (key, value) rows; the smallest key over links, by repeated relaxation."""
    values = np.array([v for _, v in keyed], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 2) for v in values]
    label = [k for k, _ in keyed]
    rank = lambda k: (k is None, k or 0)
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min((label[j] for j in js), key=rank)
            if low != label[i]:
                label[i], changed = low, True
    return label


def near_copies():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = some_words(rng, 400, 5000).split()
        for c in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9)}"
            rows.append((g * 100 + c, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "A"), (5004, "a"), (5005, "a b"), (5006, "a b c"),
             (5007, "ä Ä ß " * 400), (700, rows[0][1]), (700, rows[0][1]), (None, rows[0][1]), (None, "lonely words here")]
    return rows


def test_components_match_brute_force(spark):
    rows = near_copies()
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS)
    got = sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=str)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    label = brute_components(prints)
    assert got == sorted(((i, f"{v:016x}", c) for (i, v), c in zip(prints, label)), key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_one_document_of_each_component_stays(spark):
    rows = near_copies()
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    label = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(set(label), key=str)


@pytest.mark.parametrize("distance", [1, 2])
def test_large_postings_link_the_same_components(spark, distance):
    rng = np.random.default_rng(9)
    center = int(rng.integers(0, 2**63))
    values = {center}
    for _ in range(400):  # a dense ball and far away points
        flips = rng.choice(16, rng.integers(1, 4), replace=False)
        values.add(center ^ sum(1 << int(b) for b in flips))
    values |= {int(x) for x in rng.integers(-2**63, 2**63, 300)}
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    links = simhash.fingerprint_links(frame, "fp", distance).collect()
    unsigned = np.array(values, np.int64).view(np.uint64)
    index = {v: k for k, v in enumerate(values)}
    expected, got = list(range(len(values))), list(range(len(values)))

    def find(p, x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[k]) <= distance).tolist():
            a, b = find(expected, k), find(expected, j)
            expected[max(a, b)] = min(a, b)
    for r in links:
        a, b = find(got, index[r["a"]]), find(got, index[r["b"]])
        got[max(a, b)] = min(a, b)
    assert [find(got, k) for k in range(len(values))] == [find(expected, k) for k in range(len(values))]


def brute_similar(rows):
    """The keys that stay: of each component of texts with five-word Jaccard of 0.8 or more the smallest."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append({" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = [k for k, _ in rows]
    rank = lambda k: (k is None, k or 0)
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j], key=rank)
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return set(label)


def test_similar_documents_leave_one(spark):
    rng = random.Random(15)
    rows = near_copies()
    for g in range(30):  # copies around the bound, some linked only through others
        base = some_words(rng, 300, 5000).split()
        for c in range(6):
            copy = list(base)
            for _ in range(rng.randrange(1, 14)):
                copy[rng.randrange(len(copy))] = f"y{rng.randrange(999)}"
            rows.append((10_000 + g * 10 + c, " ".join(copy)))
    wanted = brute_similar(rows)
    assert len(wanted) < len(brute_components([(i, brute_fingerprint(t)) for i, t in rows]))
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS)
    kept = similar.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(wanted, key=str)
    assert similar.keep_one(frame.limit(0)).count() == 0


def test_pipeline_stage_finds_edited_copies(spark, sf_dir):
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = brute_similar([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, frame, sf_dir).collect()} == wanted


# --- quality -----------------------------------------------------------------------------


def test_descent_reaches_the_optimum():
    """On a small problem no feasible direction of any dual variable improves the solution."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    label = np.array([int(3 in r) ^ int(rng.random() < 0.1) for r in rows])
    scale = rng.normal(size=64)
    weights, bias = quality.dual_coordinate_descent(rows, scale, label, epochs=400)
    unit = [scale[r] / np.sqrt((scale[r] ** 2).sum()) for r in rows]
    raw = np.where(scale != 0, weights / np.where(scale != 0, scale, 1), 0)
    sign = np.where(label == 1, 1, -1)
    share = [max(1, (label == 0).sum()), max(1, (label == 1).sum())]
    cost = np.array([len(label) / (2 * share[y]) for y in label])

    def primal(w, b):
        margins = np.array([w[r] @ x + b for r, x in zip(rows, unit)])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * margins)).sum()

    best = primal(raw, bias)
    for _ in range(300):
        assert best <= primal(raw + rng.normal(size=64) * 0.02, bias + rng.normal() * 0.02) + 1e-6


def test_indicators_do_not_depend_on_neighbouring_texts():
    texts = [b"One two two.", b"", b"!!! x", "Ä ö 12 12".encode(), b"a" * 5000 + b" b"]
    owner, feature = quality.indicators(texts)
    for k, t in enumerate(texts):
        alone = quality.indicators([t])[1]
        assert feature[owner == k].tolist() == alone.tolist()
    assert not len(quality.indicators([b"", b" \n"])[0])


def quality_fixture(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = some_words(rng, 40, 4000).split()
        docs.append((i, " ".join(w + "###" if bad else w for w in words), "s", 1, 2))
        labels.append((i, int(not bad), 0))
    docs += [(900, None, "s", 1, 2), (901, "", "s", 1, 2), (None, "w1 w2", "s", 1, 2), docs[0], docs[0]]
    labels += [(7, None, 0), (None, 1, 0), (8, 1, 0), (8, 1, 1), (9999, 1, 0)]
    return (spark.createDataFrame(docs, DOCS),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_classifier_separates_held_out_rows(spark):
    docs, labels = quality_fixture(spark)
    model = quality.fit(docs, labels)
    rows = quality.with_quality(docs, model).withColumn("held", quality.held_out()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == int(r["doc_id"] % 4 != 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(400) if i % 4}


def test_held_out_labels_are_never_used(spark):
    docs, labels = quality_fixture(spark)
    turned = labels.withColumn("quality", quality.F.when(
        quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.shift) == (b.slope, b.shift)


def test_classifier_without_labels_or_with_one_class(spark):
    docs, labels = quality_fixture(spark)
    assert {r["score"] for r in quality.with_quality(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    ones = quality.with_quality(docs, quality.fit(docs, labels.filter("quality = 1"))).collect()
    assert {r["predicted"] for r in ones} == {1}
    assert quality.with_quality(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = quality_fixture(spark)
    assert quality.labelled_sample(labels, "doc_id", "quality", 50).count() == 50


# --- packing -----------------------------------------------------------------------------


@pytest.mark.parametrize("block_tokens", [1 << 22, 3000])
def test_every_id_lies_in_one_piece(spark, block_tokens):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [some_words(rng, rng.randrange(1, 900)) for _ in range(40)]
    texts += [None, "", "<|endoftext|> as text", "日本語 ٣ ᏸ́ ok", "don't  \n\n we'll\t1234", "ab" * 30_000]
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(texts)] + [(None, "no id", "s", 1, 2)]
    frame = spark.createDataFrame(rows, DOCS)
    pieces = packing.pack(frame, byte_bpe(), block_tokens=block_tokens).collect()
    exact = Tokenizer.from_file(byte_bpe().vocabulary)
    exact.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(rows)
    for name, text, *_ in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[name], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids"]) == (at, len(ids), part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(frame.limit(0), byte_bpe()).count() == 0


def test_blocks_are_full_and_costs_are_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 3000)
    placed = packing.pack_block(lengths, 1024)
    fill, cost = {}, {}
    for _, _, n, s, _ in placed:
        fill[s] = fill.get(s, 0) + n
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert sum(fill.values()) == lengths.sum()
    assert len(fill) == -(-lengths.sum() // 1024)
    assert sum(1024 - n for n in fill.values()) < 1024
    mixed = [c for s, c in cost.items() if fill[s] == 1024]
    assert max(mixed) <= 2 * 1024


def test_both_tokenizers_agree_on_settled_characters():
    encode, plain = byte_bpe().loaded(), packing.Encoder(byte_bpe().vocabulary).loaded()
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(1, 0x250)) for _ in range(60)) for _ in range(400)]
    texts += [f"a{chr(c)}{chr(c)} {chr(c)}b1" for c in range(1, 0x250)]
    for text in texts:
        assert encode(text).tolist() == plain(text).tolist()


def test_added_tokens_in_texts_get_the_contract_ids(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(byte_bpe().vocabulary)
    texts = ["end of file<|endoftext|>next file", "<|endoftext|>", "a <|endoftext|><|endoftext|> ü 日本", "<|endoftext>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = {i: exact.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.packed(spark, frame, "").collect()} == ids
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in QUERIES["op9_packing"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
