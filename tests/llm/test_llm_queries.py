"""The registered queries against DuckDB, and the pipeline against its stages done by hand."""

import hashlib

import pytest
from oracle_check import connect, differences

import corpus_pipeline
from cardwarden.llm import decontamination, quality, secrets
from cardwarden.llm.common import table
from cardwarden.llm.queries import QUERIES, SQL
from test_llm_text_operators import brute_components, brute_decontamination, brute_fingerprint, brute_similar


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    if name.startswith("op5"):
        assert rows.count() == table(spark, sf_dir, "pages").count()
    elif name.startswith("op11"):
        assert rows.count() == table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    elif not name.startswith("op3"):
        assert rows.select("doc_id").distinct().count() == table(spark, sf_dir, "documents").count()


def test_near_duplicates_match_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    label = brute_components(docs)
    got = sorted(map(tuple, QUERIES["op10_simhash"](spark, sf_dir).collect()))
    assert got == sorted((i, f"{v:016x}", c) for (i, v), c in zip(docs, label))


def test_pipeline_matches_its_stages_by_hand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = [r for r in docs.collect() if model.scores([(r["text"] or "").encode()])[0] >= 0.3]
    stay = brute_similar([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if r["doc_id"] in stay]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_decontamination([(r["doc_id"], r["text"]) for r in rows], items) if r[5]}
    rows = [r for r in rows if r["doc_id"] not in hit]
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
    kept = spark.createDataFrame(rows, docs.schema)
    found = [r for r in secrets.scan(kept).collect() if r["is_secret"]]
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in found:
        value = text[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["value_sha256"]
    from cardwarden.llm.queries import byte_bpe
    from tokenizers import Tokenizer

    decoder = Tokenizer.from_file(byte_bpe().vocabulary)
    by_doc = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).extend(r["ids"])
    for doc, ids in by_doc.items():
        expected = text[doc] or ""
        for r in sorted((r for r in found if r["doc_id"] == doc), key=lambda r: -r["start"]):
            expected = expected[:r["start"]] + "[SECRET]" + expected[r["start"] + r["length"]:]
        assert ids[-1] == 0 and decoder.decode(ids[:-1]) == expected


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_windows_of_a_hot_benchmark_stay_whole(spark):
    bench = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(50)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id bigint, text string")
    for block in (1 << 20, 400):
        row = decontamination.mark_contamination(docs, bench, block_bytes=block).first()
        assert (row["n_hit"], row["n_items"]) == (10, 50)
