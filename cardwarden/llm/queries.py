"""The numbered operators applied to their whole tables, with SQL counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.llm import (
    alignment, decontamination, language, packing, passages, preferences, quality, repair, secrets, sharding,
    simhash, topk, warc,
)
from cardwarden.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def byte_bpe() -> packing.Encoder:
    """The public 50k byte-level vocabulary of this machine."""
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def both_vocabularies() -> alignment.Vocabularies:
    """The byte-level vocabulary and the piece model of this machine."""
    import public_tokenizers

    return alignment.Vocabularies(byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


def contract_bpe() -> packing.Encoder:
    """The same vocabulary with the ids ``tokenizers`` gives by default: added tokens are found in texts."""
    return replace(byte_bpe(), added_tokens=True)


@query
def op1_decontaminate(spark, d):
    marked = decontamination.mark_contamination(
        table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL["op1_decontaminate"] = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bp as (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from bw where len(w) > 0),
grams as (select distinct item_id, least(10, len(w)) as n,
                 array_to_string(list_slice(w, i, i + 9), ' ') as g from bp),
lengths as (select distinct n from grams),
dp as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lengths where len(w) >= n),
dg as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g from dp),
hits as (select doc_id, dg.n, i, item_id from dg join grams on dg.n = grams.n and dg.g = grams.g),
places as (select doc_id, count(distinct p) as n_hit
           from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
          from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join places using (doc_id) left join found using (doc_id)
"""


@query
def op7_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, d, "labels"))
    return quality.with_quality(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op9_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), contract_bpe(), with_ids=False)


@query
def op10_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op2_warc(spark, d):
    archives = warc.archive_pages(table(spark, d, "pages"))
    records = warc.read_records(warc.locate_records(archives), with_payload=False)
    return records.select(
        F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"))


SQL["op2_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
s as (select page_id, cast(strlen(body) as bigint) as n, sha1(body) as digest from p),
o as (select *, max(page_id) over (partition by digest, n) as original from s)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= 1000 and original <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and original <> page_id then original end as refers_to
from o
"""


@query
def op3_secrets(spark, d):
    found = secrets.scan(table(spark, d, "documents"))
    return found.select("doc_id", "ordinal", "start", "length", "kind", "value_sha256", "probability", "is_secret")


@query
def op4_topk(spark, d):
    vectors = topk.scaled(table(spark, d, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 100 == 0, 10)


SQL["op4_topk"] = """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as c
  from embeddings
  where vec_id is not null and embedding is not null
    and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, v.vec_id,
         cast(coalesce(list_sum([q.c[i] * v.c[i] for i in range(1, len(q.c) + 1)]), 0) as bigint) as score
  from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


@query
def op5_language(spark, d):
    model = language.fit_text_model(table(spark, d, "documents"))
    return language.identify_languages(table(spark, d, "pages"), model)


@query
def op6_preferences(spark, d):
    pairs = preferences.format_preferences(preferences.reply_swaps(table(spark, d, "conversations")))
    marks = lambda c: F.array_join(F.transform(
        c, lambda s: F.concat(F.length(s["text"]).cast("string"), F.when(s["train"], "+").otherwise("-"))), ",")
    return pairs.select(
        "conv_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), "prompt", "chosen_text",
        marks("chosen_segments").alias("chosen_mask"), "rejected_text",
        marks("rejected_segments").alias("rejected_mask"))


SQL["op6_preferences"] = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as own
      from t group by conv_id),
l as (select conv_id, own,
        list_max([i for i in range(1, len(own) + 1) if own[i].role = 'assistant']) as place from c),
b as (select l.*, o.own[o.place] as borrowed from l left join l o on o.conv_id = xor(l.conv_id, 1)),
r as (select conv_id, own, case when place is null then own
        when borrowed is null then own[1:place - 1]
        else own[1:place - 1] || [borrowed] || own[place + 1:] end as other from b),
p as (select *, coalesce(
        list_min([i for i in range(1, least(len(own), len(other)) + 1) if own[i] <> other[i]]) - 1,
        least(len(own), len(other))) as n from r),
x as (select conv_id, n, own[1:n] as pre, own[n + 1:] as cho, other[n + 1:] as rej from p)
select conv_id, cast(n as bigint) as prompt_turns,
  coalesce(list_aggregate(['<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) for s in pre], 'string_agg', ''), '') as prompt,
  coalesce(list_aggregate(['<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) for s in cho], 'string_agg', ''), '') as chosen_text,
  coalesce(list_aggregate([(length(s.role) + 13) || '-,' || (length(s.text) + 11) || case when s.role = 'assistant' then '+' else '-' end for s in cho], 'string_agg', ','), '') as chosen_mask,
  coalesce(list_aggregate(['<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) for s in rej], 'string_agg', ''), '') as rejected_text,
  coalesce(list_aggregate([(length(s.role) + 13) || '-,' || (length(s.text) + 11) || case when s.role = 'assistant' then '+' else '-' end for s in rej], 'string_agg', ','), '') as rejected_mask
from x
"""


@query
def op8_sharding(spark, d):
    return sharding.shard_documents(table(spark, d, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_repair(spark, d):
    return repair.repair(table(spark, d, "conversations"), damage=True, with_text=False)


@query
def op12_passages(spark, d):
    return passages.remove_repeats(table(spark, d, "documents"), with_text=False)


SQL["op12_passages"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
g as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as g from p),
h as (select g, min(doc_id) as home from g group by g),
c as (select doc_id, list(distinct p) as gone
      from (select doc_id, unnest(range(i, i + 50)) as p from g join h using (g) where home < doc_id) group by doc_id),
k as (select doc_id, w, case when gone is null then w
        else list_select(w, list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i))) end as kept
      from d left join c using (doc_id))
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - len(kept) as bigint) as n_removed,
       sha256(array_to_string(kept, ' ')) as kept_sha256
from k
"""


@query
def op13_alignment(spark, d):
    return alignment.alignment_digests(table(spark, d, "documents"), both_vocabularies())
