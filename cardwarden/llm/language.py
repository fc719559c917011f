"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text (byte trigrams under models counted
over all labelled documents), the language the markup declares, the address suffix, and the
host. Declared language counts as an observation with its own likelihood, counted over
all pages. Host priors are smoothed towards their suffix and suffixes towards all pages, from
counts of the languages that the text alone suggests; a page does not vote for itself.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import batch_column, chunks, joined, quoted, utf8, with_columns, written

BITS = 14
MAX_LANGUAGES = 256

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)")
_TAG = re.compile(r"<[^<>]*>")
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def visible_text(markup: str) -> str:
    """The text between tags, without scripts, styles and comments, entities resolved."""
    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup)))


def trigrams(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of every trigram of letters and gaps between them.

    Everything but ASCII letters (folded) and bytes beyond ASCII is a gap; a trigram with two
    gaps in a row tells nothing and is left out.
    """
    data, starts = joined(texts)
    # a gap before the first text; the line feeds after the others are theirs
    letter = np.concatenate([[0], _LETTER[data]]).astype(np.uint32)
    a, b, c = letter[:-2], letter[1:-1], letter[2:]
    told = ((a > 0) | (b > 0)) & ((b > 0) | (c > 0))
    told[starts[1:] - 1] = False  # its middle is the gap between two texts
    owner = np.searchsorted(starts, np.flatnonzero(told), side="right") - 1
    code = (a << 16 | b << 8 | c)[told] * np.uint32(0x9E3779B1)
    return owner, (code >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    log_share: np.ndarray

    def log_likelihoods(self, texts: list[bytes]) -> np.ndarray:
        owner, feature = trigrams(texts, int(self.log_share.shape[1]).bit_length() - 1)
        return np.stack([np.bincount(owner, row[feature], len(texts)) for row in self.log_share], axis=1)


def fit_text_model(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS,
                   smoothing: float = 0.5) -> TextModel:
    """Trigram shares per language over all documents that name one.

    A task sends one row per language and trigram bucket; the table of the model is bounded by
    its parameters. Raises ``ValueError`` above ``MAX_LANGUAGES`` languages.
    """
    source = docs.filter(quoted(lang).isNotNull()).select(
        quoted(lang).cast("string").alias("lang"), quoted(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("feature", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def stage(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch_column(batch, "lang").to_pylist()
            at = 0
            for part in chunks(utf8(batch_column(batch, "text"))):
                known = sorted(set(names[at:at + len(part)]))
                number = np.array([known.index(x) for x in names[at:at + len(part)]])
                owner, feature = trigrams(part, bits)
                table = np.bincount(number[owner] << bits | feature, minlength=len(known) << bits)
                for k, x in enumerate(known):
                    counts[x] = counts.get(x, 0) + table[k << bits:(k + 1) << bits]
                if len(counts) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                at += len(part)
        for x, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(some), pa.string()), pa.array(some.astype(np.int32)),
                 pa.array(n[some].astype(np.int64))], names=schema.names)

    counted = written(source.mapInArrow(stage, schema).groupBy("lang", "feature").agg(
        F.sum("n").alias("n")), "trigrams")
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").limit(
        MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = counted.toArrow()
    counts = np.full((len(languages), 1 << bits), smoothing)
    place = {x: k for k, x in enumerate(languages)}
    lang_of = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[lang_of, rows.column("feature").to_numpy()] += rows.column("n").to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)))


def host_of(url: Column) -> Column:
    """The host in lower case without user and port; empty when there is none."""
    return F.lower(F.regexp_extract(
        F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))


def declared_in(markup: Column) -> Column:
    """The primary language subtag that the html element or a content-language meta declares."""
    body = F.coalesce(markup, F.lit(""))
    element = F.regexp_extract(body, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})\b""", 1)
    meta = F.regexp_extract(
        body, r"""(?i)<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?([a-z]{2,3})\b""", 1)
    return F.lower(F.when(element != "", element).otherwise(meta))


def _arg_max(values: str) -> Column:
    return (F.array_position(F.col(values), F.array_max(values)) - 1).cast("int")


def identify_languages(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url",
                       html: str = "html", text_weight: float = 1 / 3, host_weight: float = 10.0,
                       suffix_weight: float = 10.0) -> DataFrame:
    """``(key, host, suffix, declared, text_language, language, probability)`` per page.

    ``text_weight`` discounts trigrams, three of which share each letter; the other weights are
    the pseudo-counts with which a parent's prior enters. Ties go to the first language by
    name. Pages without text, url or markup are decided by the evidence left; a model without
    languages gives nulls. Repeated rows are pages of their own; other columns are ignored.
    """
    languages = model.languages
    # with one vote per row, each page has its vote taken from its host again
    base = pages.select(quoted(key).alias("__key"), quoted(url).cast("string").alias("__url"),
                        quoted(html).cast("string").alias("__html")).select(
        "__key", host_of(F.col("__url")).alias("host"), declared_in(F.col("__html")).alias("declared"),
        "__html").withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    if not languages:
        nothing = F.lit(None).cast("string")
        return base.select(F.col("__key").alias(key), "host", "suffix", "declared",
                           nothing.alias("text_language"), nothing.alias("language"),
                           F.lit(None).cast("double").alias("probability"))
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.log_share))

    def compute(batch):
        bodies = (visible_text((b or b"").decode()).encode()
                  for b in utf8(batch_column(batch, "__html")))
        text_model = TextModel(*shared.value)
        parts = [text_model.log_likelihoods(part) for part in chunks(bodies)]
        return [pa.array(list(np.concatenate(parts)), pa.list_(pa.float64()))]

    scored = with_columns(base, "__html", [T.StructField("ll", T.ArrayType(T.DoubleType()))], compute)
    known = F.array(*[F.lit(x) for x in languages])
    evidence = written(scored.select(
        "__key", "host", "suffix", "declared",
        F.when(F.array_contains(known, F.col("declared")), F.col("declared"))
        .when(F.col("declared") == "", F.lit("")).otherwise(F.lit("*")).alias("said"),
        "ll", _arg_max("ll").alias("guess")), "evidence")

    votes = [F.count_if(F.col("guess") == k).cast("double").alias(f"v{k}") for k in range(len(languages))]
    hosts = written(evidence.groupBy("host", "suffix").agg(*votes), "hosts")
    total = [F.sum(f"v{k}").alias(f"s{k}") for k in range(len(languages))]
    suffixes = written(hosts.groupBy("suffix").agg(*total), "suffixes")
    said = evidence.groupBy("said").agg(*[v.alias(f"d{k}") for k, v in enumerate(votes)])
    everything = suffixes.agg(*[F.sum(f"s{k}").alias(f"g{k}") for k in range(len(languages))]).first()
    overall = [(everything[k] or 0.0) + 1.0 for k in range(len(languages))]
    # at most one row per language, one for others and one for none
    said_rows = {r["said"]: [r[f"d{k}"] for k in range(len(languages))] for r in said.collect()}
    kinds = len(languages) + 2
    seen = [sum(row[k] for row in said_rows.values()) + kinds for k in range(len(languages))]
    log_said = F.create_map(*[x for name, row in said_rows.items() for x in (
        F.lit(name), F.array(*[F.lit(float(np.log((row[k] + 1.0) / seen[k]))) for k in range(len(languages))]))]
    ) if said_rows else F.lit(None).cast("map<string,array<double>>")

    share = F.array(*[F.lit(x / sum(overall)) for x in overall])
    by_suffix = suffixes.select(F.col("suffix").alias("__suffix"), F.array(
        *[f"s{k}" for k in range(len(languages))]).alias("in_suffix"))
    priors = written(hosts.join(by_suffix, hosts["suffix"] == F.col("__suffix")).select(
        F.col("host").alias("__host"), F.array(*[f"v{k}" for k in range(len(languages))]).alias("in_host"),
        "in_suffix"), "priors")
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    less_own = lambda c: F.transform(c, lambda x, k: x - F.when(k == F.col("guess"), 1.0).otherwise(0.0))
    joint = evidence.join(priors, evidence["host"] == F.col("__host")).withColumns({
        "in_host": less_own("in_host"), "in_suffix": less_own("in_suffix"), "overall": share,
        "on_declared": F.element_at(log_said, F.col("said"))})
    joint = joint.withColumn("in_suffix", F.zip_with("in_suffix", "overall", lambda n, p: (
        n + suffix_weight * p) / (total_of("in_suffix") + suffix_weight)))
    joint = joint.withColumn("prior", F.zip_with("in_host", "in_suffix", lambda n, p: (
        n + host_weight * p) / (total_of("in_host") + host_weight)))
    joint = joint.withColumn("log_joint", F.zip_with(F.zip_with(
        F.transform("ll", lambda x: x * text_weight), "on_declared", lambda a, b: a + b),
        "prior", lambda a, p: a + F.ln(p)))
    joint = joint.withColumn("best", _arg_max("log_joint"))
    odds = F.aggregate("log_joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("log_joint")))
    return joint.select(
        F.col("__key").alias(key), "host", "suffix", "declared", known[F.col("guess")].alias("text_language"),
        known[F.col("best")].alias("language"), (1.0 / odds).alias("probability"))
