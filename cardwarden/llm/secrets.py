"""Secret scan: candidate strings and a random forest that removes false positives.

Candidates are runs of token characters and values right after a secret's name. Each is described by its
length, the transitions between its characters, the share of it that dictionary words cover, the path
it stands in and the words around it. A random forest trained on labelled findings decides which are
secrets. Everything is a DataFrame operation. Texts are searched once, in a time that grows with their
length: what a pattern has read it consumes or passes over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden.llm.common import quoted, written

#: At most so many labelled findings train the forest.
MAX_FINDINGS = 20_000
#: A dictionary word is found in texts of at least so many classes.
MIN_TEXTS = 5
#: Words looked at on either side of a candidate.
NEAR = 3

# fixed values: words that name secrets, words that name harmless strings
NAMES_SECRET = r"(?i)(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
NAMES_HARMLESS = r"(?i)(?:example|sample|dummy|test|checksum|digest|commit|sha\d*|md5|uuid|guid|hash|etag)"
_ASSIGN = r"[\"'`]?\s{0,3}[:=]\s{0,3}[\"'`]?"
_VALUE = r"[^\s\x00-\x1f\"'`,;<>(){}\[\]]"
#: A secret's name, its sign of assignment and all of the value.
NAMED = NAMES_SECRET + r"[A-Za-z0-9_\-]{0,16}+" + _ASSIGN + f"(?={_VALUE}{{6}})"
# a whole JWT, a named value, a run of 16 token characters; '=' ends a run as padding only, and a name
# before '=' or ':' is no candidate. Values and runs are read to their end and never given back.
CANDIDATE = (
    r"(?:(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{10,}+(?:\.[A-Za-z0-9_\-]++){1,4}+"
    r"|" + NAMED + _VALUE + "++"
    r"|(?<![A-Za-z0-9_+/\-])(?![A-Za-z_\-]{1,64}+[0-9]{0,2}+" + _ASSIGN + r"[A-Za-z0-9_+/\-])"
    r"[A-Za-z0-9_+/\-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=\-]))?)")
#: Where candidates are marked in a text: a code point that is no character. A text's own ones become the other.
_MARK, _OTHER = "\ufdd0", "\ufdd1"
# fixed values: shapes of issued keys
FORMATS = {
    "aws": r"^(?:AKIA|ASIA)[0-9A-Z]{16}$",
    "github": r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    "jwt": r"^eyJ[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]+){0,4}$",
    "hex": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$",
    "digits": r"^[0-9]+$",
    "letters": r"^[A-Za-z]+$",
}

FEATURES = ["length", "transitions", "distinct", "digits", "uppers", "marks", "hex_share", "vowels",
            "coverage", "path_slashes", "path_harmless", "names_secret", "names_harmless",
            "assigned", "quoted_on_both"]


def row_key(key: str, text: str) -> list[Column]:
    """What tells rows apart: the key and a digest of the text; repeated rows are one."""
    return [F.coalesce(quoted(key).cast("string"), F.lit("")).alias("__key"),
            F.xxhash64(quoted(text)).alias("__text_hash")]


def _parts(text: Column) -> Column:
    """The text in pieces: what lies between matches, and at odd places the matches."""
    plain = F.translate(text.cast("string"), _MARK, _OTHER)
    return F.split(F.regexp_replace(plain, CANDIDATE, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _split_match(match: Column) -> Column:
    """``head, value, tail`` of a match: a name and its assignment go before, closing marks after the value."""
    head = F.regexp_extract(match, "^" + NAMED, 0)
    rest = F.substr(match, F.length(head) + 1)
    end = F.regexp_replace(rest, r"[^A-Za-z0-9=+/_!@#$%^&*?~\-]++$", "")
    value = F.when(F.length(head) > 0, end).otherwise(rest)
    return F.struct(head.alias("head"), value.alias("value"), F.substr(rest, F.length(value) + 1).alias("tail"))


def _counts(piece: Column) -> Column:
    """Whether a match is a candidate: named values have a digit or mark, or are runs of 16 token characters."""
    value = piece["value"]
    return (F.length(piece["head"]) == 0) | (F.length(value) >= 6) & (
        value.rlike("[0-9!@#$%^&*?+~]") | value.rlike(r"^[A-Za-z0-9_+/\-]{16,}$"))


def _first_words(text: Column) -> Column:
    return F.array_join(F.slice(F.split(F.ltrim(text), r"\s+", NEAR + 1), 1, NEAR), " ")


def _last_words(text: Column) -> Column:
    words = F.split(F.rtrim(text), r"\s+")
    return F.array_join(F.slice(words, -F.least(F.size(words), F.lit(NEAR)), NEAR), " ")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``(__key, __text_hash, key, ordinal, start, value, before, after, assigned, quoted_on_both, path)`` per candidate.

    ``ordinal`` counts matches from 0 in the text, ``start`` is in characters; ``before`` and ``after`` are the
    nearest words. Repeated rows give their candidates once.
    """
    where = quoted(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*row_key(key, text), quoted(key).alias("key"), F.coalesce(where, F.lit("")).alias("path"),
                       _parts(quoted(text)).alias("parts"))
    # not a filter, which would search every text a second time
    matches = F.when(F.size("parts") > 1, F.transform(F.sequence(F.lit(0), F.expr("size(parts) div 2 - 1")), lambda k: F.struct(
        F.get("parts", 2 * k).alias("gap"), _split_match(F.get("parts", 2 * k + 1)).alias("m"),
        F.get("parts", 2 * k + 2).alias("next"))))
    each = rows.select("__key", "__text_hash", "key", "path", F.posexplode(matches).alias("ordinal", "c"))
    before, after = F.concat("c.gap", "c.m.head"), F.concat("c.m.tail", "c.next")
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    quotes = F.array(*[F.lit(q) for q in "\"'`"])
    opened = F.array_contains(quotes, last)
    bare = F.when(opened, F.left(before, F.length(before) - 1)).otherwise(before)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    short = each.select(
        "__key", "__text_hash", "key", "ordinal", F.col("c.m.value").alias("value"), _counts(F.col("c.m")).alias("counts"),
        F.length(before).alias("to_value"), (F.length("c.m.value") + F.length("c.m.tail")).alias("on"),
        _last_words(before).alias("before"), _first_words(after).alias("after"),
        flag(F.right(F.rtrim(bare), F.lit(1)).isin(":", "=")).alias("assigned"),
        flag(opened & F.array_contains(quotes, first)).alias("quoted_on_both"), "path")
    once = short.dropDuplicates(["__key", "__text_hash", "ordinal"])
    so_far = Window.partitionBy("__key", "__text_hash").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(F.col("to_value") + F.col("on")).over(so_far) - F.col("on")).cast("int")
    return once.withColumn("start", start).filter("counts").drop("counts", "to_value", "on")


def letter_runs(text: Column) -> Column:
    """Distinct runs of three or more ASCII letters, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= 3))


def dictionary(docs: DataFrame, text: str = "text", least: int = MIN_TEXTS) -> DataFrame:
    """Words in texts of ``least`` different classes, of the 64 that a hash of the text deals texts into.

    So copies of a text count once, and a word needs ``least`` different texts at least; what is kept per word
    is one number, which is put together before the shuffle.
    """
    words = docs.select(F.xxhash64(quoted(text)).alias("t"), F.explode(letter_runs(quoted(text))).alias("word"))
    classes = F.bit_count(F.expr("bit_or(shiftleft(1L, cast(pmod(t, 64) as int)))"))
    return words.groupBy("word").agg(classes.alias("classes")).filter(F.col("classes") >= least).select("word")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the columns of ``FEATURES`` to candidates.

    Dictionary coverage joins the distinct letter runs of all candidates with the dictionary,
    so a value that is repeated very often is looked up once.
    """
    v = F.col("value")
    n = F.length(v)
    without = lambda chars: n - F.length(F.regexp_replace(v, chars, ""))
    values = found.select("value").distinct()
    pieces = values.select("value", F.explode(letter_runs(F.col("value"))).alias("word"))
    covered = written(pieces.join(words, "word").groupBy("value").agg(
        F.sum(F.length("word")).alias("covered")), "covered")
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda c: c.cast("double")
    return found.join(covered, "value", "left").withColumns({
        "length": n.cast("double"),
        "transitions": F.regexp_count(v, F.lit(change)) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digits": without("[0-9]") / n, "uppers": without("[A-Z]") / n,
        "marks": without(r"[^A-Za-z0-9]") / n, "hex_share": without("[0-9a-fA-F]") / n,
        "vowels": without("[aeiouAEIOU]") / n,
        "coverage": F.least(F.coalesce("covered", F.lit(0)) / n, F.lit(1.0)),
        "path_slashes": without("/") / n + flag(F.col("path").contains("/")),
        "path_harmless": flag(F.col("path").rlike(NAMES_HARMLESS)),
        "names_secret": flag(F.col("before").rlike(NAMES_SECRET)),
        "names_harmless": flag(F.col("before").rlike(NAMES_HARMLESS) | F.col("after").rlike(NAMES_HARMLESS)),
    }).drop("covered")


def rule_labels(findings: DataFrame) -> DataFrame:
    """Adds ``label`` where a rule is sure, null elsewhere: the labels when no reviewed ones exist.

    1: an issued key's shape, or a mixed or long hex string assigned in quotes to a secret's
    name and called nothing harmless. 0: letters or digits only, or called harmless.
    """
    v = F.col("value")
    issued = F.lit(False)
    for kind in ("aws", "github", "jwt"):
        issued = issued | v.rlike(FORMATS[kind])
    plain = v.rlike(FORMATS["letters"]) | v.rlike(FORMATS["digits"])
    named = (F.col("names_secret") == 1) & (F.col("assigned") == 1) & (F.col("names_harmless") == 0)
    return findings.withColumn("label", F.when(issued | (named & ~plain), 1.0).when(
        plain | (F.col("names_harmless") == 1), 0.0))


@dataclass
class Forest:
    """A fitted forest, or the one answer of labels that had a single class (none: no secrets)."""

    model: RandomForestClassificationModel | None
    constant: float = 0.0

    def probability(self, findings: DataFrame) -> DataFrame:
        if self.model is None:
            return findings.withColumn("probability", F.lit(self.constant))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(findings)
        return self.model.transform(vectors).withColumn(
            "__p", vector_to_array("__probability")[1]).select(*findings.columns, F.col("__p").alias("probability"))


def train(labelled: DataFrame, limit: int = MAX_FINDINGS, trees: int = 24, depth: int = 6) -> Forest:
    """A forest from at most ``limit`` labelled findings (``FEATURES``, ``value``, ``label``).

    Repeated values count once, so a copied secret does not outweigh the rest; the values are
    chosen in the order of a hash.
    """
    known = labelled.filter(F.col("label").isNotNull())
    once = written(known.groupBy("value").agg(
        F.min(F.struct("label", *FEATURES)).alias("f")).select("value", "f.*"), "labelled")
    sizes = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Forest(None, *sizes)
    # each class gets half of the bound, or what it has
    half = F.when(F.col("label") == 1, F.lit(limit // 2 / sizes[1.0])).otherwise(F.lit(limit // 2 / sizes[0.0]))
    chosen = once.filter(F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < half * (1 << 20))
    rows = written(chosen.orderBy(F.xxhash64("value"), "value").limit(limit), "training")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(rows)
    return Forest(RandomForestClassifier(
        featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw",
        predictionCol="__prediction", numTrees=trees, maxDepth=depth, seed=11).fit(vectors))


def judged(found: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """Adds ``probability``. Reviewed labels train one forest.

    Without them rules label the clear cases, and two forests are fitted, each on one half of the values:
    a finding is judged by the one that has not seen its value, so it must be like others that carry its
    label, or is overruled. Halves with one class only share a forest of all.
    """
    if labelled is not None:
        return train(labelled).probability(found)
    rules = written(rule_labels(found), "labels")
    known, fold = rules.filter("label is not null"), F.pmod(F.xxhash64("value", F.lit(5)), F.lit(2))
    both = known.groupBy(fold.alias("fold")).agg(F.count_distinct("label").alias("classes")).filter("classes = 2").count() == 2
    if not both:
        return train(known).probability(found)
    halves = [train(known.filter(fold != k)).probability(rules.filter(fold == k)) for k in (0, 1)]
    return halves[0].unionByName(halves[1]).drop("label")


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text",
         path: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: its place, kind, digest, probability and whether it is a secret.

    ``labelled`` are findings with a label; without them ``rule_labels`` marks this table's own.
    Null and empty texts and texts without candidates give no rows, repeated rows give rows
    once. The secret itself is not returned.
    """
    raw = written(candidates(docs, key, text, path), "candidates")
    found = written(described(raw, written(dictionary(docs, text), "words")), "findings")
    kind = F.coalesce(*[F.when(F.col("value").rlike(p), F.lit(k)) for k, p in FORMATS.items()], F.lit("mixed"))
    return judged(found, labelled).select(
        "__key", "__text_hash", F.col("key").alias(key), "ordinal", "start", F.col("length").cast("int").alias("length"),
        kind.alias("kind"), F.sha2("value", 256).alias("value_sha256"), "probability",
        (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source",
           mark: str = "[SECRET]", labelled: DataFrame | None = None, n_chars: str = "n_chars") -> DataFrame:
    """All documents in their own columns, every confirmed secret replaced by ``mark``.

    A column of character counts, if there, follows the text. Null texts stay null, repeated rows stay, and
    an empty table gives none. Where nothing is labelled nothing is replaced.
    """
    columns = docs.columns
    confirmed = written(scan(docs, labelled, key, text, path).filter("is_secret").groupBy("__key", "__text_hash").agg(
        F.sort_array(F.collect_set("ordinal")).alias("__confirmed")), "secrets")
    renamed = {c: f"__c{i}" for i, c in enumerate(columns)}
    rows = docs.select(*[quoted(c).alias(renamed[c]) for c in columns], *row_key(key, text)).join(
        confirmed, ["__key", "__text_hash"], "left")
    body, found = F.col(renamed[text]), F.col("__confirmed").isNotNull()
    # one digit per match up to the last confirmed one
    digits = F.split(F.array_join(F.transform("__confirmed", lambda o, i: F.concat(F.repeat(
        F.lit("0"), o - F.coalesce(F.get("__confirmed", i - 1), F.lit(-1)) - 1), F.lit("1"))), ""), "")
    rows = rows.withColumns({"__digits": F.when(found, digits), "__parts": F.when(found, _parts(body))})
    kept = F.transform("__parts", lambda p, i: F.when(
        (i % 2 == 1) & F.coalesce(F.get("__digits", F.shiftright(i, 1)) == "1", F.lit(False)),
        F.concat(_split_match(p)["head"], F.lit(mark), _split_match(p)["tail"])).otherwise(p))
    changed = {text: F.when(found, F.array_join(kept, "")).otherwise(body)}
    if n_chars in renamed:
        changed[n_chars] = F.when(found, F.length(changed[text]).cast(docs.schema[n_chars].dataType)).otherwise(
            F.col(renamed[n_chars]))
    return rows.select(*[changed.get(c, F.col(renamed[c])).alias(c) for c in columns])
