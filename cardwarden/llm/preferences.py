"""Preference formatting: a shared prompt and two masked completions, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden.llm.common import quoted

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rendered(turn: Column) -> Column:
    """One turn as text: role line, content, end mark."""
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _tail(turns: Column, skip: Column) -> Column:
    return F.slice(turns, skip + 1, F.greatest(F.size(turns) - skip, F.lit(0)))


def _segments(turns: Column, trained_role: str) -> Column:
    """Per turn the header, which is never trained on, and the body with its end mark."""
    head = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"))
    body = lambda t: F.concat(t["text"], F.lit(END + "\n"))
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(head(t).alias("text"), F.lit(False).alias("train")),
        F.struct(body(t).alias("text"), (t["role"] == trained_role).alias("train")))))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                       trained_role: str = "assistant") -> DataFrame:
    """Adds ``prompt_turns, prompt, chosen_text, chosen_segments, rejected_text, rejected_segments``.

    ``chosen`` and ``rejected`` are arrays of ``struct<role, text>``. The prompt is their longest
    common prefix of turns, rendered once. A completion is the rest of its conversation; its
    segments join to the completion's text, and those marked ``train`` carry the loss. Null
    arrays count as empty, null roles and texts as empty text. Equal conversations leave two
    empty completions. Input columns with the new names are replaced.
    """
    plain = lambda name: F.transform(
        F.coalesce(quoted(name), F.array().cast("array<struct<role:string,text:string>>")),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"),
                           F.coalesce(t["text"], F.lit("")).alias("text")))
    both = pairs.withColumns({"__chosen": plain(chosen), "__rejected": plain(rejected)})
    least = F.least(F.size("__chosen"), F.size("__rejected"))
    places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.element_at("__chosen", i) != F.element_at("__rejected", i))
    counted = both.withColumn("prompt_turns", F.coalesce(F.array_min(differ) - 1, least))
    return counted.withColumns({
        "prompt": _text(F.slice("__chosen", F.lit(1), F.col("prompt_turns"))),
        "__c": _tail(F.col("__chosen"), F.col("prompt_turns")),
        "__r": _tail(F.col("__rejected"), F.col("prompt_turns")),
    }).withColumns({
        "chosen_text": _text(F.col("__c")), "chosen_segments": _segments(F.col("__c"), trained_role),
        "rejected_text": _text(F.col("__r")), "rejected_segments": _segments(F.col("__r"), trained_role),
    }).drop("__chosen", "__rejected", "__c", "__r")


def reply_swaps(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", reply_role: str = "assistant") -> DataFrame:
    """``(conv, chosen, rejected)``: each conversation against itself with another's last reply.

    Conversations with ids 2k and 2k+1 lend each other their last reply; without one to borrow
    the rejected side ends before the last reply; a conversation without a reply stands against
    itself. Turns go by number, then role and text, nulls first; repeated turns are turns; turns
    without an id are one conversation, which nothing is lent to. Last replies are found before any
    shuffle of turns, so of a couple each conversation's own turns are gathered, once: a
    conversation is one training example and one row in any case.
    """
    rows = turns.select(quoted(conv).cast("bigint").alias("conv"), F.struct(
        quoted(turn).cast("bigint").alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    said = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    replies = rows.filter(F.col("t.role") == reply_role).groupBy(F.col("conv").bitwiseXOR(F.lit(1)).alias("to")).agg(
        F.max("t").alias("reply")).select("to", said(F.col("reply")).alias("borrowed"))
    own = rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), said).alias("chosen"))
    sided = own.join(replies, F.col("conv") == F.col("to"), "left")
    last = F.size("chosen") - F.array_position(F.reverse(F.transform(
        "chosen", lambda t: t["role"] == reply_role)), True).cast("int") + 1
    placed = sided.withColumn("at", F.when(F.exists("chosen", lambda t: t["role"] == reply_role), last))
    before = F.slice("chosen", F.lit(1), F.col("at") - 1)
    after = _tail(F.col("chosen"), F.col("at"))
    rejected = F.when(F.col("at").isNull(), F.col("chosen")).when(
        F.col("borrowed").isNull(), before).otherwise(F.concat(before, F.array("borrowed"), after))
    return placed.select(F.col("conv").alias(conv), "chosen", rejected.alias("rejected"))
