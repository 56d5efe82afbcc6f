"""Preference formatting: chosen and rejected conversations with their common prompt.

The longest common prefix of turns is rendered once as the prompt, and what is
left of either conversation becomes a completion with the spans of the turns
that a model should learn (those of ``LEARNED`` roles), the rest being masked.
All of it is Spark expressions over one row a pair; turns meet by a grouping on
the conversation, which is the unit that is formatted.

Defined results: null roles are "unknown" and null texts empty; equal
conversations have empty completions; pairs without a common turn have an empty
prompt; turns with equal numbers are ordered by role and text; repeated turns
stay; rows without a conversation or turn number are left out; a turn's text may be
long; extra columns of the conversations play no part, and in ``format_pairs`` those
named like a result are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered. Fixed values of this format.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def turns(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns): each conversation as an ordered array of (role, text)."""
    cell = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where(F.col(conv).isNotNull() & F.col("turn").isNotNull())
    listed = rows.groupBy(conv).agg(F.array_sort(F.collect_list(cell)).alias("turns"))
    return listed.select(conv, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))  # the longer one's rest meets nulls
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def learned_spans(ts: Column) -> Column:
    """Spans (start, stop) in code points of the rendered turns whose text is to be learned; the closing mark is learned too."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + len(OPEN) + F.length(t["role"]) + len(MIDDLE)
        stop = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == LEARNED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(ts, start, add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with n_common, prompt, and for either side its completion and learned spans."""
    out = pairs.withColumn("n_common", common_turns(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    text = lambda ts: F.array_join(F.transform(ts, rendered), "")
    return out.withColumns(
        {
            "prompt": text(F.slice(chosen, F.lit(1), F.col("n_common"))),
            "chosen_completion": text(rest(chosen)),
            "rejected_completion": text(rest(rejected)),
            "chosen_spans": learned_spans(rest(chosen)),
            "rejected_spans": learned_spans(rest(rejected)),
        }
    )


def with_foreign_tail(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, chosen, rejected): each conversation, and its first turns followed by the later turns of conversation conv + 1 (none if there is none).

    They part after (7 * conv + 3) mod (turns + 1) turns, or later where the other conversation goes on alike."""
    ts = turns(conversations, conv)
    other = ts.select((F.col(conv) - 1).alias(conv), F.col("turns").alias("other"))
    at = F.pmod(F.col(conv) * 7 + 3, F.size("turns") + 1).cast("int")
    rest = F.slice("other", at + 1, F.greatest(F.size("other") - at, F.lit(0)))
    rejected = F.concat(F.slice("turns", F.lit(1), at), F.coalesce(rest, F.slice("turns", F.lit(1), F.lit(0))))
    return ts.join(other, conv, "left").select(conv, F.col("turns").alias("chosen"), rejected.alias("rejected"))
