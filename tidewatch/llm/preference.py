"""Preference formatting, in DataFrame functions only.

A pair of conversations, one chosen and one rejected, shares its longest common prefix of
turns (equal role and text): that is rendered once as the prompt. What follows is rendered
as two completions, each with the spans of its text (in code points, from the start of the
completion) that training may learn from: the contents of the assistant's turns.

Turns are ordered by (turn, role, text). Null roles and texts count as empty. Rows without
a pair or a turn number and pairs without one of the two sides are left out; repeated rows
are repeated turns. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = ("<|", "|>\n"), "\n<|end|>\n"
LEARNT = "assistant"


def sides(turns: DataFrame, name: str) -> DataFrame:
    """pair_id and the turns of one side in order."""
    turns = turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    return turns.groupBy("pair_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN[0]), turn["role"], F.lit(OPEN[1]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(CLOSE))), "")


def learnt_spans(turns: Column) -> Column:
    """Spans of the assistant's contents in the rendered turns, as array of (start, stop)."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.char_length(header(t))
        end = begin + F.char_length(t["text"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("stop"))
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(t["role"] == LEARNT, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From turns (pair_id, turn, role, text) of both sides: pair_id, n_common, prompt, and per side the completion and its learnt spans."""
    pairs = sides(chosen, "chosen").join(sides(rejected, "rejected"), "pair_id")
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    unequal = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: F.get("chosen", i) != F.get("rejected", i))
    pairs = pairs.withColumn("n_common", F.coalesce(F.array_min(unequal), shorter).cast("long"))
    common = F.col("n_common").cast("int")
    out = [F.col("pair_id"), F.col("n_common"), rendered(F.slice("chosen", F.lit(1), common)).alias("prompt")]
    for side in ("chosen", "rejected"):
        rest = F.slice(side, common + 1, F.size(side))
        out += [rendered(rest).alias(f"{side}_completion"), learnt_spans(rest).alias(f"{side}_spans")]
    return pairs.select(*out)
