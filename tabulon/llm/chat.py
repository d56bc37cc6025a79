"""Preference formatting: a shared prompt and two masked completions for each pair.

A pair's conversations are compared turn by turn; their longest common prefix of turns is rendered
once as the prompt, the rest of either as a completion. Every turn stays a row of its own, with its
rendered text, its place and the spans to train on, so that a conversation of any length needs no
single row; ``assembled`` joins them into a row for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|{role}|>\n", "<|end|>\n")


def head_of(role: Column) -> Column:
    before, after = TEMPLATE[0].split("{role}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(after))


def formatted(pairs: DataFrame) -> DataFrame:
    """Rows of *pairs* (pair_id, side 'chosen' or 'rejected', turn, role, text) as rendered segments.

    pair_id, part ('prompt', 'chosen', 'rejected'), turn, nth, rendered, train (whether the span counts for
    the loss), train_from, train_to (code points in *rendered*). Turns compare by number, role and text,
    nulls equal nulls and a null number comes first; a null text renders empty. Repeated rows count once;
    different rows of one turn all stay, in the order of role and text (nth, from 1). Only an assistant's
    text and end mark in a completion are trained on. A pair with one side only has no prompt; rows with
    a null pair_id are one pair. Extra columns are ignored, an empty table gives an empty one. The prefix is
    an aggregate by pair, so one long conversation does not gather in a task.
    """
    rows = pairs.where(F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "turn", "role", "text").distinct()
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text")))
    by_turn = rows.groupBy("pair_id", "turn", "nth").agg(*[F.max(F.when(F.col("side") == s, F.struct(F.lit(True).alias("there"), "role", "text"))).alias(s) for s in ("chosen", "rejected")])
    differs = by_turn.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min(F.struct("turn", "nth")).alias("first"))
    differs = differs.select(F.col("pair_id").alias("differing"), "first")
    marked = rows.join(differs, F.col("pair_id").eqNullSafe(F.col("differing")), "left").drop("differing")
    prompt = F.col("first").isNull() | (F.struct("turn", "nth") < F.col("first"))
    kept = marked.where(~prompt | (F.col("side") == "chosen"))  # the prompt once
    text, head = F.coalesce("text", F.lit("")), head_of(F.col("role"))
    train = ~prompt & F.coalesce(F.col("role") == "assistant", F.lit(False))
    rendered = F.concat(head, text, F.lit(TEMPLATE[1]))
    return kept.select(
        "pair_id",
        F.when(prompt, "prompt").otherwise(F.col("side")).alias("part"),
        "turn",
        "nth",
        rendered.alias("rendered"),
        train.alias("train"),
        F.when(train, F.char_length(head)).cast("long").alias("train_from"),
        F.when(train, F.char_length(rendered)).cast("long").alias("train_to"),
    )


def assembled(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, and for either completion its trained spans (code points in it).

    A row for every pair of *segments*, which must fit a row; the segments themselves have no such bound.
    A part without segments is empty and has no spans.
    """
    by = ("turn", "nth")
    line = Window.partitionBy("pair_id", "part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("rendered").cast("long")).over(line), F.lit(0))
    parts = segments.withColumn("at", at).groupBy("pair_id", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, "rendered"))), lambda x: x["rendered"]), "").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("train"), F.struct((F.col("at") + F.col("train_from")).alias("start"), (F.col("at") + F.col("train_to")).alias("end"))))).alias("spans"),
    )
    pick = lambda part, what: F.max(F.when(F.col("part") == part, F.col(what)))
    text = [F.coalesce(pick(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")]
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return parts.groupBy("pair_id").agg(*text, *[F.coalesce(pick(p, "spans"), none).alias(f"{p}_spans") for p in ("chosen", "rejected")])


def worsened(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: rejected has the words of its last assistant turn in reverse.

    The turns after that one are kept. Words are parted by single spaces. Without a numbered assistant turn
    both sides are the same.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = rows.where("role = 'assistant'").groupBy(F.col("pair_id").alias("of")).agg(F.max("turn").alias("last"))
    backwards = F.array_join(F.reverse(F.split("text", " ", -1)), " ")
    bad = rows.join(last, F.col("pair_id").eqNullSafe(F.col("of")), "left").withColumn("text", F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), backwards).otherwise(F.col("text"))).drop("of", "last")
    return rows.withColumn("side", F.lit("chosen")).unionByName(bad.withColumn("side", F.lit("rejected")))
