"""Preference pairs as training text: one prompt, two completions, masks.

A pair is a chosen and a rejected conversation. Turns stand at their turn number; the longest common
prefix is every turn before the first number at which the two differ in role or text, or at which one
has a turn that the other lacks. It is rendered once, as the prompt; what each side has from there on is
its completion, and a completion's mask covers the assistant's words in it, end marks included.

Only grouping and joins on the pair are used: the first difference is a minimum, not a scan in order.
Turns are gathered for ``TURNS`` numbers at a time; a longer conversation is continued in further rows
(``part`` 1, 2, ...), so that no group grows with a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import materialise

TURNS = 1000
TRAINED = "assistant"


def head(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))


def rendered(x: Column) -> Column:
    return F.concat(head(x), x["text"], F.lit("<|end|>\n"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column) -> Column:
    """(start, stop) of the assistant's words in the joined text, in characters."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, stop: int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        stop = state["at"] + F.length(rendered(x))
        own = F.struct((state["at"] + F.length(head(x))).alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["role"] == TRAINED, F.concat(state["spans"], F.array(own))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, nothing, add, lambda state: state["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int = TURNS) -> DataFrame:
    """(pair, part, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns) for each pair of ``chosen`` and ``rejected``.

    Null roles and texts are empty; rows without a pair or a turn number have no place and are left
    out. Equal rows count once; different rows of one turn stand in order of role and text, and the
    turn is common only if both sides have all of them. A pair that only one side has gets an empty
    completion on the other side and an empty prompt; equal conversations are all prompt, with two empty
    completions. A mask is empty where nothing is trained. Other columns are left out, whatever their names.
    """
    def side(df: DataFrame, own: bool) -> DataFrame:
        number = F.col(f"`{turn}`").cast("long")
        return df.select(F.col(f"`{pair}`").alias("pair"), number.alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.lit(own).alias("c"), F.lit(not own).alias("r")).where("pair is not null and turn is not null")

    rows = side(chosen, True).unionAll(side(rejected, False)).groupBy("pair", "turn", "role", "text").agg(F.bool_or("c").alias("c"), F.bool_or("r").alias("r"))
    # written once: a join of two tables on the pair is one that Spark can split where a pair is large
    rows = materialise(rows)
    first = materialise(rows.groupBy("pair").agg(F.min("turn").alias("low"), F.min(F.when(~(F.col("c") & F.col("r")), F.col("turn"))).alias("cut")))
    placed = rows.join(first, "pair").withColumn("common", F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    placed = placed.withColumn("part", F.floor((F.col("turn") - F.col("low")) / turns))
    gathered = placed.groupBy("pair", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "common", "c", "r"))).alias("all"))
    prompt = F.filter("all", lambda x: x["common"])
    good = F.filter("all", lambda x: ~x["common"] & x["c"])
    bad = F.filter("all", lambda x: ~x["common"] & x["r"])
    return gathered.select(F.col("pair").alias(pair), "part", joined(prompt).alias("prompt"), joined(good).alias("chosen"), joined(bad).alias("rejected"),
                           trained_spans(good).alias("chosen_mask"), trained_spans(bad).alias("rejected_mask"), F.size(prompt).alias("prompt_turns"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from plain conversations: each up to its last assistant turn, and the same with
    that reply replaced by the last reply of its neighbour (the id that differs in the lowest bit), or
    without a reply if the neighbour has none. Conversations without an assistant turn stay equal."""
    rows = conversations.where("conv_id is not null and turn is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = materialise(rows.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"))
    swap = materialise(last.join(other, "conv_id", "left").select("conv_id", F.col("last.turn").alias("end"), "reply"))
    known = rows.join(swap, "conv_id", "left").where(F.col("end").isNull() | (F.col("turn") <= F.col("end")))
    replaced = (F.col("turn") == F.col("end")) & (F.col("role") == TRAINED)
    chosen = known.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rejected = known.where(~F.coalesce(replaced, F.lit(False)) | F.col("reply").isNotNull()).select(
        F.col("conv_id").alias("pair_id"), "turn", "role", F.when(replaced, F.col("reply")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected
