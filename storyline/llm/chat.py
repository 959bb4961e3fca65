"""Preference formatting of conversations, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Marks around a turn, and what a mark's first characters in a text become.
TURN, END, BROKEN = "<|{role}|>\n", "<|end|>\n", "< |"
#: The role whose turns are learned.
LEARNED = "assistant"


def _turns(side: int) -> Column:
    return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text"))))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit(BROKEN)), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """[start, end) in characters of the rendered ``turns`` that are learned: bodies of LEARNED turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        start = (done["at"] + F.length(_head(turn))).cast("int")
        end = (start + F.length(_body(turn))).cast("int")
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == LEARNED, F.concat(done["spans"], own)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda done: done["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans)``, one row per pair.

    Both inputs hold (pair_id, turn, role, text). Turns are ordered by turn,
    then role, then text. The longest common prefix (equal role and text, null
    equal to null) is rendered once as prompt; what follows on either side is a
    completion whose spans say what is learned. Equal conversations give empty
    completions; a pair with one side has an empty prompt. Null roles and texts
    are empty; rows without a pair_id belong to no pair; empty tables give an
    empty one. One shuffle brings a pair's turns together, as its row needs.
    """
    rows = [df.where("pair_id is not null").select("pair_id", F.lit(k).alias("side"), F.col("turn").cast("long"), "role", "text") for k, df in enumerate((chosen, rejected))]
    pairs = rows[0].unionByName(rows[1]).groupBy("pair_id").agg(_turns(0).alias("c"), _turns(1).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.transform(
        F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")),
        lambda k: F.element_at("c", k)["role"].eqNullSafe(F.element_at("r", k)["role"]) & F.element_at("c", k)["text"].eqNullSafe(F.element_at("r", k)["text"]),
    )
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(least).cast("int")
    cut = pairs.withColumn("n_common", common).select(
        "pair_id", "n_common",
        F.slice("c", F.lit(1), F.col("n_common")).alias("p"),
        *(F.slice(x, F.col("n_common") + 1, F.size(x)).alias(x) for x in ("c", "r")),
    )
    return cut.select(
        "pair_id", "n_common", _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )


def _place(turn: Column, pair: Column) -> Column:
    """A number below 101 that spreads turns and ids; fixed values 37 and 61."""
    return F.pmod(turn.cast("long") % 101 * 37 + pair.cast("long") % 101 * 61, F.lit(101))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations (conv_id, turn, role, text).

    Chosen is the conversation; rejected is the same with one reply replaced by
    one of the neighbouring conversation (ids that differ in the last bit),
    which answers something else. Which reply varies with turn and id (the one
    of greatest :func:`_place`, of equal ones the latest; rows without a turn
    are none), so pairs part early and late. Without a neighbour's reply the
    replaced text is empty; without a reply of its own nothing is replaced.
    """
    own = conversations.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rank = F.struct(_place(F.col("turn"), F.col("pair_id")).alias("place"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    replies = own.where((F.col("role") == LEARNED) & F.col("turn").isNotNull()).groupBy("pair_id").agg(F.max(rank).alias("reply"))
    swapped = replies.select("pair_id", F.col("reply.turn").alias("at")).join(
        replies.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply.text").alias("other")), "pair_id", "left"
    )
    replaced = (F.col("role") == LEARNED) & (F.col("turn") == F.col("at"))
    rejected = own.join(swapped, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(replaced, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text")
    )
    return own, rejected
