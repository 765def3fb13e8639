"""Preference formatting: a prompt that two conversations share, and a masked completion of each.

Everything here is built-in Spark SQL; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.common import let

#: The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
TURN = "struct<role:string,text:string>"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order of ``turn``, then role and text, which settles equal numbers.

    A conversation becomes one row, as it does in the result; rows with a null conv_id are in none.
    """
    turn = F.struct(
        F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the first on are equal in role and text."""
    differ = F.zip_with(F.coalesce(a, _none()), F.coalesce(b, _none()), lambda x, y: x.eqNullSafe(y))
    return let(
        F.array_position(differ, False),
        lambda at: F.when(at > 0, at - 1).otherwise(F.least(F.size(F.coalesce(a, _none())), F.size(F.coalesce(b, _none())))).cast("int"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{TURN}>")


def _completion(turns: Column, shared: Column) -> Column:
    """(text, mask): mask has start and end, in code points, of what is learned: text and closing mark of the assistant's turns."""
    rest = F.slice(turns, shared + 1, F.greatest(F.size(turns) - shared, F.lit(0)))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return let(
        rest,
        lambda r: F.struct(
            F.array_join(F.transform(r, rendered), "").alias("text"), F.aggregate(r, start, step, lambda acc: acc["mask"]).alias("mask")
        ),
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen and rejected: array of (role, text), either may be null) with prompt and masked completions.

    The prompt is the longest common prefix of turns, rendered once; a completion is
    the rest of its conversation, learned where the assistant speaks. A side without
    a conversation has an empty completion, and then nothing is shared. Equal
    conversations have empty completions. Null roles are "unknown", null texts empty.
    """
    side = lambda name: F.coalesce(F.col(name), _none())
    paired = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    shared = F.when(paired, common_turns(side("chosen"), side("rejected"))).otherwise(F.lit(0))
    out = pairs.select(
        "pair_id",
        let(shared, lambda n: F.struct(
            n.alias("n"), F.array_join(F.transform(F.slice(side("chosen"), 1, n), rendered), "").alias("prompt"),
            _completion(side("chosen"), n).alias("chosen"), _completion(side("rejected"), n).alias("rejected"),
        )).alias("x"),
        paired.alias("paired"),
    )
    return out.select("pair_id", "paired", F.col("x.n").alias("n_shared"), "x.prompt", "x.chosen", "x.rejected")


def variant_endings(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected): conversation 2k, and the same one with a reply that isn't its own.

    The rejected side has the turns of 2k up to its last turn of the assistant, and
    in place of that the last one of conversation 2k + 1. If either of them has no such
    turn, the rejected side is conversation 2k + 1 as it is. A pair may lack a side.
    """
    turns = turns_of(conversations).withColumn("pair_id", F.shiftright("conv_id", 1))
    is_chosen = F.pmod("conv_id", F.lit(2)) == 0
    pairs = turns.groupBy("pair_id").agg(
        F.max(F.when(is_chosen, F.col("turns"))).alias("chosen"), F.max(F.when(~is_chosen, F.col("turns"))).alias("other")
    )
    last = lambda name: F.array_max(F.transform(F.col(name), lambda t, i: F.when(t["role"] == LEARNED_ROLE, i + 1)))
    found = pairs.withColumn("at", last("chosen")).withColumn("reply", F.get("other", last("other") - 1))
    changed = F.concat(F.slice("chosen", F.lit(1), F.col("at") - 1), F.array("reply"))
    rejected = F.when(F.col("at").isNotNull() & F.col("reply").isNotNull(), changed).otherwise(F.col("other"))
    return found.select("pair_id", "chosen", rejected.alias("rejected"))


def preference_digest(formatted: DataFrame) -> DataFrame:
    spans = lambda side: F.array_join(F.transform(F.col(f"{side}.mask"), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return formatted.select(
        "pair_id", "paired", F.col("n_shared").cast("bigint").alias("n_shared"), "prompt",
        F.col("chosen.text").alias("chosen"), spans("chosen").alias("chosen_mask"), F.col("rejected.text").alias("rejected"), spans("rejected").alias("rejected_mask"),
    )
