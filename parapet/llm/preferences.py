"""Preference formatting: one prompt for a chosen and a rejected conversation, two masked completions.

The prompt is the longest common prefix of turns. What follows in each conversation is rendered as
runs of characters with a flag each: answers are to be learnt, everything else is masked. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import keep

TURNS = "array<struct<role:string,text:string>>"


def gathered(messages: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation by turn number.

    Rows without a conversation are left out, exact repeats of a row count once, and turns of one
    number stand in the order of role and text, nulls first.
    """
    turn = F.struct("turn", "role", "text")
    turns = messages.where("conv_id is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_set(turn)).alias("turns")
    )
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two conversations are the same; nulls equal nulls."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _opening(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    """Turns as text, each with its role before and an end mark after it."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _body(t))), "")


def runs(turns: Column) -> Column:
    """Runs of characters of :func:`rendered`: (chars, learn), the openings apart from the texts."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.length(_opening(t)).alias("chars"), F.lit(False).alias("learn")),
        F.struct(F.length(_body(t)).alias("chars"),
                 t["role"].eqNullSafe(F.lit("assistant")).alias("learn")),
    )))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected"):
    """``pairs`` with prompt, completions and masks for columns of turns (role, text).

    Adds ``n_prompt_turns`` and ``prompt``, and replaces the two columns by structs of the completion's
    ``text`` and its ``runs``. Equal conversations leave both completions empty; one that goes on where
    the other ends leaves one empty. A null conversation counts as one without turns. Null roles are
    rendered as "unknown", null texts as empty.
    """
    empty = F.array().cast(TURNS)
    a, b = (F.coalesce(F.col(c).cast(TURNS), empty) for c in (chosen, rejected))
    held = pairs.withColumns({chosen: a, rejected: b})
    held = held.withColumn("n_prompt_turns", common_turns(F.col(chosen), F.col(rejected)))

    def completion(name: str) -> Column:
        rest = F.slice(F.col(name), F.col("n_prompt_turns") + 1, F.size(name))
        return F.struct(rendered(rest).alias("text"), runs(rest).alias("runs"))

    prompt = rendered(F.slice(F.col(chosen), F.lit(1), F.col("n_prompt_turns")))
    return held.withColumns(
        {"prompt": prompt, chosen: completion(chosen), rejected: completion(rejected)}
    )


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected) of conversations with the same first turn.

    The conversation of the smallest id is chosen over each other one, so a first turn that many
    conversations share gives a row for each of them and not for each two.
    """
    keyed = turns.where("size(turns) > 0").withColumn(
        "first", F.sha2(F.to_json(F.get("turns", F.lit(0))), 256)
    )
    # Stored, so that the join shuffles both sides anew and a first turn of very many
    # conversations can be split.
    heads = keep(keyed.groupBy("first").agg(F.min("conv_id").alias("chosen_id")), "first-turns")
    other = keyed.join(heads, "first").where("conv_id <> chosen_id")
    return other.select("chosen_id", F.col("conv_id").alias("rejected_id"),
                        F.col("turns").alias("rejected")).join(
        turns.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id"
    )


def echo_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation up to its last answer, chosen over itself with an echo as that answer.

    The rejected answer repeats the turn before it (empty where there is none). Conversations without
    an answer give no pair.
    """
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    cut = turns.withColumn("at", last).where("at is not null")
    cut = cut.withColumn("turns", F.slice("turns", F.lit(1), F.col("at") + 1))
    before = F.when(F.col("at") > 0, F.get("turns", F.col("at") - 1)["text"])
    echo = F.array(F.struct(F.lit("assistant").alias("role"),
                            F.coalesce(before, F.lit("")).alias("text")))
    return cut.select(
        F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
        F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("at")), echo).alias("rejected"),
    )


def preference_rows(messages: DataFrame) -> DataFrame:
    """Formatted sibling and echo pairs of a table of messages (conv_id, turn, role, text)."""
    turns = gathered(messages.select("conv_id", "turn", "role", "text"))
    columns = [F.col(c) for c in ("chosen_id", "rejected_id", "chosen", "rejected")]
    pairs = sibling_pairs(turns).select(F.lit("sibling").alias("kind"), *columns)
    pairs = pairs.union(echo_pairs(turns).select(F.lit("echo"), *columns))
    done = format_preferences(pairs)

    def mask(name: str) -> Column:
        listed = F.transform(f"{name}.runs", lambda r: F.concat_ws(
            ":", r["chars"].cast("string"), r["learn"].cast("int").cast("string")))
        return F.array_join(listed, ",").alias(f"{name}_mask")

    return done.select(
        "kind", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        "prompt", F.col("chosen.text").alias("chosen"), mask("chosen"),
        F.col("rejected.text").alias("rejected"), mask("rejected"),
    )
