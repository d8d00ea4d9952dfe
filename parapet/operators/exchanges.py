"""Logged chat transcripts: pair each query with its answer, guard both, report the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.config import GuardConfig
from parapet.operators.guards import guard_inputs, guard_outputs
from parapet.operators.rows import unfold

# Turns of one conversation that are ordered within one task.
_SPAN = 1024


def pair_turns(transcripts: DataFrame, consecutive: bool = False) -> DataFrame:
    """Each user turn with the assistant turn right after it: ``conv_id, turn, query, response``.

    A query that is not followed by an assistant turn keeps a null response.

    The next turn is looked up inside spans of turn numbers, and the last turn of a span takes the
    first turn of the conversation's next span, so no task orders a whole conversation. Where turn
    numbers are known to be ``consecutive`` the answer is at ``turn + 1``, and both sides simply
    meet on ``(conv_id, turn)``.
    """
    said = transcripts.filter(F.col("role") == "user")
    queries = said.select("conv_id", "turn", F.col("text").alias("query"))
    if consecutive:
        answers = transcripts.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
        )
        return queries.join(answers, ["conv_id", "turn"], "left")

    spanned = transcripts.select(
        "conv_id", "turn", "role", "text", F.floor(F.col("turn") / _SPAN).alias("span")
    )
    following = F.struct("role", "text")
    following_of = lambda c: F.struct(F.col(c)["role"].alias("role"), F.col(c)["text"].alias("text"))
    in_span = Window.partitionBy("conv_id", "span").orderBy("turn")
    within = spanned.withColumn("next", F.lead(following).over(in_span))

    head = F.min(F.struct("turn", "role", "text")).alias("head")
    heads = spanned.groupBy("conv_id", "span").agg(head)
    in_conv = Window.partitionBy("conv_id").orderBy("span")
    bridges = heads.withColumn("span", F.lag("span").over(in_conv)).filter("span is not null")
    bridges = bridges.select("conv_id", "span", following_of("head").alias("head"))
    ahead = F.coalesce("next", "head")
    return (
        within.join(bridges, ["conv_id", "span"], "left")
        .filter(F.col("role") == "user")
        .select(
            "conv_id", "turn", F.col("text").alias("query"),
            F.when(ahead["role"] == "assistant", ahead["text"]).alias("response"),
        )
    )


def guarded_exchanges(
    pairs: DataFrame,
    config: GuardConfig | dict | None = None,
    sources: str | None = None,
    ground: str | None = None,
) -> DataFrame:
    """Add ``input`` and ``output`` guard results to pairs of ``query`` and ``response``.

    A blocked query gets no answer, so its ``output`` is null, as it is without a response.
    ``sources`` names an ``array<string>`` column; without it grounding is not checked.
    """
    cfg = GuardConfig.of(config)
    asked = guard_inputs(pairs, cfg, text="query", out="input")
    answered = asked.withColumn(
        "_answer", F.when(~F.col("input.blocked"), F.col("response"))
    )
    return guard_outputs(
        answered, cfg, text="_answer", sources=sources, ground=ground, out="output"
    ).drop("_answer")


def guard_report(guarded: DataFrame) -> DataFrame:
    """Checks by outcome: ``stage, name, status, n`` from ``input``/``output`` guard columns."""

    def listed(stage: str) -> Column:
        def outcome(check: Column) -> Column:
            return F.struct(
                F.lit(stage).alias("stage"),
                check["name"].alias("name"),
                check["status"].alias("status"),
            )

        none = F.array().cast("array<struct<stage:string,name:string,status:string>>")
        return F.coalesce(F.transform(F.col(f"{stage}.checks"), outcome), none)

    stages = [s for s in ("input", "output") if s in guarded.columns]
    checks = unfold(guarded, [], F.concat(*[listed(s) for s in stages]), "c", "no")
    return checks.groupBy("c.stage", "c.name", "c.status").agg(F.count("*").alias("n"))
