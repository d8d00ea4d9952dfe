"""Guards over tables of messages, batch or streaming.

Every finding becomes its own column and is used more than once further up, so Catalyst keeps
the projections apart and no pattern runs twice on a row. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.config import GuardConfig
from parapet.functions import guards as G
from parapet.functions.grounding import GROUNDING
from parapet.functions.pii import mask_entities, pii_entities, pii_result
from parapet.functions.text import fold_case
from parapet.functions.toxicity import (
    injection_match,
    toxicity_counts,
    toxicity_result,
    toxicity_suspected,
)

_FINDINGS = ("_low", "_phrase", "_folded", "_counts", "_tox", "_entities", "_safe")


def find(
    df: DataFrame, text: str | Column, config: GuardConfig, query: Column | None = None
) -> DataFrame:
    """Add the findings every guard is made of.

    ``query`` limits the injection search to the rows where it holds. Toxicity and PII are
    only looked for where no earlier check already decides.
    """
    text = F.col(text) if isinstance(text, str) else text
    phrase = injection_match(F.col("_low"), config.injection_patterns)
    if query is not None:
        phrase = F.when(query, phrase)
    open_row = F.col("_phrase").isNull()
    return (
        df.withColumn("_low", F.lower(text))
        .withColumns(
            {"_phrase": phrase, "_folded": F.when(toxicity_suspected(text), fold_case(text))}
        )
        .withColumn("_counts", F.when(open_row, toxicity_counts(text, F.col("_folded"))))
        .withColumn("_tox", toxicity_result(F.col("_counts"), config.toxicity_threshold))
        .withColumn(
            "_entities", F.when(~F.col("_tox.is_toxic"), pii_entities(text, F.col("_low")))
        )
        .withColumn("_safe", mask_entities(text, F.col("_entities")))
    )


def _input(text: Column) -> Column:
    return G.input_result(
        text, F.col("_phrase"), F.col("_tox"), F.col("_entities"), F.col("_safe")
    )


def guard_of_findings(text: Column, ground: Column) -> Column:
    """Output guard result of a row that holds the findings, given its grounding."""
    return G.output_result(text, F.col("_tox"), F.col("_entities"), F.col("_safe"), ground)


def with_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add the PII struct of a text column."""
    return (
        df.withColumn("_low", F.lower(F.col(text)))
        .withColumn("_entities", pii_entities(F.col(text), F.col("_low")))
        .withColumn(out, pii_result(F.col(text), F.col("_entities")))
        .drop("_low", "_entities")
    )


def with_toxicity(
    df: DataFrame, text: str = "text", out: str = "toxicity", threshold: float | None = None
) -> DataFrame:
    """Add the toxicity struct of a text column."""
    threshold = GuardConfig().toxicity_threshold if threshold is None else threshold
    return (
        df.withColumn("_folded", F.when(toxicity_suspected(F.col(text)), fold_case(F.col(text))))
        .withColumn("_counts", toxicity_counts(F.col(text), F.col("_folded")))
        .withColumn(out, toxicity_result(F.col("_counts"), threshold))
        .drop("_folded", "_counts")
    )


def guard_inputs(
    df: DataFrame, config: GuardConfig | dict | None = None, text: str = "text", out: str = "input"
) -> DataFrame:
    """Add the input guard result of a query column."""
    cfg = GuardConfig.of(config)
    return find(df, text, cfg).withColumn(out, _input(F.col(text))).drop(*_FINDINGS)


def guard_outputs(
    df: DataFrame,
    config: GuardConfig | dict | None = None,
    text: str = "text",
    sources: str | None = None,
    ground: str | None = None,
    out: str = "output",
) -> DataFrame:
    """Add the output guard result of a response column.

    ``sources`` names an ``array<string>`` column for grounding in the row; ``ground`` names a
    grounding struct that is already known (see ``grounding_join``), null without sources.
    """
    cfg = GuardConfig.of(config)
    found = find(df, text, cfg, query=F.lit(False))
    return (
        found.withColumn("_ground", _ground(cfg, sources, ground))
        .withColumn(out, guard_of_findings(F.col(text), F.col("_ground")))
        .drop(*_FINDINGS, "_ground")
    )


def _ground(cfg: GuardConfig, sources: str | None, ground: str | None) -> Column:
    if ground is not None:
        return F.col(ground)
    if sources is None:
        return F.lit(None).cast(GROUNDING)
    return F.when(
        ~F.col("_tox.is_toxic"),
        G.grounding_if_sources(F.col("_safe"), F.col(sources), cfg.hallucination_threshold),
    )


def guard_messages(
    df: DataFrame,
    config: GuardConfig | dict | None = None,
    text: str = "text",
    role: str = "role",
    sources: str | None = None,
) -> DataFrame:
    """Add ``input`` for user messages and ``output`` for assistant messages; else both null."""
    cfg = GuardConfig.of(config)
    body, is_query = F.col(text), F.col(role) == "user"
    scanned = F.when(F.col(role).isin("user", "assistant"), body)  # other roles have no result
    found = find(df, scanned, cfg, query=is_query)
    return (
        found.withColumn("_ground", _ground(cfg, sources, None))
        .withColumn("input", F.when(is_query, _input(body)))
        .withColumn(
            "output",
            F.when(F.col(role) == "assistant", guard_of_findings(body, F.col("_ground"))),
        )
        .drop(*_FINDINGS, "_ground")
    )
