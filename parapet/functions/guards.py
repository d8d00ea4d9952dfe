"""Guard results as Column expressions.

``input_result`` and ``output_result`` only combine findings that are already known; the
operators compute each finding once as a column. ``input_guard`` and ``output_guard`` are the
one-expression forms for ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.config import GuardConfig
from parapet.functions.grounding import grounding
from parapet.functions.pii import mask_entities, pii_entities
from parapet.functions.text import fold_case, let, quoted_list, two_decimals
from parapet.functions.toxicity import (
    injection_match,
    toxicity_counts,
    toxicity_result,
    toxicity_suspected,
)

CHECK = "struct<name:string,status:string,details:string>"
GUARD = f"struct<blocked:boolean,text:string,reason:string,checks:array<{CHECK}>>"


def _check(name: str, status: str | Column, details: Column | str = "") -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(name).alias("name"), lift(status).alias("status"), lift(details).alias("details")
    )


def _result(blocked: bool, text: Column, reason: Column, checks: Column) -> Column:
    return F.struct(
        F.lit(blocked).alias("blocked"),
        text.alias("text"),
        reason.alias("reason"),
        checks.alias("checks"),
    ).cast(GUARD)


def _pii_check(name: str, status: str, details: str, entities: Column) -> Column:
    found = F.size(entities) > 0
    types = F.transform(entities, lambda e: e["type"])
    return _check(
        name,
        F.when(found, F.lit(status)).otherwise(F.lit("pass")),
        F.when(found, F.concat(F.lit(details), quoted_list(types))).otherwise(F.lit("")),
    )


def input_result(
    text: Column, phrase: Column, tox: Column, entities: Column, safe: Column
) -> Column:
    """Input guard result; the first blocking check wins and is then the only one listed.

    A blocked result carries the query as it came in, so it may hold raw personal data.
    """
    categories = F.transform(tox["flagged_categories"], lambda f: f["category"])
    injected = _result(
        True, text,
        F.concat(*_around(lexicon.INJECTION_REASON, phrase)),
        F.array(_check("injection", "blocked", phrase)),
    )
    toxic = _result(
        True, text,
        F.concat(F.lit(lexicon.TOXIC_INPUT_REASON), quoted_list(categories)),
        F.array(_check("toxicity", "blocked")),
    )
    clean = _result(
        False, safe, F.lit(""),
        F.array(
            _check("injection", "pass"),
            _check("toxicity", "pass"),
            _pii_check("pii_input", "masked", lexicon.MASKED_DETAILS, entities),
        ),
    )
    return (
        F.when(text.isNull(), F.lit(None))
        .when(phrase.isNotNull(), injected)
        .when(tox["is_toxic"], toxic)
        .otherwise(clean)
    )


def _around(template: str, value: Column) -> list[Column]:
    before, after = template.split("{}")
    return [F.lit(before), value, F.lit(after)]


def output_result(
    text: Column, tox: Column, entities: Column, safe: Column, ground: Column
) -> Column:
    """Output guard result; ``ground`` is null where there are no sources to check against."""
    score = two_decimals(ground["score"])
    verified = (
        F.when(
            ground["flagged"],
            _check(
                "hallucination", "warning",
                F.concat(
                    F.lit("Score: "), score, F.lit(", unsupported: "),
                    F.size(ground["unsupported_claims"]).cast("string"),
                ),
            ),
        )
        .when(
            ground.isNotNull(),
            _check("hallucination", "pass", F.concat(F.lit("Score: "), score)),
        )
    )
    checks = F.array(
        _check("toxicity", "pass"),
        _pii_check("pii_output", "scrubbed", lexicon.SCRUBBED_DETAILS, entities),
    )
    blocked = _result(
        True, F.lit(""), F.lit(lexicon.UNSAFE_OUTPUT_REASON),
        F.array(_check("toxicity", "blocked")),
    )
    passed = _result(
        False,
        F.when(ground["flagged"], F.concat(safe, F.lit(lexicon.UNVERIFIED_NOTE))).otherwise(safe),
        F.lit(""),
        F.when(ground.isNotNull(), F.concat(checks, F.array(verified))).otherwise(checks),
    )
    return (
        F.when(text.isNull(), F.lit(None)).when(tox["is_toxic"], blocked).otherwise(passed)
    )


def grounding_if_sources(response: Column, sources: Column, threshold: float) -> Column:
    """Grounding struct, or null where the source array is null or empty."""
    return F.when(F.size(sources) > 0, grounding(response, sources, threshold))


def input_guard(text: Column, config: GuardConfig | dict | None = None) -> Column:
    """Injection, then toxicity, then PII masking of a query: ``blocked, text, reason, checks``."""
    cfg = GuardConfig.of(config)

    def findings(folded: Column) -> Column:
        return F.struct(
            injection_match(F.lower(text), cfg.injection_patterns).alias("phrase"),
            toxicity_result(toxicity_counts(text, folded), cfg.toxicity_threshold).alias("tox"),
            pii_entities(text).alias("entities"),
        )

    return let(
        let(F.when(toxicity_suspected(text), fold_case(text)), findings),
        lambda f: input_result(
            text, f["phrase"], f["tox"], f["entities"], mask_entities(text, f["entities"])
        ),
    )


def output_guard(
    text: Column, sources: Column | None = None, config: GuardConfig | dict | None = None
) -> Column:
    """Toxicity, PII scrub, then grounding of the scrubbed response when it has sources."""
    cfg = GuardConfig.of(config)
    if sources is None:
        sources = F.lit(None).cast("array<string>")

    def findings(folded: Column) -> Column:
        return F.struct(
            toxicity_counts(text, folded).alias("counts"), pii_entities(text).alias("entities")
        )

    def judged(f: Column) -> Column:
        return let(
            mask_entities(text, f["entities"]),
            lambda safe: let(
                grounding_if_sources(safe, sources, cfg.hallucination_threshold),
                lambda ground: output_result(
                    text,
                    toxicity_result(f["counts"], cfg.toxicity_threshold),
                    f["entities"], safe, ground,
                ),
            ),
        )

    return let(let(F.when(toxicity_suspected(text), fold_case(text)), findings), judged)
