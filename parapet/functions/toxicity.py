"""Toxicity scoring and prompt-injection detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.text import any_of, fold_case, let, matches

FLAG = "struct<category:string,score:double,matches:int>"
TOXICITY = f"struct<is_toxic:boolean,score:double,flagged_categories:array<{FLAG}>>"


def toxicity_suspected(text: Column) -> Column:
    """False where no toxicity pattern can occur: one pass over the text for all of them."""
    patterns = [p for listed in lexicon.TOXICITY_PATTERNS.values() for p in listed]
    return F.concat(F.lit(" "), text).rlike(any_of(patterns))


def toxicity_counts(text: Column, folded: Column) -> Column:
    """Number of distinct patterns that match, one element per category; null for null.

    ``folded`` is ``fold_case(text)``, and null where ``toxicity_suspected`` is false.
    """
    counts = []
    for patterns in lexicon.TOXICITY_PATTERNS.values():
        hits = [matches(text, folded, p).cast("int") for p in patterns]
        total = hits[0]
        for hit in hits[1:]:
            total = total + hit
        counts.append(total)
    none = F.array(*[F.lit(0) for _ in counts])
    return F.when(folded.isNotNull(), F.array(*counts)).when(text.isNotNull(), none)


def toxicity_result(counts: Column, threshold: float = lexicon.TOXICITY_THRESHOLD) -> Column:
    """The toxicity struct for known category counts."""
    per_category = {c: F.get(counts, i) for i, c in enumerate(lexicon.TOXICITY_PATTERNS)}
    total = sum(list(per_category.values())[1:], list(per_category.values())[0])
    score = F.least(total / F.lit(lexicon.TOXICITY_FULL_SCORE), F.lit(1.0))
    toxic = score >= F.lit(float(threshold))
    for category in lexicon.ALWAYS_TOXIC:
        toxic = toxic | (per_category[category] > 0)
    flags = []
    for category, found in per_category.items():
        size = len(lexicon.TOXICITY_PATTERNS[category])
        flag = F.struct(
            F.lit(category).alias("category"),
            F.least(found / F.lit(float(size)), F.lit(1.0)).alias("score"),
            found.alias("matches"),
        )
        flags.append(
            F.when(found > 0, F.array(flag.cast(FLAG))).otherwise(
                F.array().cast(f"array<{FLAG}>")
            )
        )
    return F.when(
        counts.isNotNull(),
        F.struct(
            toxic.alias("is_toxic"),
            score.alias("score"),
            F.concat(*flags).alias("flagged_categories"),
        ),
    )


def toxicity(text: Column, threshold: float = lexicon.TOXICITY_THRESHOLD) -> Column:
    """Toxicity struct of a text: ``is_toxic``, ``score``, ``flagged_categories``."""
    folded = F.when(toxicity_suspected(text), fold_case(text))
    counts = let(folded, lambda f: toxicity_counts(text, f))
    return let(counts, lambda c: toxicity_result(c, threshold))


def injection_match(
    low: Column, phrases: Sequence[str] = lexicon.INJECTION_PHRASES
) -> Column:
    """The first phrase contained in ``low`` (a lower-cased text), as configured; else null."""
    if not phrases:
        return F.lit(None).cast("string")
    found = F.when(low.contains(phrases[0].lower()), F.lit(phrases[0]))
    for phrase in phrases[1:]:
        found = found.when(low.contains(phrase.lower()), F.lit(phrase))
    return found
