"""How far the claims of a response are covered by the words of its sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.text import let, sentences, tokens

GROUNDING = (
    "struct<score:double,flagged:boolean,total_claims:int,supported_claims:int,"
    "unsupported_claims:array<string>>"
)

_FACTUAL = r"(?<![^{s}])(?:{w})(?![^{s}])".format(
    s=r"\s\x1c-\x1f", w="|".join(lexicon.FACTUAL_WORDS)
)


def claims(text: Column) -> Column:
    """Sentences longer than ten code points that hold one of the factual words."""
    return F.filter(
        sentences(text),
        lambda s: (F.length(s) > lexicon.CLAIM_MIN_CHARS)
        & F.lower(s).rlike("(?U)" + _FACTUAL),
    )


def claim_words(claim: Column) -> Column:
    """Distinct lower-case words of a claim without the stop words."""
    stop = F.array(*[F.lit(w) for w in lexicon.STOP_WORDS])
    return F.array_except(tokens(F.lower(claim)), stop)


def source_words(sources: Column) -> Column:
    """Distinct lower-case words of an array of source texts."""
    return F.array_distinct(tokens(F.lower(F.array_join(sources, " "))))


def is_supported(overlap: Column, n_words: Column) -> Column:
    """More than 35 % of the claim's words occur in the sources, or it has no words left."""
    share = overlap / F.greatest(n_words, F.lit(1))
    return (n_words == 0) | (share > F.lit(lexicon.CLAIM_SUPPORT))


def grounding_result(
    total: Column, supported: Column, unsupported: Column, threshold: float
) -> Column:
    """The grounding struct for known claim counts; no claims means fully grounded."""
    score = F.when(total > 0, supported / F.greatest(total, F.lit(1))).otherwise(F.lit(1.0))
    return F.struct(
        score.alias("score"),
        (score < F.lit(float(threshold))).alias("flagged"),
        total.cast("int").alias("total_claims"),
        supported.cast("int").alias("supported_claims"),
        unsupported.alias("unsupported_claims"),
    )


def grounding(
    response: Column, sources: Column, threshold: float = lexicon.GROUNDING_THRESHOLD
) -> Column:
    """Grounding struct of a response against an array of source texts held in the same row.

    The source word set is built once per row and first cut down to the words that occur in
    the response, so each claim is compared with a set no larger than the response.
    """

    def judge(found: Column) -> Column:
        relevant = F.array_intersect(F.flatten(found["words"]), source_words(sources))

        def verdict(known: Column) -> Column:
            open_claims = F.transform(
                F.filter(
                    found,
                    lambda c: ~is_supported(
                        F.size(F.array_intersect(c["words"], known)), F.size(c["words"])
                    ),
                ),
                lambda c: c["claim"],
            )
            return let(
                open_claims,
                lambda u: grounding_result(
                    F.size(found), F.size(found) - F.size(u), u, threshold
                ),
            )

        return let(relevant, verdict)

    with_words = F.transform(
        claims(response), lambda c: F.struct(c.alias("claim"), claim_words(c).alias("words"))
    )
    return F.when(response.isNotNull() & sources.isNotNull(), let(with_words, judge))
