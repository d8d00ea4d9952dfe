"""Grounding of responses against a table of sources, without gathering any source list.

A response's claims become one row per distinct claim word; the sources become one row per
distinct (key, word). Both meet in one equi-join, so a key with a huge source list is spread
by word, and its repeated words are folded before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.config import GuardConfig
from parapet.functions.grounding import (
    claim_words,
    claims,
    grounding_result,
    is_supported,
)
from parapet.functions.text import tokens
from parapet.operators.guards import find, guard_of_findings
from parapet.operators.rows import unfold

# Words that stand for "this key has sources at all"; real ones start with no blank. A response meets
# one of them, by its own hash, so that what it carries is spread also where all share one key.
_PRESENCES = 64


def _presence(number: Column) -> Column:
    return F.concat(F.lit(" "), number.cast("string"))


_CLAIMS = "array<struct<claim:string,words:array<string>>>"


def _claim_words(
    responses: DataFrame, ids: list[str], keep: list[str], carry: list[str], text: str
) -> DataFrame:
    """One row per response, claim and claim word, plus a presence row per response.

    A claim whose words are all stop words still yields one row, with a null word. The presence
    row alone holds the carried columns, and of a claim's rows the first alone holds its text.
    """
    found = F.transform(
        claims(F.col(text)), lambda c: F.struct(c.alias("claim"), claim_words(c).alias("words"))
    )
    marker = F.when(
        F.col(text).isNotNull(), _presence(F.pmod(F.xxhash64(*ids), F.lit(_PRESENCES)))
    )
    presence = F.struct(F.lit(None).cast("string").alias("claim"), F.array(marker).alias("words"))
    listed = F.concat(F.array(presence), F.coalesce(found, F.array().cast(_CLAIMS)))
    payload = F.struct(*carry) if carry else F.lit(None).cast("struct<>")
    per_claim = unfold(responses, [*ids, *keep, payload.alias("_row")], listed, "_c", "_claim_no")
    per_word = per_claim.select(
        *ids, *keep, "_claim_no",
        F.when(F.col("_claim_no") == 0, F.col("_row")).alias("_row"),
        F.col("_c.claim").alias("_claim"),
        F.posexplode_outer("_c.words").alias("_word_no", "_word"),
    )
    first_word = F.coalesce(F.col("_word_no"), F.lit(0)) == 0
    return per_word.withColumn("_claim", F.when(first_word, F.col("_claim"))).drop("_word_no")


def _source_words(sources: DataFrame, key: list[str], text: str, first: str | None) -> DataFrame:
    """Distinct (key, word) of the sources; with ``first``, the smallest ``first`` per word."""
    told = F.array_distinct(tokens(F.lower(F.col(text))))
    keep = [*key, *([F.col(first).alias("_first")] if first else [])]
    present = F.transform(F.sequence(F.lit(0), F.lit(_PRESENCES - 1)), _presence)
    words = unfold(sources, keep, F.concat(present, told), "_word", "_no")
    grouped = words.groupBy(*key, "_word")
    return grouped.agg(F.min("_first").alias("_first")) if first else grouped.agg(
        F.lit(True).alias("_first")
    )


# Buckets of the sketch that finds heavy (key, word) pairs, and the share of responses it looks at.
_SKETCH = 1 << 16
_LOOKED_AT = 8


def _salts(left: DataFrame, on: list[str], ids: list[str], share: float | None) -> DataFrame:
    """``(_bucket, _parts)``: into how many parts the rows of a sketch bucket are salted.

    Rows are counted by the hash of ``on`` in at most ``_SKETCH`` buckets, over one response in
    ``_LOOKED_AT``, chosen by its hash. A bucket of more than ``share`` of all rows (by default one part
    in as many as there are shuffle partitions) is cut into pieces of that size; the others are not
    listed. Salts only place rows, so an estimate is enough and the result never depends on it.
    """
    share = share or 1 / int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = left.filter(F.pmod(F.xxhash64(F.lit("salt"), *ids), F.lit(_LOOKED_AT)) == 0)
    counts = some.groupBy(_bucket(on).alias("_bucket")).agg(F.count("*").alias("_n"))
    every = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = F.sum("_n").over(every)  # over at most _SKETCH rows
    parts = F.ceil(F.col("_n") / (share * total)).cast("int")
    return counts.select("_bucket", parts.alias("_parts")).filter(F.col("_parts") > 1)


def _bucket(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(_SKETCH)).cast("int")


def _salted(left: DataFrame, right: DataFrame, on: list[str], ids: list[str], share: float | None):
    """Both sides with a ``_salt``: rows of heavy pairs are spread, their words repeated as often."""
    salts = F.broadcast(_salts(left, on, ids, share))  # at most 1 / share rows
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64(*ids), parts).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt")
    left = left.withColumn("_bucket", _bucket(on)).join(salts, "_bucket", "left")
    right = right.withColumn("_bucket", _bucket(on)).join(salts, "_bucket", "left")
    return (
        left.select("*", own).drop("_bucket", "_parts"),
        right.select("*", every).drop("_bucket", "_parts"),
    )


def grounding_join(
    responses: DataFrame,
    sources: DataFrame,
    ids: Sequence[str],
    key: Sequence[str] | None = None,
    response: str = "response",
    source: str = "source_text",
    before: tuple[str, str] | None = None,
    threshold: float | None = None,
    fanout: int | None = None,
    carry: Sequence[str] = (),
    share: float | None = None,
) -> DataFrame:
    """Grounding struct per response, ``(*ids, *carry, grounding)``; null without sources.

    ``ids`` identify a response; ``carry`` names other columns of it to pass on, which saves
    joining the result back. ``key`` (default ``ids``) is what sources are shared by.
    ``before=(response_column, source_column)`` counts only sources that come strictly
    earlier, as with the previous turns of a conversation: the earliest occurrence of a word
    decides, so no response is ever paired with each of its earlier turns.

    Where one key serves a large share of all responses, its frequent words are hot on the
    response side. Pairs of key and word that hold more than ``share`` of all rows are found by
    a sketch and salted, each into as many parts as it needs, so that none is larger than about that;
    the others are not (``_salts``). ``fanout`` instead salts every pair into that many parts, 1 none.
    """
    ids = list(ids)
    key = list(key) if key else ids
    threshold = GuardConfig().hallucination_threshold if threshold is None else threshold
    keep = [c for c in key if c not in ids]
    if before and before[0] not in ids + keep:
        keep.append(before[0])

    carry = list(carry)
    left = _claim_words(responses, ids, keep, carry, response)
    right = _source_words(sources, key, source, before[1] if before else None)
    on = [*key, "_word"]
    if fanout is None:
        left, right = _salted(left, right, on, ids, share)
        on.append("_salt")
    elif fanout > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(fanout)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
        on.append("_salt")
    hit = F.col("_first").isNotNull()
    if before:
        hit = hit & (F.col("_first") < F.col(before[0]))
    joined = left.join(right, on, "left").select(
        *ids, "_row", "_claim_no", "_claim", "_word", hit.alias("_hit")
    )
    carried = F.any_value("_row", F.lit(True)).alias("_row")

    # One shuffle by response serves both aggregations.
    placed = joined.repartition(*ids)
    per_claim = placed.groupBy(*ids, "_claim_no").agg(
        F.max("_claim").alias("_claim"),
        F.count("_word").alias("_n_words"),
        F.count_if("_hit").alias("_overlap"),
        carried,
    )
    is_claim = F.col("_claim_no") > 0
    ok = is_supported(F.col("_overlap"), F.col("_n_words"))
    per_response = per_claim.groupBy(*ids).agg(
        F.count_if(is_claim).alias("_total"),
        F.count_if(is_claim & ok).alias("_supported"),
        F.array_sort(
            F.collect_list(F.when(is_claim & ~ok, F.struct("_claim_no", "_claim")))
        ).alias("_open"),
        F.max(~is_claim & (F.col("_overlap") > 0)).alias("_has_sources"),
        carried,
    )
    result = grounding_result(
        F.col("_total"), F.col("_supported"), F.transform("_open", lambda c: c["_claim"]), threshold
    )
    return per_response.select(
        *ids,
        *[F.col("_row")[c].alias(c) for c in carry],
        F.when(F.col("_has_sources"), result).alias("grounding"),
    )


def guard_outputs_join(
    responses: DataFrame,
    sources: DataFrame,
    ids: Sequence[str],
    key: Sequence[str] | None = None,
    config: GuardConfig | dict | None = None,
    response: str = "response",
    source: str = "source_text",
    before: tuple[str, str] | None = None,
    fanout: int | None = None,
    out: str = "output",
) -> DataFrame:
    """Output guard of responses whose sources are a table; grounding sees the scrubbed text.

    The findings are made once and travel with each response's presence row, so the responses
    are read and scanned a single time.
    """
    cfg = GuardConfig.of(config)
    ids = list(ids)
    columns = responses.columns
    findings = ["_tox", "_entities", "_safe"]
    found = find(responses, response, cfg, query=F.lit(False)).select(*columns, *findings)
    carry = [c for c in [*columns, *findings] if c not in ids]
    found = found.withColumn("_told", F.when(~F.col("_tox.is_toxic"), F.col("_safe")))
    judged = grounding_join(
        found, sources, ids, key, "_told", source, before,
        cfg.hallucination_threshold, fanout, carry,
    )
    guarded = judged.withColumn(out, guard_of_findings(F.col(response), F.col("grounding")))
    return guarded.select(*columns, out)
