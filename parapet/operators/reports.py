"""Counts over whole tables of scanned texts. One partial sum per task and kind, then a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.operators.rows import unfold


def pii_by_type(scanned: DataFrame, pii: str = "pii") -> DataFrame:
    """Entities and texts per PII type: ``type, n_entities, n_texts``."""
    types = scanned.select(
        F.transform(F.col(f"{pii}.entities"), lambda e: e["type"]).alias("types")
    )
    per_text = unfold(types, ["types"], F.array_distinct("types"), "type", "no")
    of_type = F.size(F.filter("types", lambda t: t == F.col("type")))
    return per_text.groupBy("type").agg(
        F.sum(of_type).alias("n_entities"), F.count("*").alias("n_texts")
    )


def toxicity_by_category(scored: DataFrame, toxicity: str = "toxicity") -> DataFrame:
    """Flagged texts and matched patterns per category: ``category, n_texts, n_matches``."""
    flags = unfold(scored, [], F.col(f"{toxicity}.flagged_categories"), "f", "no")
    return flags.groupBy("f.category").agg(
        F.count("*").alias("n_texts"), F.sum("f.matches").alias("n_matches")
    )
