"""Array elements as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(
    df: DataFrame, keep: Sequence[str | Column], items: Column, item: str, position: str
) -> DataFrame:
    """One row per element: ``(*keep, position, item)``; rows without elements are left out.

    A plain ``explode`` makes Spark infer a filter on the array's size and push it below the
    projection, which evaluates a computed array twice. Exploding with the outer form and
    dropping the empty row afterwards evaluates it once. Elements must not be null.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return rows.filter(F.col(item).isNotNull())
