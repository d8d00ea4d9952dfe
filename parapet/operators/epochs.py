"""Epoch plans: a fresh order per epoch, shared out over ranks and cut into batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.operators.positions import hash_bucket, with_position


def epoch_plan(
    samples: DataFrame,
    key: Sequence[str],
    epoch: int,
    world_size: int = 1,
    batch_size: int = 4,
) -> DataFrame:
    """Add ``position``, ``rank``, ``step`` and ``batch_no`` for one epoch.

    ``key`` identifies a sample. Samples are ordered by ``md5("epoch:key")``; position ``p`` goes
    to rank ``p % world_size`` as its ``p // world_size``-th sample. First samples repeat at the
    end until every rank has the same number; a rank's last batch may be short.

    The leading digits of the digest are an even bucket, so no task ever orders all samples.
    """
    if world_size < 1 or batch_size < 1:
        raise ValueError("world_size and batch_size must be positive")
    digest = F.md5(F.concat_ws(":", F.lit(str(epoch)), *[F.col(k).cast("string") for k in key]))
    hashed = samples.withColumn("_digest", digest).withColumn(
        "_bucket", hash_bucket(F.col("_digest"), 4)
    )
    placed = with_position(
        hashed, "_bucket", ["_digest", *key], counted=hashed.select("_bucket"),
        position="_first", total="_total",
    )
    padded = F.ceil(F.col("_total") / world_size) * world_size
    at = F.col("position")
    step = F.floor(at / world_size)
    return (
        placed.withColumn(
            "position", F.explode(F.sequence(F.col("_first"), padded - 1, F.col("_total")))
        )
        .withColumns(
            {
                "rank": (at % world_size).cast("int"),
                "step": step,
                "batch_no": F.floor(step / batch_size),
            }
        )
        .drop("_digest", "_bucket", "_first", "_total")
    )
