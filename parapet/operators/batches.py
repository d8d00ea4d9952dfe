"""The batches each rank reads in an epoch: samples placed by rank and block of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet.operators.positions import hash_bucket

STEPS_PER_BLOCK = 4096
#: Blocks hold more steps where there would be more of them: each is a file of every rank.
MOST_BLOCKS = 1024


def epoch_batches(
    samples: DataFrame,
    key: Sequence[str],
    epoch: int,
    world_size: int = 1,
    batch_size: int = 4,
    steps_per_block: int = STEPS_PER_BLOCK,
) -> DataFrame:
    """Samples with the ``rank``, ``step``, ``batch_no`` and ``slot`` that ``epoch_plan`` gives them.

    Also adds ``position`` and ``block``. The samples themselves are shuffled once, by ``block``: a
    block is a run of positions, cut where buckets of the digest begin, so a row's block
    is known from the bucket counts (at most 2^16) before it moves. A block holds about
    ``steps_per_block`` steps of every rank, and more of a large epoch, so that it has ``MOST_BLOCKS``
    or fewer and files grow with it in size, not in number. The samples that fill up the last step keep the block
    they are in and repeat there.
    """
    if world_size < 1 or batch_size < 1 or steps_per_block < 1:
        raise ValueError("world_size, batch_size and steps_per_block must be positive")
    digest = F.md5(F.concat_ws(":", F.lit(str(epoch)), *[F.col(k).cast("string") for k in key]))
    hashed = samples.withColumn("_digest", digest).withColumn(
        "_bucket", hash_bucket(F.col("_digest"), 4)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    shifts = sizes.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        F.sum("_n").over(every).alias("_total"),
    )
    share = F.ceil(F.col("_total") / MOST_BLOCKS)
    size = F.greatest(F.lit(world_size * steps_per_block), share)
    block = F.floor(F.col("_shift") / size).alias("block")
    # A number keeps adaptive execution from handing the files of all blocks to a few tasks.
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hashed.join(F.broadcast(shifts), "_bucket").select("*", block).repartition(tasks, "block")
    inside = Window.partitionBy("block", "_bucket").orderBy("_digest", *key)
    first = F.col("_shift") + F.row_number().over(inside) - 1
    padded = F.ceil(F.col("_total") / world_size) * world_size
    at = F.col("position")
    return (
        placed.withColumn("_first", first)
        .withColumn("position", F.explode(F.sequence(F.col("_first"), padded - 1, F.col("_total"))))
        .withColumns({"rank": (at % world_size).cast("int"), "step": F.floor(at / world_size)})
        .withColumns({
            "batch_no": F.floor(F.col("step") / batch_size),
            "slot": (F.col("step") % batch_size).cast("int"),
        })
        .drop("_digest", "_bucket", "_shift", "_total", "_first")
    )


def write_batches(batches: DataFrame, path: str, mode: str = "error") -> None:
    """Batches as parquet, one folder per rank and block, files ordered by step; no shuffle."""
    (
        batches.sortWithinPartitions("rank", "block", "step")
        .write.mode(mode).partitionBy("rank", "block").parquet(path)
    )


def read_batches(
    spark: SparkSession, path: str, rank: int | None = None, start_step: int = 0
) -> DataFrame:
    """Stored samples of all ranks or one, from a step on, as after a restart.

    Only a rank's folders are opened, and files that end before ``start_step`` are skipped by their
    statistics. Rows of a batch are ordered by ``slot``.
    """
    rows = spark.read.option("basePath", path).parquet(path)
    if rank is not None:
        rows = rows.filter(F.col("rank") == rank)
    return rows.filter(F.col("step") >= start_step)
