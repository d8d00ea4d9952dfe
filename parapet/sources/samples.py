"""Instruction samples as JSON lines, in and out, and the other sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_FIELDS = ("instruction", "input", "output", "source")
SAMPLE_SCHEMA = ", ".join(f"{field} string" for field in SAMPLE_FIELDS)
_STEPS_PER_BLOCK = 65_536
HISTORY_COLUMNS = ("run_id", "epoch", "loss", "time_s", "throughput")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines samples. A malformed line, or one without instruction or output, fails.

    ``input`` and ``source`` may be missing. Blank lines are no samples.
    """
    rows = spark.read.schema(SAMPLE_SCHEMA).option("mode", "FAILFAST").json(path)
    needed = {
        field: F.coalesce(field, F.raise_error(F.lit(f"a sample has no {field}")).cast("string"))
        for field in ("instruction", "output")
    }
    return rows.withColumns(needed)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run metrics as :func:`write_history` leaves them."""
    schema = "run_id string, epoch bigint, loss double, time_s double, throughput double"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_samples(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """Instruction pairs as JSON lines, keys in the order of the schema, a folder of parts."""
    pairs.select(*SAMPLE_FIELDS).write.mode(mode).option("ignoreNullFields", False).json(path)


def dataset_size(samples: DataFrame) -> DataFrame:
    """Number of samples, as one row ``n_samples``."""
    return samples.agg(F.count("*").alias("n_samples"))


def write_history(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Run metrics as JSON lines."""
    metrics.select(*HISTORY_COLUMNS).write.mode(mode).json(path)


def write_epoch_plan(plan: DataFrame, path: str, mode: str = "error") -> None:
    """An epoch plan as parquet, one folder per rank, files ordered by step.

    A task takes whole blocks of consecutive steps of a rank, so ranks have few files each, and a
    rank is written by as many tasks as it has blocks. Placing blocks by hash needs no sampling
    pass over the plan.
    """
    (
        plan.repartition("rank", F.floor(F.col("step") / _STEPS_PER_BLOCK))
        .sortWithinPartitions("rank", "step")
        .write.mode(mode)
        .partitionBy("rank")
        .parquet(path)
    )
