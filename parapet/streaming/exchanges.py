"""Exchanges, sessions and grounding on message streams: what needs state or a large table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parapet.config import GuardConfig
from parapet.operators.exchanges import guarded_exchanges
from parapet.operators.grounding import guard_outputs_join
from parapet.session import shared_folder
from parapet.sources.messages import ends_session, stripped


def pair_stream(
    messages: DataFrame, at: str = "ts", delay: str = "1 hour", patience: str = "10 minutes"
) -> DataFrame:
    """Each user message with the assistant message at the next turn: ``conv_id, turn, query,
    response`` and the time ``at`` of the query.

    A message may arrive up to ``delay`` after later ones, answers before their queries too; one that
    comes later still is dropped by the watermark. A query waits for an answer that is at most
    ``patience`` younger and then comes out once, without one if there was none in time. Turns of a
    conversation are numbered without gaps. State is kept by (conversation, turn), so that a long
    conversation is spread, and goes when the watermark has passed.
    """
    queries = (
        messages.filter(F.col("role") == "user")
        .select("conv_id", "turn", F.col("text").alias("query"), F.col(at).alias("_asked"))
        .withWatermark("_asked", delay)
    )
    answers = (
        messages.filter(F.col("role") == "assistant")
        .select(
            F.col("conv_id").alias("_conv"), (F.col("turn") - 1).alias("_turn"),
            F.col("text").alias("response"), F.col(at).alias("_answered"),
        )
        .withWatermark("_answered", delay)
    )
    in_time = F.expr(f"_answered >= _asked and _answered <= _asked + interval {patience}")
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn"))
    paired = queries.join(answers, same & in_time, "leftOuter")
    return paired.select("conv_id", "turn", "query", "response", F.col("_asked").alias(at))


def exchange_stream(
    messages: DataFrame,
    config: GuardConfig | dict | None = None,
    at: str = "ts",
    delay: str = "1 hour",
    patience: str = "10 minutes",
) -> DataFrame:
    """Guarded exchanges of a message stream: ``input`` and ``output`` guard results per query.

    The answer to a blocked query is withheld, and a query without an answer in time has none:
    ``output`` is null for both, as in ``guarded_exchanges``.
    """
    return guarded_exchanges(pair_stream(messages, at, delay, patience), config)


def session_stream(
    messages: DataFrame,
    at: str = "ts",
    delay: str = "1 hour",
    session: str = "1 day",
) -> DataFrame:
    """The stream of ``until_exit``: messages before the first turn that ends their session.

    A message comes out when the watermark has passed it, as an earlier turn may still arrive up to
    ``delay`` late and end the session. An end is remembered for ``session``; messages of the
    same conversation that are that much younger are let through again.
    """
    ready = stripped(messages)
    ends = (
        ready.filter(ends_session(F.col("role"), F.col("text")))
        .select(
            F.col("conv_id").alias("_conv"), F.col("turn").alias("_last"), F.col(at).alias("_ended")
        )
        .withWatermark("_ended", delay)
    )
    sent = ready.withWatermark(at, delay)
    over = F.expr(f"_conv = conv_id and _last <= turn and _ended <= {at} and _ended >= {at} - interval {session}")
    return sent.join(ends, over, "leftOuter").filter("_last is null").select(*messages.columns)


def write_stream(
    rows: DataFrame, path: str, name: str, available_now: bool = False
) -> StreamingQuery:
    """Append a stream's rows to a parquet folder, exactly once; its checkpoint is shared."""
    writer = (
        rows.writeStream.format("parquet").queryName(name).outputMode("append")
        .option("checkpointLocation", shared_folder(rows.sparkSession, f"stream-{name}"))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


# --- grounding against a table -------------------------------------------------------------
_BATCH = "batch"


def grounded_batch(
    batch: DataFrame,
    batch_id: int,
    sources: DataFrame,
    path: str,
    ids: Sequence[str],
    key: Sequence[str] | None = None,
    config: GuardConfig | dict | None = None,
    before: tuple[str, str] | None = None,
) -> None:
    """Guard one micro-batch of responses against the source table and store it under its number.

    A batch that runs again replaces its own folder, so it adds no row twice.
    """
    guarded = guard_outputs_join(batch, sources, ids, key, config, before=before)
    guarded.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")


def write_grounded(
    responses: DataFrame,
    sources: DataFrame,
    path: str,
    name: str,
    ids: Sequence[str],
    key: Sequence[str] | None = None,
    config: GuardConfig | dict | None = None,
    before: tuple[str, str] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Guard a stream of responses against a table of sources of any size, batch by batch.

    Each micro-batch is joined as ``guard_outputs_join`` joins a table: by word, with no source list
    in a row. ``sources`` is read anew for every batch. Read the result with ``read_grounded``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        grounded_batch(batch, batch_id, sources, path, ids, key, config, before)

    writer = (
        responses.writeStream.foreachBatch(run).queryName(name)
        .option("checkpointLocation", shared_folder(responses.sparkSession, f"stream-{name}"))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_grounded(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_grounded`` has stored, without the batch numbers."""
    return spark.read.option("basePath", path).parquet(path).drop(_BATCH)
