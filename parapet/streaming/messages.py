"""Guards on message streams. Every guard is a stateless projection, so no state is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parapet.config import GuardConfig
from parapet.operators.guards import guard_messages
from parapet.session import shared_folder
from parapet.sources.messages import clean_messages


def read_message_stream(
    spark: SparkSession, path: str, schema: StructType | str, file_format: str = "parquet",
    glob: str | None = None, files_per_batch: int | None = None, table: str | None = None,
) -> DataFrame:
    """Message files that arrive in a folder; ``glob`` picks files by name.

    ``table`` picks one table out of a shared folder: a file or a folder of files of that name.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if table:
        # A pattern, as a stream takes no single file otherwise; the first letter is a class of its own.
        path = f"{path.rstrip('/')}/[{table[0]}]{table[1:]}"
    return reader.load(path)


def guard_stream(
    messages: DataFrame,
    config: GuardConfig | dict | None = None,
    sources: DataFrame | None = None,
    on: Sequence[str] = ("conv_id",),
) -> DataFrame:
    """Guarded messages. ``sources`` is a static table of ``(*on, sources array<string>)``.

    The stream-static join keeps messages without sources; they are not checked for grounding.
    """
    ready = clean_messages(messages)
    if sources is None:
        return guard_messages(ready, config)
    joined = ready.join(sources.select(*on, "sources"), list(on), "left")
    return guard_messages(joined, config, sources="sources")


def write_guarded(
    guarded: DataFrame,
    path: str,
    name: str,
    file_format: str = "parquet",
    available_now: bool = False,
) -> StreamingQuery:
    """Append guarded messages to a folder, exactly once.

    The checkpoint lies in the shared folder (``parapet.session.shared_folder``).
    """
    checkpoint = shared_folder(guarded.sparkSession, f"stream-{name}")
    writer = (
        guarded.writeStream.format(file_format)
        .queryName(name)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
