"""Chat messages from tables or streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.text import strip


def is_message(text: Column) -> Column:
    """False for an empty message and for the words that end a session, in any case."""
    return (text != "") & ~F.lower(text).isin(*lexicon.EXIT_WORDS)


def stripped(messages: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """Messages, those of users without outer whitespace."""
    asked = F.coalesce(F.col(role) == "user", F.lit(False))
    return messages.withColumn(text, F.when(asked, strip(F.col(text))).otherwise(F.col(text)))


def ends_session(role: Column, text: Column) -> Column:
    """True for a user's stripped message that ends the session; false for a null text."""
    return F.coalesce((role == "user") & ~is_message(text), F.lit(False))


def clean_messages(messages: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """User messages stripped of outer whitespace, without empty and session-ending ones.

    Messages of other roles, and null texts, stay as they are. Works on batch and streaming frames.
    """
    ready = stripped(messages, text, role)
    return ready.filter(~ends_session(F.col(role), F.col(text)))


def until_exit(
    messages: DataFrame, on: Sequence[str] = ("conv_id",), turn: str = "turn",
    text: str = "text", role: str = "role",
) -> DataFrame:
    """The messages of each session before its first turn that ends it, of all roles.

    A user's empty message or exit word ends a session. The first end of each session is folded
    before the shuffle; messages meet at most one row.
    """
    ready = stripped(messages, text, role)
    ends = (
        ready.filter(ends_session(F.col(role), F.col(text)))
        .groupBy(*on).agg(F.min(turn).alias("_last"))
    )
    open_rows = F.col("_last").isNull() | (F.col(turn) < F.col("_last"))
    return ready.join(ends, list(on), "left").filter(open_rows).select(*messages.columns)
