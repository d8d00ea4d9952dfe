"""Documents to chunks to instruction pairs. All narrow: one scan, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.documents import clean_text, pairs_of_chunk, topic, word_chunks
from parapet.functions.text import tokens
from parapet.operators.rows import unfold


def chunk_documents(
    docs: DataFrame,
    key: Sequence[str] = ("path", "source"),
    text: str = "text",
    chunk_size: int = lexicon.CHUNK_WORDS,
    overlap: int = lexicon.CHUNK_OVERLAP,
) -> DataFrame:
    """Cleaned, overlapping word chunks: ``(*key, chunk_no, chunk, n_words)``.

    ``chunk_no`` counts from 0 within a document.
    """
    words = docs.select(*key, tokens(clean_text(F.col(text))).alias("_words"))
    windows = word_chunks(F.col("_words"), chunk_size, overlap)
    return unfold(words, key, windows, "_c", "chunk_no").select(
        *key, "chunk_no", "_c.chunk", "_c.n_words"
    )


def instruction_pairs(chunks: DataFrame, key: Sequence[str] = ("path", "source")) -> DataFrame:
    """One or two instruction pairs per chunk.

    Result: ``(*key, chunk_no, pair_no, instruction, input, output)``; the first columns identify
    a sample and give its place in the document order.
    """
    about = chunks.withColumn("_topic", topic(F.col("chunk")))
    pairs = pairs_of_chunk(F.col("chunk"), F.col("_topic"), F.col("n_words"))
    return unfold(about, [*key, "chunk_no"], pairs, "_p", "pair_no").select(
        *key, "chunk_no", "pair_no", "_p.instruction", "_p.input", "_p.output"
    )


def corpus_summary(
    docs: DataFrame,
    text: str = "text",
    chunk_size: int = lexicon.CHUNK_WORDS,
    overlap: int = lexicon.CHUNK_OVERLAP,
) -> DataFrame:
    """Files read, chunks kept and pairs made, from word counts alone.

    Chunk lengths follow from the number of words, so no chunk text is built; each document
    adds three numbers to one partial sum per task.
    """
    n = docs.select(F.size(tokens(clean_text(F.col(text)))).alias("n"))
    step = chunk_size - overlap
    if step <= 0:
        raise ValueError("chunk_size must be greater than overlap")

    def longer_than(limit: int):
        """Number of windows of more than ``limit`` words among starts 0, step, 2*step, ..."""
        if chunk_size <= limit:
            return F.lit(0)
        rest = F.col("n") - 1 - limit
        return F.when(rest >= 0, F.floor(rest / step) + 1).otherwise(F.lit(0))

    kept = longer_than(lexicon.CHUNK_MIN_WORDS)
    summarised = longer_than(lexicon.SUMMARY_MIN_WORDS)
    return n.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum(kept), F.lit(0)).cast("bigint").alias("n_chunks"),
        F.coalesce(F.sum(kept + summarised), F.lit(0)).cast("bigint").alias("n_pairs"),
    )
