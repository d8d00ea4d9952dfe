"""End-to-end jobs over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.operators.documents import chunk_documents, instruction_pairs
from parapet.operators.sequences import format_prompts, shape_sequences
from parapet.sources.documents import read_documents
from parapet.sources.samples import read_samples, write_samples


def documents_to_pairs(
    docs: DataFrame,
    chunk_size: int = lexicon.CHUNK_WORDS,
    overlap: int = lexicon.CHUNK_OVERLAP,
) -> DataFrame:
    """Instruction pairs of ``(path, source, text)`` documents, with their place in the corpus."""
    return instruction_pairs(chunk_documents(docs, chunk_size=chunk_size, overlap=overlap))


def prepare_corpus(
    spark: SparkSession, input_dir: str, output_dir: str, chunk_size: int = lexicon.CHUNK_WORDS
) -> None:
    """Document files to instruction samples in JSON lines: one scan, no shuffle."""
    write_samples(documents_to_pairs(read_documents(spark, input_dir), chunk_size), output_dir)


def training_sequences(
    spark: SparkSession, samples_dir: str, tokenizer, max_length: int = lexicon.MAX_LENGTH,
    pad_id: int = 0,
) -> DataFrame:
    """JSON-lines samples to fixed-length sequences with a caller's tokenizer (a pandas UDF)."""
    prompts = format_prompts(read_samples(spark, samples_dir)).select("source", F.col("prompt"))
    return shape_sequences(prompts, max_length, pad_id, tokenizer=tokenizer)
