"""Documents of any size: read as lines, numbered by word, cut into chunks across lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.documents import clean_text, decode_text
from parapet.functions.text import tokens
from parapet.operators.rows import unfold
from parapet.sources.documents import DOCUMENT_GLOB

LINE_ORDER = ("block", "at")


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the document files below ``path``: ``(path, block, at, line)``.

    A file is read in as many tasks as it has splits, so it may be larger than a row can be. ``block``
    is where a split starts in its file, and ``at`` grows along its lines. Hidden and empty files, which
    a scan passes over, are for ``read_documents``.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", DOCUMENT_GLOB).text(path)
    )
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        decode_text(F.col("value").cast("binary")).alias("line"),
    )


def chunk_lines(
    lines: DataFrame,
    key: Sequence[str] = ("path",),
    order: Sequence[str] = LINE_ORDER,
    line: str = "line",
    chunk_size: int = lexicon.CHUNK_WORDS,
    overlap: int = lexicon.CHUNK_OVERLAP,
) -> DataFrame:
    """``(*key, chunk_no, chunk, n_words)`` of documents given as lines, as ``chunk_documents`` makes it.

    ``order`` names two columns: a block of lines, and the place within it. Words are numbered by the
    sums of the blocks before and a running sum inside the block, so no task holds a whole document.
    Each line sends the words of each chunk it has a part in; a chunk is joined from these parts.
    Marks are cleaned line by line, so a link or bold text that spans lines stays as it is.
    """
    step = chunk_size - overlap
    if step <= 0:
        raise ValueError("chunk_size must be greater than overlap")
    key, (block, at) = list(key), order
    split = lines.select(*key, block, at, tokens(clean_text(F.col(line))).alias("_words"))
    split = split.withColumn("_n", F.size("_words"))
    sizes = lines.select(*key, block, F.size(tokens(clean_text(F.col(line)))).alias("_n"))
    sizes = sizes.groupBy(*key, block).agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*key, block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*key, block).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    placed = split.withColumn("_end", F.sum("_n").over(inside)).join(shifts, [*key, block])
    placed = placed.filter("_n > 0").select(
        *key, "_words", (F.col("_shift") + F.col("_end") - F.col("_n")).alias("_s"),
        (F.col("_shift") + F.col("_end")).alias("_e"),
    )
    first = F.greatest(F.lit(0), F.floor((F.col("_s") - chunk_size) / step) + 1)
    chunks = F.sequence(first, F.floor((F.col("_e") - 1) / step))

    def part(no):
        low = F.greatest(F.col("_s"), no * step)
        high = F.least(F.col("_e"), no * step + chunk_size)
        words = F.slice("_words", (low - F.col("_s") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(no.alias("no"), low.alias("low"), words.alias("words"))

    # a step behind the last chunk a line may lie between two windows' ends and starts
    parts = F.filter(F.transform(chunks, lambda no: F.when(
        F.greatest(F.col("_s"), no * step) < F.least(F.col("_e"), no * step + chunk_size), part(no)
    )), lambda p: p.isNotNull())
    rows = unfold(placed, key, parts, "_p", "_i")
    joined = rows.groupBy(*key, F.col("_p.no").cast("int").alias("chunk_no")).agg(
        F.array_sort(F.collect_list(F.struct("_p.low", "_p.words"))).alias("_parts")
    )
    words = F.flatten(F.col("_parts.words"))
    out = joined.select(*key, "chunk_no", words.alias("_w"))
    return out.select(
        *key, "chunk_no", F.array_join("_w", " ").alias("chunk"), F.size("_w").alias("n_words")
    ).filter(F.col("n_words") > lexicon.CHUNK_MIN_WORDS)
