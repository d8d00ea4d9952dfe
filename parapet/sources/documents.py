"""Document files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.documents import decode_text
from parapet.sources.hidden import listed, staged


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


# Globs are case-sensitive, so each letter of an extension is a class of both cases.
DOCUMENT_GLOB = "*.{" + ",".join(_any_case(e) for e in lexicon.DOCUMENT_EXTENSIONS) + "}"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", DOCUMENT_GLOB)
        .load(path)
        .select("path", "content")
    )


def read_documents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Every document file below ``path`` as ``(path, source, text)``; ``source`` is its name.

    Other files are left out while listing and never opened. ``partitions`` spreads a few very
    large files over more tasks than the scan would use. No document is lost: an empty file, of
    which a scan makes no row, has an empty text, and files whose names start with ``_`` or ``.``,
    which a scan passes over, or that lie in such folders, are read from copies (``hidden.staged``).
    """
    files = _scan(spark, path)
    empty = listed(files).join(files.select("path"), "path", "left_anti")
    rows = files
    copies = staged(spark, path, lexicon.DOCUMENT_EXTENSIONS)
    if copies:
        folder, origin = copies
        number = F.element_at(F.split("path", "/"), -2).cast("bigint")
        found = _scan(spark, folder).select(number.alias("file_no"), "content")
        back = F.broadcast(origin)  # a list the driver has made
        rows = rows.unionByName(back.join(found, "file_no", "left").select("path", "content"))
    if partitions:
        rows = rows.repartition(partitions, "path")
    texts = rows.select("path", F.coalesce(decode_text(F.col("content")), F.lit("")).alias("text"))
    texts = texts.unionByName(empty.select("path", F.lit("").alias("text")))
    return texts.select("path", F.element_at(F.split("path", "/"), -1).alias("source"), "text")
