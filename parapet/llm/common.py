"""Intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors cost nothing."""
    path = shared_folder(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` as a table in the warehouse, filed by ``column``: joins on it need no shuffle."""
    spark, table_name = df.sparkSession, f"llm_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(files, column).sortBy(column).saveAsTable(table_name)
    return spark.table(table_name)


#: Sides of joins up to this many bytes are broadcast; larger ones are shuffled.
SMALL_BYTES = 16 << 20


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, to be broadcast if its rows of at most ``row_bytes`` fit into ``SMALL_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in smaller ones, so that a task holds few texts as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable.

    Alternating large and small stars: each node's larger neighbours move to its smallest one,
    then its smaller neighbours do, until all links are stars. Every step is an aggregate and a
    join on the node, so a node of very many links is folded before the shuffle in the one and
    split by adaptive execution in the other. Each round is written to the shared folder.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges, state = keep(edges, "edges"), None
    while state != (state := _state(edges)):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a smallest node keeps its links as (larger, itself): they are among the rows above
        large = keep(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        edges = keep(small.where("a <> b").distinct(), "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )
