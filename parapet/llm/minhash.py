"""Near-duplicate documents by banded HyperMinHash registers, confirmed on whole shingle sets.

1. Each text's distinct word shingles are hashed; each of ``bands * rows`` buckets keeps the minimum
   of its own hash function as a compressed register: leading-zero count and mantissa bits. A bucket
   has a hash function of its own, not a share of one function's range, so short texts fill all
   buckets and their bands tell as much as those of long ones.
2. Texts with the same set (128-bit digest) are one class; only its smallest id goes on.
3. Classes that agree in all registers of a band share a bucket. Each is compared with the hub of the
   bucket (a star), never all with all; hub is the one that meets most others over all bands, as the
   source of many copies does. Pairs are kept if the Jaccard similarity estimated
   from their registers, corrected for register collisions, is not clearly below the threshold; the
   sets of the kept pairs are then compared in full.
4. Links become components. Texts in buckets that still hold more than one component, as those of
   one frequent passage do, are banded once more by longer bands of registers of their own, which
   such texts do not share, and compared by stars again.
5. Texts that then still stand in one bucket but not in one component are gathered into clusters and
   compared across components in blocks of ``BLOCK`` texts; only links leave the task. So a star
   hides a link only if its texts share none of the longer bands.

At similarity 0.8 a pair shares none of 40 bands of 6 registers with probability 5e-6, and none of
the 108 bands of 10 further registers with as much: no register serves two bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import components, if_small, keep, slices
from parapet.llm.hashing import mix, shingle_set

BANDS, ROWS, MANTISSA = 40, 6, 10
DRAWS, DRAWN = 108, 10
#: First seed of the hash functions of the longer bands: far from those of the others.
FRESH = 1 << 20
BLOCK = 256
#: Fixed value: expected share of colliding registers, times 2^mantissa, for sets of equal size.
COLLISION = 0.169919487159739093975315012348
SKETCH = "id long, n_shingles long, set_a long, set_b long, registers binary"


def registers(shingles: np.ndarray, buckets: int, start: int = 1) -> np.ndarray:
    """Per bucket, leading zeros and mantissa of the minimum of its hash function.

    Hash functions are seeded by the numbers from ``start`` on.
    """
    seed = mix(np.arange(start, start + 2 * buckets, dtype=np.uint64)).astype(np.uint32)
    salt, factor = seed[:buckets], seed[buckets:] | np.uint32(1)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(buckets, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(values), 64):  # a block stays in the processor's cache
        block = (values[i : i + 64, None] ^ salt) * factor
        np.minimum(low, block.min(axis=0), out=low)
    part, exponent = np.frexp(low.astype(np.float64) + 1)
    zeros = (33 - exponent).astype(np.uint16)
    return zeros << MANTISSA | ((2 * part - 1) * (1 << MANTISSA)).astype(np.uint16)


def _digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles, as two signed numbers."""
    a, b = (int(np.bitwise_xor.reduce(mix(found + np.uint64(s)))) for s in (3, 7))
    return a - (1 << 63), b - (1 << 63)


def _sketches(width: int, buckets: int, start: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {"n": [], "a": [], "b": [], "r": []}
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                out["n"].append(len(found))
                for key, value in zip("ab", _digest(found)):
                    out[key].append(value)
                out["r"].append(registers(found, buckets, start).tobytes() if len(found) else None)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(out[k], t) for k, t in zip("nabr", types)]
            ids = batch.column(0).cast(pa.int64())
            names = ["id", "n_shingles", "set_a", "set_b", "registers"]
            yield pa.RecordBatch.from_arrays([ids, *columns], names)

    return run


def _digested(width: int):
    """Texts with the digests of their sets, as in the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests = [_digest(shingle_set(t, width)) for t in batch.column(1).to_pylist()]
            a, b = zip(*digests) if digests else ((), ())
            columns = [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set_a", "set_b", "text"])

    return run


def _bands(picks: np.ndarray):
    """Rows (key, band, id, n) for each band, a row of ``picks``: which registers it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = len(picks)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16)
            values = values.reshape(batch.num_rows, -1).astype(np.uint64)
            keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (batch.num_rows, 1))
            for pick in picks.T:
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, pick])
            ids, sizes = (np.repeat(batch.column(i).to_numpy(), bands) for i in (0, 1))
            band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            arrays = [keys.ravel().view(np.int64), band, ids, sizes]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], ["key", "band", "id", "n"])

    return run


def long_bands() -> np.ndarray:
    """Which of its registers each of the longer bands holds."""
    return np.arange(DRAWS * DRAWN).reshape(DRAWS, DRAWN)


def _crowds(sketches: DataFrame, picks: np.ndarray) -> DataFrame:
    """(band, size, hub, hn, id, n): members of buckets with two ids or more.

    Bucket sizes are counted before any join, so a crowded bucket is folded in the map side.
    """
    banded = sketches.select("id", "n_shingles", "registers").mapInArrow(
        _bands(picks), "key long, band int, id long, n long"
    )
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = keep(banded.join(sizes, "key"), "crowd")
    score = crowd.groupBy("id").agg(F.sum("size").alias("score"))
    ranked = crowd.join(score, "id").withColumn("rank", F.struct("score", -F.col("id"), "n"))
    hubs = ranked.groupBy("key").agg(F.max("rank").alias("h"))
    hubs = hubs.select("key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hn"))
    return crowd.join(hubs, "key").select("band", "size", "hub", "hn", "id", "n")


def _stars(crowd: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member and its hub whose sizes let them reach the threshold."""
    fit = F.expr(f"id <> hub and 100 * least(n, hn) >= {percent} * greatest(n, hn)")
    return crowd.where(fit).select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))


def _mixed(crowd: DataFrame, same: DataFrame) -> DataFrame:
    """(hub, id, n, c): members of buckets of several components, and their component ``c``.

    Buckets of two have been compared in full by their star. A hub has one bucket a band, so the
    buckets in which it meets a member are a set of bits, and those of several components another:
    a member is one row however many buckets it shares with the hub (one for each 64 bands).
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("band") % 64)
    met = crowd.where("size > 2").groupBy("hub", "id", F.floor(F.col("band") / 64).alias("part"))
    met = met.agg(F.min("n").alias("n"), F.bit_or(bit).alias("bits"))
    placed = met.join(same.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = placed.withColumn("c", F.coalesce("component", "id")).drop("component")
    placed = keep(placed, "placed")
    own = placed.where("id = hub").select("hub", "part", F.col("c").alias("own"))
    apart = placed.join(own, ["hub", "part"]).where("c <> own")
    apart = apart.groupBy("hub", "part").agg(F.bit_or("bits").alias("apart"))
    mixed = placed.join(apart, ["hub", "part"]).where(F.col("bits").bitwiseAND(F.col("apart")) != 0)
    return keep(mixed.select("hub", "id", "n", "c").distinct(), "mixed")


def _across(width: int, percent: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "id"], ignore_index=True)
        comp, n, ids = (frame[c].to_numpy() for c in ("c", "n", "id"))
        registers_of = np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(len(frame), -1)
        floor, sets, out = _floor(percent, registers_of.shape[1]), {}, []
        first = np.flatnonzero(frame["block"].to_numpy() == key[1])
        start = 0 if key[1] == key[2] else len(first)  # the other block's rows follow
        for i in first:
            later = np.arange(max(start, i + 1), len(frame))
            fit = 100 * np.minimum(n[i], n[later]) >= percent * np.maximum(n[i], n[later])
            later = later[fit & (comp[i] != comp[later])]
            alike = (registers_of[later] == registers_of[i]).mean(axis=1)
            for j in later[alike >= floor]:  # chance agreement only adds to ``alike``
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingle_set(frame["text"].iloc[k], width)
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _rest(mixed: DataFrame, side: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components of one cluster of ``mixed`` buckets."""
    cluster = components(mixed.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    rows = mixed.select("id", "c", "n").distinct().join(
        cluster.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"
    )
    blocks = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.join(side.select("id", "registers"), "id").join(texts, "id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tasks = rows.select("*", other).withColumns(
        {"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}
    )
    found = tasks.select("cluster", "lo", "hi", "id", "c", "n", "block", "registers", "text")
    return found.groupBy("cluster", "lo", "hi").applyInPandas(
        _across(width, percent), "a long, b long"
    )


def _floor(percent: int, buckets: int) -> float:
    """An estimate below this is no sign of a pair at the threshold: 4.5 standard errors."""
    t = percent / 100
    return t - 4.5 * (t * (1 - t) / buckets) ** 0.5


def estimate(a: bytes, b: bytes, n: int, m: int) -> float:
    """Jaccard similarity from two register lists, less the share that agrees by chance."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    ratio = max(n, m) / min(n, m)
    chance = COLLISION * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return max(0.0, ((x == y).mean() - chance) / (1 - chance))


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_pylist() for i in range(2, 6))
            floor = _floor(percent, len(a[0]) // 2) if a else 0
            hit = [estimate(*x) >= floor for x in zip(a, b, n, m)]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return run


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in slices(batches):
            hit = []
            for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if last[0] != a:  # one star's rows stand together
                    last = (a, shingle_set(x, width))
                other = shingle_set(y, width)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                hit.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return run


def _links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int):
    """The pairs (a, b) whose sets reach the threshold."""
    side = sketches.select("id", "registers", "n_shingles")
    near = (
        pairs.join(side.toDF("a", "ra", "na"), "a").join(side.toDF("b", "rb", "nb"), "b")
        .select("a", "b", "ra", "rb", "na", "nb")
        .mapInArrow(_likely(percent), "a long, b long")
    )
    near = keep(near, "near")
    full = (
        near.join(texts.toDF("b", "tb"), "b")
        .join(texts.toDF("a", "ta").join(near.select("a").distinct(), "a", "left_semi"), "a")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_confirmed(width, percent), "a long, b long")
    )
    return keep(full, "links")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are runs of non-white-space with A-Z in lower case; texts of fewer than ``width`` words
    have the whole sequence as their one shingle. Texts are linked if their shingle sets have a
    Jaccard similarity of ``percent`` or more. Null, empty and blank texts have no shingles and link
    with nothing. ``id_col`` is an integer; rows that repeat an id are one document if their sets
    agree, else linked by it; rows without an id come out without a component, kept. Other columns
    of ``docs`` are not read.
    """
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = keep(rows_in.mapInArrow(_sketches(width, bands * rows), SKETCH), "sketches")
    known = sketches.where("n_shingles > 0 and id is not null")
    # A class goes by a number of its own, as rows of different sets may share their smallest id.
    classes = known.groupBy("set_a", "set_b").agg(F.min("id").alias("first"))
    classes = keep(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    member = known.select("id", "set_a", "set_b").join(classes, ["set_a", "set_b"])
    member = keep(member.select("id", "first").distinct(), "members")

    named = classes.withColumnRenamed("first", "id")
    first = known.join(named, ["id", "set_a", "set_b"])
    first = first.select(F.col("no").alias("id"), "n_shingles", "registers").dropDuplicates(["id"])
    crowd = keep(_crowds(first, np.arange(bands * rows).reshape(bands, rows)), "starred")
    wanted = crowd.select("id").distinct()
    side = keep(first.join(if_small(wanted, 16), "id", "left_semi"), "side")
    source = keep(named.join(wanted.toDF("no"), "no", "left_semi"), "wanted")
    here = if_small(source.select("id").distinct(), 16)  # whole texts had better not be shuffled
    texts = rows_in.join(here, "id", "left_semi").mapInArrow(
        _digested(width), "id long, set_a long, set_b long, text string"
    )
    texts = texts.join(source, ["id", "set_a", "set_b"]).select(F.col("no").alias("id"), "text")
    texts = keep(texts.dropDuplicates(["id"]), "texts")
    links = _links(_stars(crowd, percent).distinct(), side, texts, width, percent)

    mixed = _mixed(crowd, components(links)).select("id").distinct()
    again = texts.join(mixed, "id", "left_semi").select("id", "text")
    again = keep(again.mapInArrow(_sketches(width, DRAWS * DRAWN, FRESH), SKETCH), "fresh")
    crowd = keep(_crowds(again, long_bands()), "starred-again")
    stars = _stars(crowd, percent).distinct().join(links, ["a", "b"], "left_anti")
    links = keep(links.union(_links(stars, side, texts, width, percent)), "links")
    more = keep(_rest(_mixed(crowd, components(links)), side, texts, width, percent), "rest")
    of_class = classes.select("no", "first")
    linked = links.union(more).join(of_class.toDF("a", "first_a"), "a")
    linked = linked.join(of_class.toDF("b", "first_b"), "b").select("first_a", "first_b")
    same = components(linked.union(member).toDF("a", "b"))
    return (
        sketches.select("id", "n_shingles")
        .join(same, sketches["id"] == same["node"], "left")
        .select(
            F.col("id").alias("doc_id"), "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest doc_id.

    Rows that repeat a kept id all stay, as one document; columns are those of ``docs``.
    """
    found = near_duplicates(docs, **options)
    dropped = keep(found.where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(if_small(dropped, 32), "doc_id", "left_anti")
