"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length. Pieces are dealt by a hash to
shards of a bounded expected number of pieces, and each shard is packed in its own task: longest
piece first, into the open bin it fills best; where none has room, a bin of the least cost for the
pieces still to come is opened. The permitted lengths are weighed against each other by packing a
shard once per largest length to open, and once with the free choice; the cheapest result stands,
with each bin finally shrunk to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000
#: A sequence of n tokens costs n * (1 + n / QUADRATIC): attention makes long ones dearer.
QUADRATIC = 65_536


def sequence_cost(n: float) -> float:
    return n * (1 + n / QUADRATIC)


def word_count(text: Column) -> Column:
    """White-space words and an end mark; 0 for null, empty and blank texts."""
    words = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return F.when(words > 0, words + 1).otherwise(0).cast("long")


def _fill(sizes: Sequence[int], lengths: Sequence[int], opened: int | None) -> tuple[list, list]:
    """(bin, offset) of each size, given longest first, and the contents of each bin.

    ``opened`` is the length of new bins where it holds the piece; None chooses the cheapest one.
    """
    free: list[tuple[int, int]] = []  # room and number of each open bin
    used: list[int] = []
    placed, left = [], sum(sizes)
    for size in sizes:
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, number = free.pop(at)
        else:
            fit = [n for n in lengths if n >= size]
            if opened is None:  # cost for each token that is there to fill it
                room = min(fit, key=lambda n: (sequence_cost(n) / min(n, left), n))
            else:
                room = opened if opened >= size else fit[0]
            number = len(used)
            used.append(0)
        placed.append((number, used[number]))
        used[number] += size
        left -= size
        if room > size:
            insort(free, (room - size, number))
    return placed, used


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS):
    """(bin, offset) of each size, longest first, and the length of each bin, at the least cost."""
    lengths = sorted(lengths)
    best = None
    for opened in (None, *lengths):
        placed, used = _fill(sizes, lengths, opened)
        final = [lengths[bisect_left(lengths, n)] for n in used]
        cost = sum(map(sequence_cost, final))
        if best is None or cost < best[0]:
            best = cost, placed, final
    return best[1], best[2]


def _packed(lengths: Sequence[int]):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = ["n_tokens", "doc_id", "row", "piece"]
        frame = frame.sort_values(order, ascending=[False, True, True, True], ignore_index=True)
        placed, final = pack_sizes(frame["n_tokens"].tolist(), lengths)
        bins = np.array([b for b, _ in placed], np.int64)
        return frame.assign(
            shard=key[0], bin=bins, offset=[o for _, o in placed],
            capacity=np.array(final, np.int64)[bins],
        )[["doc_id", "piece", "start", "n_tokens", "shard", "bin", "offset", "capacity"]]

    return run


def pack_documents(
    docs: DataFrame,
    tokens: Column | None = None,
    lengths: Sequence[int] = LENGTHS,
    shard_pieces: int = SHARD_PIECES,
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, bin, offset, capacity): where each piece goes.

    ``tokens`` is the length of a row in tokens, by default the words of ``text`` and an end mark. A
    document longer than the largest of ``lengths`` is cut into pieces of that length and a rest. A
    sequence is known by (shard, bin). Rows of no tokens get no piece, so an empty table gives an
    empty result; rows that repeat an id are packed each, and a null id is packed like any other.
    """
    most = max(lengths)
    tokens = word_count(F.col("text")) if tokens is None else tokens
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens.cast("long").alias("n"))
    rows = rows.where("n > 0")
    # Equal rows are packed as often as they stand, in whatever task: they are counted, not numbered.
    rows = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("rows"))
    pieces = rows.select(
        "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"), "n",
    ).select("*", F.posexplode(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))
    ).alias("piece", "start"))
    size = F.least(F.lit(most), F.col("n") - F.col("start"))
    pieces = pieces.select("doc_id", "row", "piece", "start", size.cast("long").alias("n_tokens"))
    total = rows.agg(F.sum(F.ceil(F.col("n") / most) * F.col("rows")).alias("p")).first()["p"] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    place = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)).alias("shard")
    return pieces.select("*", place).groupBy("shard").applyInPandas(
        _packed(sorted(lengths)),
        f"doc_id {kind}, piece int, start long, n_tokens long, shard long, bin long, offset long, "
        "capacity long",
    )
