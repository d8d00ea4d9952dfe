"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors of a label are ordered by a string of random projection signs, taken from
the label's centre, and every vector is compared with its next ``window`` neighbours; links of all
passes are united. A label gets as many passes as its counted size and a sample of its angles ask
for, so that a pair at the threshold is missed with a probability of ``MISS`` at most; a label that
so many windows cover anyway is compared in full, in blocks. Ranges of the order are partitions; what
lies on both sides of a cut is compared in a second, small step. Exact copies are one vector
throughout. Of the links in a window only those that connect its vectors go on. Last, the vectors of
each component found are compared in blocks, so that a vector's links are counted in full without a
row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import components, if_small, keep

#: Passes are ``PASSES`` at least; ``MISS`` bounds the mean chance to miss a pair at the threshold.
PASSES, WINDOW, BITS = 16, 128, 64
MISS, SAMPLE = 1e-3, 256
BLOCK = 512
_UNIT = "vec_id long, grp string, unit binary"
_PLACED = "pass int, grp string, sign binary, id long, unit binary"
_FOUND = [
    pa.field("a", pa.int64()), pa.field("b", pa.int64()), pa.field("cut", pa.int32()),
    pa.field("side", pa.int32()), pa.field("pass", pa.int32()), pa.field("grp", pa.string()),
    pa.field("sign", pa.binary()), pa.field("id", pa.int64()), pa.field("unit", pa.binary()),
]
_FOUND_DDL = (
    "a long, b long, cut int, side int, pass int, grp string, sign binary, id long, unit binary"
)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors at length 1 in double precision; null where a vector cannot be compared."""
    for batch in batches:
        grp, unit = [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = np.array(vector if vector is not None else [], np.float64)  # null parts become nan
            with np.errstate(over="ignore", invalid="ignore"):
                big = np.abs(x).max(initial=0)
                good = label is not None and np.isfinite(big) and big > 0
                x = x / big if good else x  # no overflow in the norm
            unit.append((x / np.linalg.norm(x)).tobytes() if good else None)
            grp.append(f"{label}/{len(x)}" if good else None)
        arrays = [batch.column(0), pa.array(grp, pa.string()), pa.array(unit, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "grp", "unit"])


def _matrix(units: list[bytes], kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(units), kind).reshape(len(units), -1)


def passes_needed(x: np.ndarray, n: int, threshold: float, window: int, bits: int = BITS) -> int:
    """Passes for a label of ``n`` vectors of which ``x`` are a sample.

    A pair meets in a pass if it agrees in as many signs as leave half a window of other vectors.
    That depth follows from the angles of a vector to the sample; vectors it links with are no
    others, as a link with any of them leads to the same component. Angles are those at the centre,
    where a pair at the threshold keeps its distance but not its angle.
    """
    y = x - x.mean(axis=0)
    size = np.maximum(np.linalg.norm(y, axis=1), 1e-12)
    agree = 1 - np.arccos(np.clip((y @ y.T) / np.outer(size, size), -1, 1)) / np.pi
    agree[x @ x.T >= threshold] = 0
    depth, part = np.full(len(x), bits), np.ones_like(agree)
    for d in range(bits):
        depth[(n * part.sum(axis=1) <= window / 2 * max(1, len(x) - 1)) & (depth == bits)] = d
        part = part * agree
    same = 1 - np.arcsin(np.minimum(1, (2 - 2 * threshold) ** 0.5 / size)) / np.pi
    missed, most = 1 - same**depth, -(-n // window)
    passes = PASSES
    while passes < most and (missed**passes).mean() > MISS:
        passes += 1
    return passes


def _plan(threshold: float, passes: int | None, window: int, bits: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, n = _matrix(list(frame["unit"])), int(frame["n"].iloc[0])
        wanted = passes or (
            PASSES if n <= PASSES * window else passes_needed(x, n, threshold, window, bits)
        )
        centre = x.mean(axis=0).astype(np.float32).tobytes()
        return pd.DataFrame({"grp": [key[0]], "centre": [centre], "passes": [wanted]})

    return run


def _planned(first: DataFrame, threshold: float, passes: int | None, window: int, bits: int):
    """``first`` with its label's size ``n``, ``centre``, ``passes`` and whether it is ``small``.

    The vectors of a label within one window meet in any pass; small labels are those that fewer
    windows than passes cover.
    """
    sizes = keep(first.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    large = first.join(if_small(sizes.where(F.col("n") > window + 1), 128), "grp")
    sample = large.where(F.pmod(F.xxhash64("id"), F.col("n")) < SAMPLE).select("grp", "n", "unit")
    plan = sample.groupBy("grp").applyInPandas(
        _plan(threshold, passes, window, bits), "grp string, centre binary, passes int"
    )
    few = F.when(F.col("n") == 1, 0).when(F.col("n") <= window + 1, 1).otherwise(passes or PASSES)
    plan = sizes.join(plan, "grp", "left").withColumn("passes", F.coalesce("passes", few))
    small = (F.col("n") > window + 1) & (F.col("n") <= F.col("passes") * window)
    plan = keep(plan.withColumn("small", small), "label-plans")
    return keep(first.join(if_small(plan, 1024), "grp"), "planned")


def _signs(passes: list[int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for frame in (b.to_pandas() for b in batches):
            for grp, part in frame.groupby("grp"):
                x, centre = _matrix(list(part["unit"])).astype(np.float32), part["centre"].iloc[0]
                y = x - np.frombuffer(centre, np.float32) if isinstance(centre, bytes) else x
                for p in (p for p in passes if p < part["passes"].iloc[0]):
                    key = p, x.shape[1]
                    if key not in planes:
                        planes[key] = np.random.default_rng(key).standard_normal((key[1], bits))
                    sign = np.packbits(y @ planes[key] > 0, axis=1)
                    yield pa.RecordBatch.from_pydict({
                        "pass": pa.array([p] * len(x), pa.int32()), "grp": [grp] * len(x),
                        "sign": [row.tobytes() for row in sign], "id": part["id"].to_numpy(),
                        "unit": [row.tobytes() for row in x],
                    })

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) of ``n`` nodes suffice to connect what all of them connect."""
    root, out = np.arange(n), [np.zeros(0, np.int64)]
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        left = np.flatnonzero(low != high)
        if not len(left):
            return np.concatenate(out)
        _, first = np.unique(high[left], return_index=True)
        left = left[first]
        out.append(left)
        parent = np.arange(n)
        parent[high[left]] = low[left]  # always to a smaller one: no circles
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]


def _near(frame: pd.DataFrame, window: int, floor: float, cut: int | None = None) -> list:
    """Pairs of rows at most ``window`` apart, of one pass and group, that reach ``floor``.

    Of pairs that surely reach the threshold, only those needed to connect their rows. With ``cut``,
    only pairs of rows on its two sides. Rows of a pass and group stand together.
    """
    if not len(frame):
        return []
    ids, a, b, sure = frame["id"].to_numpy(), [], [], []
    same = frame.groupby(["pass", "grp"], sort=False).ngroup().to_numpy()
    side = frame["side"].to_numpy() if cut is not None else None
    starts = np.flatnonzero(np.diff(same, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(frame)]):
        x = _matrix(list(frame["unit"].iloc[start:end]), np.float32)
        for i in range(0, len(x) - 1, window):
            part = x[i : i + window] @ x[i : i + 2 * window].T
            p, q = np.nonzero(part >= floor)
            at = (q > p) & (q - p <= window)
            p, q = p[at], q[at]
            if side is not None:
                at = side[start + i + p] != side[start + i + q]
                p, q = p[at], q[at]
            a.append(start + i + p)
            b.append(start + i + q)
            sure.append(part[p, q] >= floor + 2e-4)
    if not a:
        return []
    a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
    at = np.flatnonzero(sure)
    at = np.concatenate([at[_forest(len(frame), a[at], b[at])], np.flatnonzero(~sure)])
    a, b = ids[a[at]], ids[b[at]]
    return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))


def _pairs_frame(pairs: list) -> pd.DataFrame:
    return pd.DataFrame(sorted(set(pairs)), columns=["a", "b"], dtype="int64")


def _windows(window: int, floor: float):
    def links(pairs: list) -> pa.RecordBatch:
        a, b = zip(*sorted(set(pairs))) if pairs else ((), ())
        empty = [pa.nulls(len(a), field.type) for field in _FOUND[2:]]
        return pa.RecordBatch.from_arrays([pa.array(a, "int64"), pa.array(b, "int64"), *empty],
                                          schema=pa.schema(_FOUND))

    def ends(rows: pa.Table, cut: int, side: int) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        head = [pa.nulls(n, "int64"), pa.nulls(n, "int64"), pa.array([cut] * n, "int32"),
                pa.array([side] * n, "int32")]
        columns = [c.combine_chunks().cast(f.type) for c, f in zip(rows.columns, _FOUND[4:])]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield from pa.Table.from_arrays([*head, *columns], schema=pa.schema(_FOUND)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, last = TaskContext.get().partitionId(), None, None
        for rows in (pa.Table.from_batches([b]) for b in batches):
            if head is None or head.num_rows < window:
                head = pa.concat_tables([head, rows] if head else [rows]).slice(0, window)
            block = pa.concat_tables([last, rows]) if last else rows
            yield links(_near(block.to_pandas(), window, floor))
            last = block.slice(max(0, block.num_rows - window))
        if last is not None:
            yield from ends(head, part - 1, 1)
            yield from ends(last, part, 0)

    return run


def _across(window: int, floor: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pass", "grp", "sign", "id"], ignore_index=True)
        return _pairs_frame(_near(frame, window, floor, cut=0))

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            hit = [float(_matrix([x])[0] @ _matrix([y])[0]) >= threshold for x, y in pairs]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return run


def _counted(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left = frame[frame["block"] == key[1]]
        right = frame[frame["block"] == key[2]]
        x, y = _matrix(list(left["unit"])), _matrix(list(right["unit"]))
        hit = x @ y.T >= threshold
        if key[1] == key[2]:
            np.fill_diagonal(hit, False)
            n = hit @ right["copies"].to_numpy()
            return pd.DataFrame({"id": left["id"], "n": n})
        return pd.concat([
            pd.DataFrame({"id": left["id"], "n": hit @ right["copies"].to_numpy()}),
            pd.DataFrame({"id": right["id"], "n": hit.T @ left["copies"].to_numpy()}),
        ])

    return run


def _linked(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        left = np.flatnonzero(frame["block"] == key[1])
        right = np.flatnonzero(frame["block"] == key[2])
        x = _matrix(list(frame["unit"]))
        p, q = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[p], right[q]
        a, b = a[a != b], b[a != b]
        at, ids = _forest(len(frame), a, b), frame["id"].to_numpy()
        a, b = ids[a[at]], ids[b[at]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _block_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``rows`` once for each pair (lo, hi) of ``blocks`` that holds their ``block``."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tasks = placed.select(*columns, "block", other)
    return tasks.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})


def sorted_pass_links(
    first: DataFrame, threshold: float, passes: int | None, window: int, bits: int
) -> DataFrame:
    """Links (a, b) that connect the vectors ``first`` (id, grp, unit) as all links seen do."""
    floor = threshold - 1e-4  # single precision here, double in _exact
    first = _planned(first, threshold, passes, window, bits)
    small = first.where("small").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    exact = _block_pairs(small, "grp", "id", "unit").groupBy("grp", "lo", "hi")
    found = [keep(exact.applyInPandas(_linked(threshold), "a long, b long"), "block-links")]
    rest = first.where("not small")
    most = rest.agg(F.max("passes")).first()[0] or 0
    for start in range(0, most, 4):  # a few passes at a time bound what lies in shuffle files
        part = list(range(start, min(start + 4, most)))
        placed = rest.where(F.col("passes") > start).mapInArrow(_signs(part, bits), _PLACED)
        order = ["pass", "grp", "sign", "id"]
        placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        seen = keep(placed.mapInArrow(_windows(window, floor), _FOUND_DDL), "windows")
        cuts = seen.where("a is null").drop("a", "b")
        cuts = cuts.groupBy("cut").applyInPandas(_across(window, floor), "a long, b long")
        found.append(keep(seen.where("a is not null").select("a", "b").union(cuts), "pass-links"))
    links = reduce(DataFrame.union, found).distinct()
    unit = first.select("id", "unit")
    links = links.join(unit.toDF("a", "ua"), "a").join(unit.toDF("b", "ub"), "b")
    links = links.select("a", "b", "ua", "ub").mapInArrow(_exact(threshold), "a long, b long")
    return keep(links, "vector-links")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    passes: int | None = None,
    window: int = WINDOW,
    bits: int = BITS,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Vectors of one label are linked from a cosine of ``threshold`` on, in double precision.
    ``n_links`` counts the other vectors of the component linked directly, copies included;
    ``component_id`` is the smallest id reachable. ``passes`` are those that each label needs unless
    given. Null labels, null, empty or zero vectors, vectors
    with null or non-finite parts, and null ids link with nothing; vectors of different lengths do
    not either. Rows that repeat an id count as copies of it. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label_col, vector_col)
    rows = keep(rows.mapInArrow(_units, _UNIT), "units")
    good = rows.where("unit is not null and vec_id is not null")
    good = good.select("vec_id", "grp", "unit", F.sha1("unit").alias("digest"))
    same = good.groupBy("grp", "digest").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit")
    )
    first = keep(same, "vectors")
    member = good.select("vec_id", "grp", "digest").join(
        first.select("grp", "digest", "id", "copies"), ["grp", "digest"]
    )
    member = keep(member.select("vec_id", "id", "copies"), "vector-members")
    links = sorted_pass_links(first, threshold, passes, window, bits)
    comp = keep(components(links), "vector-components")

    sized = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = first.join(comp.withColumnRenamed("node", "id"), "id").join(sized, "component")
    tasks = _block_pairs(placed, "component", "id", "copies", "unit")
    counted = tasks.groupBy("component", "lo", "hi").applyInPandas(
        _counted(threshold), "id long, n long"
    )
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    named = (
        member.join(counted, "id", "left")
        .join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
    )
    named = named.groupBy(F.col("vec_id").alias("_id")).agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    return rows.join(named, rows["vec_id"] == named["_id"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
