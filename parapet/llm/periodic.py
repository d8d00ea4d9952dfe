"""Periodic runs of words: seeds from repeated k-grams, extended along their diagonal.

Lags are taken in classes [2^j, 2^(j+1)). A run of period q in the class matches itself, moved by q,
over at least ``(exponent - 1) * 2^j`` words (and ``shortest - q``), so it holds a k-gram of that
length which stands again q words on. As no k-gram is shorter than its class's largest lag, it cannot
stand in the run at a smaller distance, so the *next* occurrence of each k-gram is the only one to
look at. Each such pair of occurrences is extended to both sides on its diagonal, unless the table
of the furthest word covered at its lag says that an earlier extension has been there.

K-grams are named exactly, by doubling: a name of 2k words is a pair of names of k words, and only
positions whose name occurs again in the same text go on. The work of a text is
n log n whatever it holds, and texts are handled whole, several at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = 1 << 17  # words handled together, more if one text has more


# --- runs ----------------------------------------------------------------------------------
def _repeated(names: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Names of the pairs (names, other), -1 where a part is -1 or the pair occurs once."""
    out = np.full(len(names), -1, np.int64)
    at = np.flatnonzero((names >= 0) & (other >= 0))
    if len(at):
        _, code, count = np.unique(
            names[at] * size + other[at], return_inverse=True, return_counts=True
        )
        again = count[code] > 1
        out[at[again]] = code[again]
    return out


def _moved(names: np.ndarray, step: int) -> np.ndarray:
    out = np.full(len(names), -1, np.int64)
    out[: max(len(names) - step, 0)] = names[step:]
    return out


def _seeds(words: np.ndarray, shortest: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By class of lags: positions of k-grams, and the lag to their next occurrence."""
    size = len(words) + 1
    double = _repeated(words, _moved(words, 1), size)  # names of 2 words
    names = {1: words, 2: double}
    low = 1
    while names[2 * low].max(initial=-1) >= 0:
        wide = names[2 * low]  # at least as long as any lag of the class
        names[4 * low] = _repeated(wide, _moved(wide, 2 * low), size)
        k = max((exponent - 1) * low, shortest - (2 * low - 1))
        # two or more names of the longest known length that fits cover the k-gram
        length = 2 * low if k < 4 * low else 4 * low
        grams = names[length]
        for start in [*range(length, k - length, length), k - length]:
            if k > length:
                grams = _repeated(grams, _moved(names[length], start), size)
        at = np.flatnonzero(grams >= 0)
        at = at[np.argsort(grams[at], kind="stable")]
        same = grams[at[1:]] == grams[at[:-1]]
        at, lag = at[:-1][same], np.diff(at)[same]
        inside = (lag >= low) & (lag < 2 * low)
        yield at[inside], lag[inside]
        del names[low]
        low *= 2


def _agreeing(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on in the direction of ``step`` equal the one ``lag`` further."""
    done, span = 0, 64
    while True:
        if step > 0:
            stop = min(at + done + span, len(words) - lag)
            differ = words[at + done : stop] != words[at + done + lag : stop + lag]
        else:
            stop = max(at - done - span + 1, 0)
            differ = (words[stop : at - done + 1] != words[stop + lag : at - done + 1 + lag])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        if len(differ) < span:
            return done + len(differ)
        done, span = done + span, 4 * span


def find_runs(words: np.ndarray, shortest: int = 6, exponent: int = 4) -> np.ndarray:
    """(start, length, period) of all runs, ordered by start, then period.

    ``words`` holds numbers from 0 below its length. A run has its smallest period q, at least
    ``shortest`` and ``exponent * q`` words, and goes on to neither side.
    """
    if exponent < 3:  # a k-gram must be as long as any lag of its class
        raise ValueError("runs hold their period three times at least")
    runs = []
    for at, lag in _seeds(words, shortest, exponent):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        seed = 0
        while seed < len(at):
            here, d = int(at[seed]), int(lag[seed])
            start = here - _agreeing(words, here - 1, d, -1) if here else 0
            matched = here + _agreeing(words, here, d, 1)  # covered at this lag
            if matched - start + d >= max(shortest, exponent * d):
                runs.append((start, matched - start + d, d))
            last = int(np.searchsorted(lag, d, "right"))
            seed += int(np.searchsorted(at[seed:last], matched))
    out = np.array(runs, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


# --- texts ---------------------------------------------------------------------------------
def _looped(words: list[bytes], crc: int) -> list[bytes]:
    """A text whose words repeat from some place on; which ones and where follows from ``crc``."""
    n, g = len(words), crc // 10
    if crc % 10 or not n:
        return words
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + [words[first + (i - first) % period] for i in range(first, n)]


def _summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """The columns of one text: count, best run, digests, kept text."""
    best = (None, None, None, None)
    if len(runs):
        # exact comparison of length / period; runs are ordered by start, then period
        top = max(runs.tolist(), key=_Exponent)
        best = (*top, 1000 * top[1] // top[2])
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist()) if not d]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    text = b" ".join(words)
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    return (len(runs), *best, *digests, text.decode("utf-8", "replace"))


class _Exponent:
    def __init__(self, run: list[int]) -> None:
        self.length, self.period = run[1], run[2]

    def __gt__(self, other: _Exponent) -> bool:
        return self.length * other.period > other.length * self.period


_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]


def _reported(shortest: int, exponent: int, looped: bool, texts_too: bool):
    def rows(held: list[tuple[str | None, list[bytes]]], ids: list[pa.Array]) -> pa.RecordBatch:
        # Words are numbered by their first place, apart for every text: no name spans two texts.
        numbers, shift = [], 0
        for _, words in held:
            seen: dict[bytes, int] = {}
            places = range(shift, shift + len(words))
            numbers.append(np.fromiter(map(seen.setdefault, words, places), np.int64, len(words)))
            shift += len(words)
        found = find_runs(np.concatenate(numbers or [np.zeros(0, np.int64)]), shortest, exponent)
        cuts = np.cumsum([0, *(len(w) for _, w in held)])
        bounds = np.searchsorted(found[:, 0], cuts)
        out = []
        for i, (_, words) in enumerate(held):
            runs = found[bounds[i] : bounds[i + 1]] - [cuts[i], 0, 0]
            summary = _summary(words, runs)
            out.append((*summary[:-1], summary[-1] if texts_too else None,
                        runs.tolist() if texts_too else None))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), *columns], ["key", *_COLUMNS, "collapsed", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, text = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                words = (text or "").encode("utf-8", "replace").split()
                if looped and name is not None:
                    words = _looped(words, zlib.crc32(name.encode()))
                held.append((name, words))
                ids.append(batch.column(0).slice(i, 1))
                size += len(words) + 1
                if size >= _WORDS:
                    yield rows(held, ids)
                    held, ids, size = [], [], 0
        if held:
            yield rows(held, ids)

    return run


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    shortest: int = 6,
    exponent: int = 4,
    looped: bool = False,
    texts: bool = True,
) -> DataFrame:
    """Periodic runs of words of every text, and the text with one period of each left.

    Returns ``id_col``, n_runs, the run with the greatest length/period (start, length, period,
    exponent_milli = floor(1000 length/period)), sha256 of all runs (``start,length,period`` lines)
    and of the collapsed text, and with ``texts`` also ``collapsed`` and ``runs`` (arrays of start,
    length and period). Words are separated by ASCII white space and numbered from 0. ``looped``
    first lets some texts repeat, as their id's crc32 says (made-up runs, for checks).

    Null and empty texts have no words, no runs and an empty collapsed text; rows with equal or null
    ids stay apart, and a null id is never looped. Equal exponents: smallest start, then period.
    Further columns of ``docs`` are left out. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("key"), F.col(id_col).cast("string").alias("name"), F.col(text).alias("text")
    )
    schema = (
        f"key {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<array<long>>"
    )
    out = source.mapInArrow(_reported(shortest, exponent, looped, texts), schema)
    more = ["collapsed", "runs"] if texts else []
    return out.select(F.col("key").alias(id_col), *_COLUMNS, *more)
