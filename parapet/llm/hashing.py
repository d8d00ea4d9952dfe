"""Hashes of words and word shingles of whole texts, on numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for texts of up to ``n`` bytes."""
    if _powers["n"] < n:
        size = max(n, 2 * _powers["n"], 1 << 16)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def lower_table() -> np.ndarray:
    """The code of each byte, capital A-Z as small letters."""
    codes = np.arange(256)
    codes[65:91] += 32
    return codes


BYTES = mix(lower_table().astype(np.uint64) + np.uint64(0x1234567))
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def spans(data: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``outside``."""
    edge = np.flatnonzero(np.diff(~outside[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hashes` takes the hash of any span."""
    up, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal for equal bytes wherever they stand."""
    _, down = _tables(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return span_hashes(prefix_sums(data), *spans(data))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the whole sequence as one."""
    words = word_hashes(text or "")
    width = min(width, len(words))
    if not width:
        return words
    n, total = len(words) - width + 1, np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = mix(total * np.uint64(_P) + words[i : i + n])
    return np.unique(total)
