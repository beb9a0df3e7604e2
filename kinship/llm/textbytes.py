"""Texts as one array of bytes: word bounds and word hashes for a whole Arrow batch at once, in numpy.

Hashes are of 64 bits: a byte's random number times a power of an odd constant by its place, summed over the word, then mixed. Sums
of all words come from one running sum. Two different words of a batch agree with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a number modulo 2**64; those for pieces of texts are kept."""
    have = _known.get(base, np.zeros(0, np.uint64))
    if n <= len(have):
        return have[:n]
    out = _more_powers(base, n)
    if n <= 1 << 20:
        _known[base] = out
    return out


def _more_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def pieces(column: pa.Array, most: int = 1 << 20):
    """(first row, end row, bytes, offsets) of runs of rows with about most bytes of text together; null counts as empty. A longer
    text is a piece of its own."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order. offsets: where each row's bytes begin, and end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    # A word ends before a space, the next word or the end of its row.
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = ~inside
    stop[edges] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _powers(_ODD, len(data)), out=total[1:])
    back = _powers(pow(_ODD, -1, 1 << 64), len(data))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair, which tells (a, b) from (b, a)."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
