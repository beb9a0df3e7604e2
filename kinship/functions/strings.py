"""String similarities that Spark lacks, as Arrow UDFs: each distinct pair of strings of a batch is compared once, and all of them side by
side in numpy, a step for each character."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of about the same length that are compared at once; words of 64 bits in a table of where characters stand, at most.
_AT_ONCE, _TABLE = 2048, 1 << 22
#: The lowest n bits.
_LOW = np.array([(1 << n) - 1 for n in range(65)], np.uint64)


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def _matrix(flat: np.ndarray, size: np.ndarray, width: int, none: int) -> np.ndarray:
    """A row for each string, of its size of the numbers of flat; none behind its end."""
    out = np.full((len(size), width), none, flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _by_length(of: Callable, a: list[str], b: list[str]) -> np.ndarray:
    """of(x, y, sizes of both) for all pairs, in runs of about the same length; x and y are matrices of characters in which nothing behind
    an end is equal to anything."""
    size = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    order = np.lexsort((size[:, 1], size[:, 0]))
    out = np.zeros(len(a))
    for lo in range(0, len(a), _AT_ONCE):
        mine = order[lo : lo + _AT_ONCE]
        x, y = [a[i] for i in mine], [b[i] for i in mine]
        n = size[mine]
        codes = [_codes(x), _codes(y)]
        seen = np.zeros(1 + max(int(c.max(initial=0)) for c in codes), bool)
        for c in codes:
            seen[c] = True
        many = int(seen.sum())
        number = (np.cumsum(seen) - 1).astype(np.uint16 if many > 250 else np.uint8)
        widths = -(-max(1, n[:, 0].max()) // 64) * 64, max(1, n[:, 1].max())
        out[mine] = of(*(_matrix(number[c], n[:, i], widths[i], many + i) for i, c in enumerate(codes)), n)
    return out


def _places(x: np.ndarray, y: np.ndarray) -> Callable[[int], list[np.ndarray]]:
    """A function of j: where each row of x, whose width is a multiple of 64, has the character that y has at j; a bit for each place, as
    arrays of words. They are looked up in a table of all characters if those are fewer than y is wide."""
    n, words, kinds = len(x), x.shape[1] // 64, int(max(x.max(initial=0), y.max(initial=0))) + 1
    bits = lambda same: np.packbits(same, axis=1, bitorder="little").view(np.uint64).T
    if kinds > y.shape[1] or kinds * words * n > _TABLE:
        return lambda j: list(bits(x == y[:, j : j + 1]))
    table = np.empty((kinds, words, n), np.uint64)
    for c in range(kinds):
        table[c] = bits(x == c)
    flat, at = table.reshape(-1), np.ascontiguousarray(y.T).astype(np.int64) * (words * n) + np.arange(n)
    return lambda j: [flat.take(at[j] + w * n) for w in range(words)]


def lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: a bit for each character of the longer string, 64 a word, a step for each
    of the shorter."""

    def run(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        words = x.shape[1] // 64
        s = np.full((words, len(x)), np.iinfo(np.uint64).max, np.uint64)
        places = _places(x, y)
        for j in range(y.shape[1]):
            carry = None
            for w, m in enumerate(places(j)):
                both = s[w] & m
                total = s[w] + both
                over = total < s[w] if w + 1 < words else None
                if carry is not None:
                    total += carry
                    over = over | (total < carry) if w + 1 < words else None
                carry = over
                s[w] = total | (s[w] ^ both)
        return x.shape[1] - np.bitwise_count(s).sum(0, dtype=np.int64)

    long = [x if len(x) >= len(y) else y for x, y in zip(a, b, strict=True)]
    short = [y if len(x) >= len(y) else x for x, y in zip(a, b, strict=True)]
    return _by_length(run, long, short).astype(np.int64)


def _ratio(common, size):
    """2 common / size, 1 for two empty strings."""
    return np.where(size > 0, 2 * common / np.maximum(size, 1), 1.0)


def indel_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """2 lcs / (length of both); 1 for two empty strings."""
    return _ratio(lcs(a, b), np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)]))


def token_sort_ratio(a: list[str], b: list[str]) -> np.ndarray:
    of = {x: " ".join(sorted(x.split())) for x in {*a, *b}}
    return indel_ratio([of[x] for x in a], [of[y] for y in b])


def token_set_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """The best indel ratio among the common tokens and each side's tokens, common ones first; 1 if one side's tokens are all common,
    0 if a side has none. Common tokens stand first on both sides, so they are common characters whatever follows."""
    of = {x: set(x.split()) for x in {*a, *b}}
    sets = [(of[x], of[y]) for x, y in zip(a, b, strict=True)]
    text = lambda s: " ".join(sorted(s))
    both, left, right = ([text(f(x, y)) for x, y in sets] for f in (lambda x, y: x & y, lambda x, y: x - y, lambda x, y: y - x))
    head = np.array([len(c) + 1 if c else 0 for c in both])
    one, two = (np.array([len(s) for s in side]) + head for side in (left, right))
    best = _ratio(lcs(left, right) + head, one + two)
    shared = np.maximum(head - 1, 0)
    best = np.where(head > 0, np.maximum(best, np.maximum(_ratio(shared, shared + one), _ratio(shared, shared + two))), best)
    all_ = (head > 0) & (np.array([not x or not y for x, y in zip(left, right, strict=True)]))
    empty = np.array([not x or not y for x, y in sets])
    return np.where(empty, 0.0, np.where(all_, 1.0, best))


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro's similarity, raised by a tenth for each of up to four equal first characters where it is above 0.7."""

    def run(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        words = -(-y.shape[1] // 64)
        padded = np.full((len(y), 64 * words), max(x.max(initial=0), y.max(initial=0)) + 1, y.dtype)
        padded[:, : y.shape[1]] = y
        reach = np.maximum(0, n.max(1) // 2 - 1)
        left, hits = np.full((words, len(x)), np.iinfo(np.uint64).max, np.uint64), np.zeros((int(max(1, n[:, 0].max())), len(x)), bool)
        places, far = _places(padded, x[:, : len(hits)]), int(reach.max())
        none = 64 * words + far  # low[none + k] are the lowest k bits: none of them up to 0, all from 64 on
        low = np.r_[np.zeros(none, np.uint64), _LOW, np.full(len(hits) + far + 1, _LOW[64])]
        for i in range(len(hits)):
            for w, m in enumerate(places(i)):
                if 64 * w > i + far or 64 * (w + 1) <= i - far:
                    continue
                m &= left[w] & low.take(reach + (none + i + 1 - 64 * w)) & ~low.take((none + i - 64 * w) - reach)
                m &= -m
                if w:
                    m[hits[i]] = 0  # an earlier word had one
                left[w] ^= m
                hits[i] |= m != 0
        mine = np.ascontiguousarray(hits.T)
        free = np.unpackbits(np.ascontiguousarray(left.T).view(np.uint8), axis=1, bitorder="little")[:, : y.shape[1]].astype(bool)
        m = mine.sum(1)
        row = np.repeat(np.arange(len(x)), m)
        moved = np.bincount(row, x[:, : mine.shape[1]][mine] != y[~free], len(x)) // 2
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / np.maximum(n[:, 0], 1) + m / np.maximum(n[:, 1], 1) + (m - moved) / some) / 3, 0.0)
        k = min(4, x.shape[1], y.shape[1])
        same = np.logical_and.accumulate(x[:, :k] == y[:, :k], 1).sum(1)
        out = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
        return np.where((n == 0).all(1), 1.0, out)

    out = _by_length(run, a, b)
    out[[i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x == y]] = 1.0
    return out


SCORES = {"token_set": token_set_ratio, "token_sort": token_sort_ratio, "ratio": indel_ratio, "jaro": jaro_winkler}


def similarities(a: Column, b: Column, names: tuple[str, ...] = tuple(SCORES)) -> Column:
    """A struct of the named similarities of two string columns; nulls count as empty. Equal pairs in a batch are computed once."""
    fs = [SCORES[n] for n in names]

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        known: dict[tuple[str, str], int] = {}
        pairs = zip((v or "" for v in x.to_pylist()), (v or "" for v in y.to_pylist()), strict=True)
        which = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
        left, right = [p for p, _ in known], [p for _, p in known]
        return pa.StructArray.from_arrays([pa.array((f(left, right) if known else np.zeros(0))[which], pa.float64()) for f in fs], list(names))

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ", ".join(f"{n} double" for n in names))(a, b)
