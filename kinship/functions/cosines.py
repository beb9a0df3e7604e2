"""Cosines of two blocks of sparse vectors in numpy. A product of matrices of few columns, each the norm of one term or of several,
bounds every cosine from above; the pairs whose bound reaches what they must are worked out in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that have a column of their own, columns that the others share, rows of sources and of targets compared at once, numbers of the
#: table that double-precision weights are looked up in.
_DENSE, _SHARED, _ROWS, _TILE, _TABLE = 256, 256, 256, 4096, 1 << 20
#: Bounds of single precision are off by less.
_SLACK = 1e-5
#: Odd, for keys of characters; powers of it wrap at 64 bits.
_BASE = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "s long, tgt_id string, cos double, six double"
TERMS = "country string, gram long, df long"


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., size[0] of them, then those of first[1], and so on."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each with a space before it and one after; first place of each text, and the end)."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    joined = " " + "  ".join(texts.to_pylist()) + " " if len(size) else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(size)]


def _keys(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each run of characters, the same for equal runs."""
    out = np.zeros(len(first), np.uint64)
    power = np.uint64(1)
    for o in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > o)
        if len(has) == len(out):
            out += codes[first + o] * power
        else:
            out[has] += codes[first[has] + o] * power
        power = np.uint64(int(power) * int(_BASE) & (1 << 64) - 1)
    return out.view(np.int64)


def whole_keys(texts: pa.Array) -> np.ndarray:
    """The key of each text as one term."""
    codes, at = _characters(texts)
    return _keys(codes, at[:-1] + 1, np.diff(at) - 2)


def term_lists(texts: pa.Array, n: int | None) -> pa.ListArray:
    """The keys of each text's terms: of its words, as spaces part them, or with n of the runs of n characters of each word with a space
    at both ends, where a shorter one is one run."""
    codes, at = _characters(texts)
    space = np.r_[True, codes == 32, True]
    start, end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(space[2:] & ~space[1:-1]) + 1
    if n is None:
        first, size = start, end - start
    else:
        many = np.maximum(end - start + 3 - n, 1)
        first, size = _runs(start - 1, many), np.repeat(np.minimum(end - start + 2, n), many)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, at).astype(np.int32)), pa.array(_keys(codes, first, size)))


def _vectors(lists: pa.ListArray, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each row and the end, terms' places, weights): tf idf of rows of term keys, each row's norm 1. Keys that terms
    lack are left out."""
    sizes = np.diff(lists.offsets.to_numpy())
    keys = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
    known = terms[at] == keys
    both, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[known] * len(terms) + at[known], return_counts=True)
    row, term = np.divmod(both, len(terms))
    x = tf * idf[term]
    norm = np.sqrt(np.bincount(row, x * x, len(sizes)))
    return np.r_[0, np.cumsum(np.bincount(row, minlength=len(sizes)))], term, x / norm[row]


def _rows(v: tuple, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from 0, term, weight) of the rows lo to hi of vectors."""
    at, term, w = v
    return np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), term[at[lo] : at[hi]], w[at[lo] : at[hi]]


class Best:
    """The best cosines of the rows of s, above least; targets come in turn. A row's bar rises to what k targets so far surpass."""

    def __init__(self, s: tuple, terms: int, k: int, least: float) -> None:
        self.s, self.terms, self.k, self.least = s, terms, k, least
        self.height = len(s[0]) - 1
        heavy = np.argsort(-np.bincount(s[1], s[2], terms), kind="stable")
        place = np.arange(terms)
        self.column = np.empty(terms, np.int64)
        self.column[heavy] = np.where(place < _DENSE, place, _DENSE + (place - _DENSE) % _SHARED)
        self.left = np.empty((self.height, _DENSE + _SHARED), np.float32)
        for lo in range(0, self.height, _ROWS):
            self.left[lo : lo + _ROWS] = self._norms(s, lo, min(lo + _ROWS, self.height))
        self.top = np.full((self.height, k), max(least, 0.0))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.kept = 0

    def _norms(self, v: tuple, lo: int, hi: int) -> np.ndarray:
        row, term, w = _rows(v, lo, hi)
        width = _DENSE + _SHARED
        return np.sqrt(np.bincount(row * width + self.column[term], w * w, (hi - lo) * width)).astype(np.float32).reshape(hi - lo, width)

    def meet(self, t: tuple) -> None:
        """Compare with the next targets."""
        width, lo = len(t[0]) - 1, 0
        while lo < width:  # the first tiles are small, as bars are low
            hi = min(width, lo + min(_TILE, max(_TILE // 8, self.rows + lo)))
            self._tile(t, lo, hi)
            lo = hi
        self.rows += width

    def _tile(self, t: tuple, first: int, last: int) -> None:
        right = np.ascontiguousarray(self._norms(t, first, last).T)
        t_at, t_term, t_w = t
        many = max(1, min(_ROWS, _TABLE // self.terms))
        full = np.zeros((many, self.terms))
        flat = full.reshape(-1)
        for lo in range(0, self.height, many):
            hi = min(lo + many, self.height)
            bar = self.top[lo:hi, 0] - 2 * _SLACK
            i, j = np.divmod(np.flatnonzero(self.left[lo:hi] @ right > bar.astype(np.float32)[:, None]), last - first)
            j += first
            size = t_at[j + 1] - t_at[j]
            filled = size > 0  # a row without terms, where least is 0 or less
            i, j, size = i[filled], j[filled], size[filled]
            if not len(j):
                continue
            row, term, w = _rows(self.s, lo, hi)
            full[row, term] = w
            places = _runs(t_at[j], size)
            products = flat.take(np.repeat(i * self.terms, size) + t_term.take(places))
            products *= t_w.take(places)
            cos = np.add.reduceat(products, np.cumsum(size) - size)
            full[row, term] = 0.0
            near = cos > np.maximum(bar[i], max(self.least - 1e-6, 0.0))
            i, j, cos = i[near], j[near], cos[near]
            self.found.append((lo + i, self.rows + j, cos))
            self._raise(lo, hi, i, cos)
        if sum(len(x[0]) for x in self.found) > 2 * self.kept + (1 << 16):
            self.best()

    def _raise(self, lo: int, hi: int, i: np.ndarray, cos: np.ndarray) -> None:
        order = np.lexsort((-cos, i))
        i, cos = i[order], cos[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        few = place < self.k
        new = np.zeros((hi - lo, self.k))
        new[i[few], place[few]] = cos[few]
        self.top[lo:hi] = np.partition(np.concatenate([self.top[lo:hi], new], 1), self.k, 1)[:, self.k :]  # the least of them is first

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of s, row of all t, cosine) of what bars leave."""
        empty = [np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64)]
        i, j, cos = (np.concatenate(x) for x in zip(empty, *self.found, strict=True))
        near = cos > np.maximum(self.top[i, 0] - 2 * _SLACK, max(self.least - 1e-6, 0.0))
        self.found = [(i[near], j[near], cos[near])]
        self.kept = int(near.sum())
        return self.found[0]


def best_cosines(s: tuple, t: tuple, terms: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of s, row of t, cosine) of the pairs whose cosine is above least, but for what a millionth may change; of each row of s those
    that k rows of t do not surpass by more than that, at least. s and t are as _vectors makes them."""
    found = Best(s, terms, k, least)
    found.meet(t)
    return found.best()


def terms_counted(n: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of (country, text, n) that makes rows of TERMS: the records, n of a text, that have a term, of a part of a
    batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _TILE):
                batch = whole.slice(lo, _TILE)
                lists = term_lists(batch["text"], n)
                keys, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                country = batch["country"].dictionary_encode()
                has = np.unique(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) * len(keys) + at)
                row, term = np.divmod(has, max(len(keys), 1))
                both, place = np.unique(country.indices.to_numpy()[row] * np.int64(len(keys)) + term, return_inverse=True)
                df = np.bincount(place, batch["n"].to_numpy()[row], len(both)).astype(np.int64)
                code, term = np.divmod(both, max(len(keys), 1))
                yield pa.RecordBatch.from_arrays([country.dictionary.take(pa.array(code)), pa.array(keys[term]), pa.array(df)], ["country", "gram", "df"])

    return run


def six_places(x: np.ndarray) -> np.ndarray:
    """x, 0 to 1, to six places as Spark rounds: half up, of the shortest decimal that x is read from."""
    y = x * 1e6
    out = np.rint(y) / 1e6
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _named(i: np.ndarray, six: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in i, ids to take of each): what of the row i of s, at six and with size ids in order, can be among the k best of it, where
    ids decide between equals."""
    order = np.lexsort((-six, i))
    i, six, size = i[order], six[order], size[order]
    before, place = np.cumsum(size) - size, np.arange(len(i))
    starts = lambda new: np.maximum.accumulate(np.where(np.r_[True, new][: len(i)], place, 0))
    other = i[1:] != i[:-1]
    above = before[starts(other | (six[1:] != six[:-1]))] - before[starts(other)]
    few = above < k
    return order[few], np.minimum(size, k - above)[few]


def blocks_compared(k: int, least: float, n: int | None) -> Callable[[pa.Table], pa.Table]:
    """A function of a table of (side, id, text, ids, w): the rows of side s and t are texts, with terms as term_lists makes them of n, those
    of t have ids, those of side v are the terms' keys as id and their inverse document frequencies w. It makes rows of BLOCK, one for
    each of ids that may be among the k best of an s."""

    def run(block: pa.Table) -> pa.Table:
        side = block["side"].combine_chunks()
        part = {x: block.filter(pc.equal(side, x)).combine_chunks() for x in "stv"}
        out = [pa.array([], kind) for kind in (pa.int64(), pa.string(), pa.float64(), pa.float64())]
        if all(p.num_rows for p in part.values()):
            column = lambda x, c: part[x][c].combine_chunks()
            terms = column("v", "id").to_numpy()
            order = np.argsort(terms)
            terms, idf = terms[order], column("v", "w").to_numpy()[order]
            vectors = lambda x, lo, size: _vectors(term_lists(column(x, "text").slice(lo, size), n), terms, idf)
            best = Best(vectors("s", 0, None), len(terms), k, least)
            for lo in range(0, part["t"].num_rows, _TILE):
                best.meet(vectors("t", lo, _TILE))
            i, j, cos = best.best()
            six = six_places(cos)
            above = six > least
            i, j, cos, six = i[above], j[above], cos[above], six[above]
            ids = column("t", "ids")
            size = pc.list_value_length(ids).to_numpy()
            at, many = _named(i, six, size[j].astype(np.int64), k)
            places = _runs((np.cumsum(size) - size)[j[at]], many)
            at = np.repeat(at, many)
            out = [pa.array(column("s", "id").to_numpy()[i[at]]), ids.flatten().take(pa.array(places)), pa.array(cos[at]), pa.array(six[at])]
        return pa.Table.from_arrays(out, ["s", "tgt_id", "cos", "six"])

    return run
