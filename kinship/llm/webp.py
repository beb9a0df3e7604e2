"""Lossless WebP: a decoder of the whole VP8L format and an encoder, pixels as numpy arrays of (height, width, 4) bytes R, G, B, A."""

from __future__ import annotations

import functools
import itertools
import struct
from collections import Counter
from collections.abc import Sequence

import numpy as np

SIDE = 1 << 14  #: the longest side of an image
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order in which lengths of code-length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 near places of a back-reference as (left, up), by distance, then by |left|, right ones last.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
_CACHE_HASH = 0x1E35A7BD


class BadWebp(ValueError):
    """Bytes that are no lossless WebP."""


class _Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise BadWebp("the image ends too early")
        return out


@functools.cache
def _reversed(bits: int) -> np.ndarray:
    """Each number of so many bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


class _Code:
    """A prefix code, from the length of each symbol's word."""

    def __init__(self, lengths: Sequence[int]):
        n = np.array(lengths, np.int64)
        used = np.flatnonzero(n)
        self.only = int(used[0]) if len(used) == 1 else None if len(used) else 0
        if self.only is not None:
            self.bits, self.table = 0, np.array([self.only << 4], np.int32)
            return
        self.bits = int(n.max())
        used = used[np.argsort(n[used], kind="stable")]
        places = 1 << (self.bits - n[used])
        if places.sum() != 1 << self.bits:
            raise BadWebp("a prefix code is not complete")
        # symbol << 4 | length of its word, by the next bits, of which the first is the lowest
        self.table = np.repeat(used << 4 | n[used], places)[_reversed(self.bits)].astype(np.int32)

    @functools.cached_property
    def list(self) -> list[int]:
        return self.table.tolist()

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        e = self.list[bits.peek(self.bits)]
        bits.at += e & 15
        return e >> 4

    def packed(self) -> tuple[list[int], int]:
        """The table, and a mask of the bits that it goes by."""
        return self.list, (1 << self.bits) - 1


def words_of(lengths: Sequence[int]) -> dict[int, int]:
    """Each symbol's canonical word with its first bit lowest."""
    word, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        word <<= n - last
        last = n
        out[s] = int(f"{word:0{n}b}"[::-1], 2)
        word += 1
    return out


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return _simple(size, first, bits.read(8) if two else first)
    several = 4 + bits.read(4)
    first = bits.at >> 3
    code = _code_of_lengths(several, int.from_bytes(bits.data[first : first + 9], "little") >> (bits.at & 7) & ((1 << 3 * several) - 1))
    bits.at += 3 * several
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if code.only is not None and code.only < 16:  # words of no bits
        return _code((code.only,) * min(left, size) + (0,) * (size - min(left, size)))
    lengths: list[int] = []
    before, (table, mask), data, at, have, window = 8, code.packed(), bits.data, bits.at, 0, 0
    while len(lengths) < size and left:
        left -= 1
        if have < 24:
            window, have = int.from_bytes(data[at >> 3 : (at >> 3) + 16], "little") >> (at & 7), 120
        e = table[window & mask]
        n, s = e & 15, e >> 4
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + (window >> n & 3))
            n += 2
        elif s == 17:
            lengths += [0] * (3 + (window >> n & 7))
            n += 3
        else:
            lengths += [0] * (11 + (window >> n & 127))
            n += 7
        window >>= n
        at += n
        have -= n
    bits.at = at
    if at > 8 * len(data):
        raise BadWebp("the image ends too early")
    if len(lengths) > size:
        raise BadWebp("a prefix code has too many lengths")
    return _code(tuple(lengths) + (0,) * (size - len(lengths)))


@functools.lru_cache(1024)
def _simple(size: int, *symbols: int) -> _Code:
    """The code of one symbol, or of two."""
    return _Code([int(s in symbols) for s in range(max(size, 256))][:size])


@functools.lru_cache(1024)
def _code(lengths: tuple[int, ...]) -> _Code:
    """Files of one encoder share codes."""
    return _Code(lengths)


@functools.lru_cache(1024)
def _code_of_lengths(several: int, value: int) -> _Code:
    """The code in which code lengths are written, from three bits for each length of its own words."""
    of = [0] * 19
    for i in range(several):
        of[LENGTH_ORDER[i]] = value >> 3 * i & 7
    return _Code(of)


def _number(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_head(bits: _Bits, width: int, height: int, main: bool) -> tuple[int, int, np.ndarray | None, list[list[_Code]]]:
    """What stands before the pixels of an entropy-coded image: (bits of its colour cache, bits of a tile, the number of the group of
    codes of each tile or None, the groups)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadWebp("the colour cache is too large")
    groups, tile, which = 1, 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        which = (_read_pixels(bits, _blocks(width, tile), _blocks(height, tile), False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return cache_bits, tile, which, [[_read_code(bits, n) for n in sizes] for _ in range(groups)]


def _read_pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as a flat array of 0xAARRGGBB."""
    return _read_body(bits, width, height, *_read_head(bits, width, height, main))


def _read_body(bits: _Bits, width: int, height: int, cache_bits: int, tile: int, which: np.ndarray | None, codes: list[list[_Code]]) -> np.ndarray:
    """The pixels behind a head, one after the other."""
    total = width * height
    cache = [0] * (1 << cache_bits) if cache_bits else []
    out: list[int] = []
    per_row = _blocks(width, tile) if tile else 0
    tables = [[c.packed() for c in group] for group in codes]
    (green, g_mask), (red, r_mask), (blue, b_mask), (alpha, a_mask), (far, f_mask) = tables[0]
    data = np.frombuffer(bits.data + bytes(64), np.uint8).astype(np.uint32)
    at32 = memoryview(data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24)  # 32 bits from each byte on
    at, end, shift, kept, n_out = bits.at, 8 * len(bits.data), 32 - cache_bits, 0, 0
    while n_out < total:
        if at > end:
            raise BadWebp("the image ends too early")
        if which is not None:
            y, x = divmod(n_out, width)
            (green, g_mask), (red, r_mask), (blue, b_mask), (alpha, a_mask), (far, f_mask) = tables[which[(y >> tile) * per_row + (x >> tile)]]
        e = green[at32[at >> 3] >> (at & 7) & g_mask]
        at += e & 15
        s = e >> 4
        if s < 256:
            r = red[at32[at >> 3] >> (at & 7) & r_mask]
            at += r & 15
            b = blue[at32[at >> 3] >> (at & 7) & b_mask]
            at += b & 15
            a = alpha[at32[at >> 3] >> (at & 7) & a_mask]
            at += a & 15
            out.append(a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4)
            n_out += 1
        elif s < 280:
            bits.at = at
            n = _number(bits, s - 256)
            e = far[at32[bits.at >> 3] >> (bits.at & 7) & f_mask]
            bits.at += e & 15
            d = _number(bits, e >> 4)
            at = bits.at
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n_out or n_out + n > total:
                raise BadWebp("a back-reference leaves the image")
            out += out[n_out - d : n_out - d + n] if d >= n else (out[n_out - d :] * (n // d + 1))[:n]
            n_out += n
        else:
            for p in out[kept:]:  # the cache is brought up to date where it is read
                cache[(_CACHE_HASH * p & 0xFFFFFFFF) >> shift] = p
            kept = n_out
            out.append(cache[s - 280])
            n_out += 1
    if at > end:
        raise BadWebp("the image ends too early")
    bits.at = at
    return np.array(out, np.uint32)


def _mean(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, corner, ahead):
    """The prediction of a pixel from its neighbours' channels (arrays of int, four each): left, above, above left, above right."""
    if mode in (1, 2, 3, 4):
        return (left, top, ahead, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, ahead), top)
    if mode in (6, 7, 8, 9):
        return _mean(*((left, corner), (left, top), (corner, top), (top, ahead))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, ahead))
    if mode == 11:
        return left if abs(top - corner).sum() < abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = _mean(left, top)
        return np.clip(m + _half(m - corner), 0, 255)
    return np.array([0, 0, 0, 255])  # mode 0, and those that the format leaves open


def _half(d):
    """Half of a difference, rounded toward zero."""
    return np.sign(d) * (abs(d) >> 1)


def _predict(image: np.ndarray, modes: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    """Add predictions to residuals (h, w, 4), or with forward take them from pixels."""
    h, w, _ = image.shape
    out = image.astype(np.int64)
    known = image.astype(np.int64) if forward else out
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = known[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                p = known[y - 1, 0]
            else:
                ahead = known[y - 1, x + 1] if x + 1 < w else known[y, 0]
                p = predicted(int(modes[y >> tile, x >> tile]), known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], ahead)
            out[y, x] = (image[y, x] - p if forward else out[y, x] + p) & 255
    return out


def _signed(a):
    return ((a & 255) ^ 128) - 128


def _cross(image: np.ndarray, elements: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    """elements: (rows, columns, 3) of green to red, green to blue, red to blue."""
    h, w, _ = image.shape
    e = _signed(elements.astype(np.int64))[np.arange(h)[:, None] >> tile, np.arange(w)[None, :] >> tile]
    out = image.astype(np.int64)
    r, g, b = (out[:, :, i] for i in range(3))
    sign = -1 if forward else 1
    new = (r + sign * (e[:, :, 0] * _signed(g) >> 5)) & 255
    b = (b + sign * ((e[:, :, 1] * _signed(g) >> 5) + (e[:, :, 2] * _signed(r if forward else new) >> 5))) & 255
    out[:, :, 0], out[:, :, 2] = new, b
    return out


def _channels(argb: np.ndarray, width: int) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (16, 8, 0, 24)], -1).astype(np.int64).reshape(-1, width, 4)


def _packed(image: np.ndarray) -> np.ndarray:
    i = image.astype(np.uint32)
    return ((i[..., 3] << 24) | (i[..., 0] << 16) | (i[..., 1] << 8) | i[..., 2]).reshape(-1)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    bits, width, height, transforms, w = _opened(data)
    return _finished(_read_pixels(bits, w, height, True), w, transforms)


def _opened(data: bytes) -> tuple[_Bits, int, int, list[tuple], int]:
    """(bits from the main image on, width, height, transforms, the main image's width) of a file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadWebp("no WebP file")
    at, chunk = 12, None
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            chunk = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if chunk is None or len(chunk) < 5 or chunk[0] != 0x2F:
        raise BadWebp("no lossless image in the file")
    bits = _Bits(chunk)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadWebp("a version that the format doesn't know")
    transforms, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise BadWebp("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            image = _channels(_read_pixels(bits, _blocks(w, tile), _blocks(height, tile), False), _blocks(w, tile))
            transforms.append((kind, w, tile, image))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, n, 1, False), n)[0], 0) & 255
            transforms.append((kind, w, _bundle(n), table))
            w = _blocks(w, _bundle(n))
        else:
            transforms.append((kind, w, 0, None))
    return bits, width, height, transforms, w


def _finished(argb: np.ndarray, w: int, transforms: list[tuple]) -> np.ndarray:
    """The pixels of a file from those of its main image, by its transforms undone from the last to the first."""
    image = _channels(argb, w)
    for kind, w, tile, with_ in reversed(transforms):
        if kind == PREDICTOR:
            image = _predict(image, with_[:, :, 1] & 15, tile, False)
        elif kind == CROSS_COLOUR:
            image = _cross(image, with_[:, :, [2, 1, 0]], tile, False)
        elif kind == SUBTRACT_GREEN:
            image[:, :, [0, 2]] = (image[:, :, [0, 2]] + image[:, :, [1]]) & 255
        else:
            each, x = 8 >> tile, np.arange(w)
            index = (image[:, x >> tile, 1] >> (each * (x & ((1 << tile) - 1)))) & ((1 << each) - 1)
            table = np.concatenate((with_, np.zeros((256, 4), np.int64)))  # an index past the palette is transparent black
            image = table[index]
    return image.astype(np.uint8)


# --- encoder


class _Out:
    def __init__(self):
        self.value, self.n = 0, 0
        self.done: list[bytes] = []

    def write(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n
        if self.n >= 1 << 12:
            k = self.n >> 3
            self.done.append((self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little"))
            self.value >>= 8 * k
            self.n &= 7

    def extend(self, data: bytes, n: int) -> None:
        """Write the n bits of data."""
        k = self.n >> 3
        self.done.append((self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little"))
        self.value >>= 8 * k
        self.n &= 7
        if self.n == 0 and n & 7 == 0:
            self.done.append(data)
            return
        all_ = self.value | int.from_bytes(data, "little") << self.n
        k = (self.n + n) >> 3
        raw = all_.to_bytes(k + 1, "little")
        self.done.append(raw[:k])
        self.value, self.n = raw[k], (self.n + n) & 7

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")


def _lengths(counts: dict[int, int], size: int, most: int) -> list[int]:
    """Huffman code lengths of at most `most` bits; counts are halved until they fit."""
    out = [0] * size
    counts = {s: c for s, c in counts.items() if c}
    if len(counts) < 2:
        for s in counts:
            out[s] = 1
        return out
    while True:
        leaves = sorted((c, s) for s, c in counts.items())
        n = len(leaves)
        weight, parent = [c for c, _ in leaves], [0] * (2 * n - 1)
        leaf, inner = 0, n  # the lightest that are left of either kind, both in order of weight
        for new in range(n, 2 * n - 1):
            pair = 0
            for _ in range(2):
                if inner >= new or leaf < n and weight[leaf] <= weight[inner]:
                    at, leaf = leaf, leaf + 1
                else:
                    at, inner = inner, inner + 1
                pair += weight[at]
                parent[at] = new
            weight.append(pair)
        deep = [0] * (2 * n - 1)
        for at in range(2 * n - 3, -1, -1):
            deep[at] = deep[parent[at]] + 1
        depth = {s: deep[at] for at, (_, s) in enumerate(leaves)}
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def _write_code(out: _Out, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if not used or len(used) <= 2 and used[-1] < 256 and all(lengths[s] == 1 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(used[0] > 1, 1)
        out.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.write(used[1], 8)
        return
    symbols: list[tuple[int, int, int]] = []
    for n, same in itertools.groupby(lengths):
        run = len(list(same))
        if n:
            symbols.append((n, 0, 0))
            run -= 1
            while run >= 3:
                symbols.append((16, min(run, 6) - 3, 2))
                run -= min(run, 6)
        while n == 0 and run >= 3:
            symbols.append((18, min(run, 138) - 11, 7) if run >= 11 else (17, run - 3, 3))
            run -= min(run, 138)
        symbols += [(n, 0, 0)] * run
    of = _lengths(Counter(s for s, _, _ in symbols), 19, 7)
    out.write(0, 1)
    last = max(i for i, s in enumerate(LENGTH_ORDER) if of[s])
    out.write(max(4, last + 1) - 4, 4)
    for s in LENGTH_ORDER[: max(4, last + 1)]:
        out.write(of[s], 3)
    out.write(0, 1)
    words = words_of(of)
    if sum(x > 0 for x in of) == 1:
        of = [0] * 19
    value = at = 0
    for s, extra, n in symbols:
        value |= (extra << of[s] | words[s] * (of[s] > 0)) << at
        at += of[s] + n
    out.write(value, at)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number)."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + ((v >> n) & 1), v & ((1 << n) - 1), n


def _write_pixels(out: _Out, argb: np.ndarray, width: int, main: bool, cache_bits: int, references: bool, groups: tuple[int, np.ndarray] | None = None) -> None:
    px = np.ascontiguousarray(argb).reshape(-1).astype(np.uint32)
    total = len(px)
    out.write(cache_bits > 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    tile, which = groups or (0, None)
    if main:
        out.write(which is not None, 1)
        if which is not None:
            out.write(tile - 2, 3)
            _write_pixels(out, which.astype(np.uint32).reshape(-1) << 8, which.shape[1], False, 0, False)
    many = int(which.max()) + 1 if which is not None else 1
    starts, runs, back = _references(px) if references else ([], [], [])
    inside = np.zeros(total + 1, np.int32)  # pixels that references cover, besides their first
    np.add.at(inside, np.array(starts, np.int64) + 1, 1)
    np.add.at(inside, np.array(starts, np.int64) + np.array(runs, np.int64), -1)
    first = np.flatnonzero(np.cumsum(inside[:-1]) == 0)  # each token's first pixel
    place = np.searchsorted(first, starts)
    p = px[first].astype(np.int64)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    # Up to four symbols a token, with their code and the bits that follow; -1 is none.
    symbol = np.stack([p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24], 1)
    extra, wide = np.zeros_like(symbol), np.zeros_like(symbol)
    if cache_bits:
        slot = (px.astype(np.uint64) * _CACHE_HASH & 0xFFFFFFFF) >> np.uint64(32 - cache_bits)
        before = _before(slot)
        hit = np.where(before >= 0, px[before], 0) == px
        cached = hit[first]
        symbol[cached, 0] = 280 + slot[first[cached]].astype(np.int64)
        symbol[cached, 1:] = -1
    kind = np.broadcast_to(np.arange(4), symbol.shape).copy()
    if len(starts):
        near = {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
        a = np.array([_prefix(n) for n in runs])
        b = np.array([_prefix(near.get(d, d + 120)) for d in back])
        symbol[place] = np.stack([256 + a[:, 0], b[:, 0], np.full(len(a), -1), np.full(len(a), -1)], 1)
        extra[place, :2], wide[place, :2] = np.stack([a[:, 1], b[:, 1]], 1), np.stack([a[:, 2], b[:, 2]], 1)
        kind[place, 1] = 4
    g = which[first // width >> tile, first % width >> tile].astype(np.int64) if which is not None else np.zeros(len(first), np.int64)
    word, length = np.zeros_like(symbol), np.zeros_like(symbol)
    for group in range(many):
        mine = (g == group)[:, None] & (symbol >= 0)
        for k, size in enumerate(sizes):
            of = mine & (kind == k)
            used = symbol[of]
            lengths = _lengths({i: c for i, c in enumerate(np.bincount(used, minlength=size).tolist()) if c}, size, 15)
            _write_code(out, lengths)
            if sum(x > 0 for x in lengths) > 1:
                table = np.zeros(size, np.int64)
                words = words_of(lengths)
                table[list(words)] = list(words.values())
                word[of], length[of] = table[used], np.array(lengths)[used]
    value, n = (np.stack(x, 2).reshape(-1) for x in ((word, extra), (length, wide)))
    value, n = value[n > 0], n[n > 0]
    for at in range(0, len(n), 1 << 18):
        v, m = value[at : at + (1 << 18)], n[at : at + (1 << 18)]
        bit = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        packed = np.packbits((np.repeat(v, m) >> bit & 1).astype(np.uint8), bitorder="little")
        out.extend(packed.tobytes(), len(bit))


def _before(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, -1 for none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def _references(px: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(first pixels, lengths, distances): from left to right, wherever the next three pixels came before, what follows the last such
    place, as far as it agrees."""
    starts: list[int] = []
    runs: list[int] = []
    back: list[int] = []
    if len(px) < 4:
        return starts, runs, back
    a = px.astype(np.uint64)
    before = _before((a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9)))
    at = np.flatnonzero(before >= 0)
    b = before[at]
    at = at[(px[at] == px[b]) & (px[at + 1] == px[b + 1]) & (px[at + 2] == px[b + 2])]
    p, total, free = px.tolist(), len(px), 0
    for i, j in zip(at.tolist(), before[at].tolist()):
        if i < free:
            continue
        n = 3
        while n < 4096 and i + n < total and p[j + n] == p[i + n]:
            n += 1
        starts.append(i)
        runs.append(n)
        back.append(i - j)
        free = i + n
    return starts, runs, back


def _wrapped(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def _begun(width: int, height: int) -> _Out:
    if not (0 < width <= SIDE and 0 < height <= SIDE):
        raise ValueError(f"an image's sides are from 1 to {SIDE}")
    out = _Out()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    return out


def encode(pixels: np.ndarray, transforms=(), cache_bits: int = 0, references: bool = False, groups: tuple[int, np.ndarray] | None = None) -> bytes:
    """A lossless WebP file of pixels (h, w, 4). transforms, in the order in which they are applied: (PREDICTOR, tile bits, modes),
    (CROSS_COLOUR, tile bits, elements), (SUBTRACT_GREEN,), (PALETTE,). groups: tile bits, and the prefix codes' number by tile."""
    image = np.asarray(pixels, np.uint8).astype(np.int64)
    out = _begun(image.shape[1], image.shape[0])
    for kind, *with_ in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile, values = with_
            out.write(tile - 2, 3)
            block = np.zeros((*values.shape[:2], 4), np.int64)
            if kind == PREDICTOR:
                block[:, :, 1] = values
                image = _predict(image, values, tile, True)
            else:
                block[:, :, [2, 1, 0]] = values
                image = _cross(image, values, tile, True)
            _write_pixels(out, _packed(block), block.shape[1], False, 0, False)
        elif kind == SUBTRACT_GREEN:
            image[:, :, [0, 2]] = (image[:, :, [0, 2]] - image[:, :, [1]]) & 255
        else:
            table, index = np.unique(_packed(image), return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette holds 256 colours at most")
            tile = _bundle(len(table))
            out.write(len(table) - 1, 8)
            colours = _channels(table, len(table))[0]
            _write_pixels(out, _packed(np.diff(colours, axis=0, prepend=0) & 255), len(table), False, 0, False)
            index = index.reshape(image.shape[:2])
            packed = np.zeros((image.shape[0], _blocks(image.shape[1], tile)), np.int64)
            for x in range(image.shape[1]):
                packed[:, x >> tile] |= index[:, x] << ((8 >> tile) * (x & ((1 << tile) - 1)))
            image = np.zeros((*packed.shape, 4), np.int64)
            image[:, :, 1] = packed
    out.write(0, 1)
    _write_pixels(out, _packed(image), image.shape[1], True, cache_bits, references, groups)
    return _wrapped(out.bytes())
