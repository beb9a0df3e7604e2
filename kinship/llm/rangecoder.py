"""Token ids as bytes: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Three predictors stand behind each id. The order-2 and the order-1 model hold, for the last two ids (hashed) and the last one, the id
that followed before and a confidence from 0 to 7; the order-0 model holds adaptive counts of ids. Their mixture gives the id's
probability: the shares of the three depend on both confidences, and are themselves counted as the block goes on. The coder first
codes which predictor is right, with its share in that context, and for order 0 then the id with its probability.

A block is coded as many lanes side by side, each lane a run of the block's ids with a range coder of its own; all lanes share the
models. Each step codes one id of every lane, with the models as they stood before the step, so numpy handles a step at once. Models
begin anew with each block.

The ids that a block has are its alphabet; inside, ids are places in it.

Block: magic KTB2; then as little-endian u32: ids, lanes, size of the alphabet, bytes of the packed alphabet, crc32 of the ids, crc32
of all the rest of the block; the alphabet's differences as u32, packed by zlib; the number of 16-bit words of each lane as u16 or u32 (u32 where
lanes have over 16384 steps); the words of all lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"KTB2"
_HEAD, _CRC = struct.Struct("<4sIIIII"), struct.Struct("<I")
LANES, STEPS = 16384, 64
#: Ids that share a block, unless one document has more.
BLOCK = LANES * STEPS
_HASH, _FLAG, _ID = 16, 12, 22
#: Units of an id's probability that share an entry of the table by which it is found.
_COARSE = 8
_U = np.uint64
_LOW32, _MIN = _U(0xFFFFFFFF), _U(1 << 32)


class CorruptBlock(ValueError):
    """A block whose checksum, length or header is wrong."""


class _Model:
    """What both directions know before a step. Predictions are kept with their confidence in the lowest three bits."""

    def __init__(self, lanes: int, size: int, decodes: bool):
        self.order1, self.order2 = np.zeros(size + 1, np.int32), np.zeros(1 << _HASH, np.int32)
        self.last = np.full(lanes, size, np.int32)  # no id yet
        self.before = self.last.copy()
        self.share = np.ones((64, 3), np.int64)
        self.share[:, 2] = 3
        self.count = np.zeros(size, np.int64)
        self.seen, self.due, self.fresh, self.steps = 0, 0, [], 0
        self.decodes = decodes
        self._tables()
        self._counts()

    def _tables(self) -> None:
        total = self.share.sum(1)
        if (total > 1 << 16).any():
            big = total > 1 << 16
            self.share[big] = (self.share[big] + 1) >> 1
            total = self.share.sum(1)
        f = 1 + self.share[:, :2] * ((1 << _FLAG) - 3) // total[:, None]
        # Where the interval of each predictor begins in a context, and how wide it is, by context and predictor.
        begin = np.zeros((64, 4), np.uint64)
        begin[:, 1] = f[:, 0]
        begin[:, 2] = f[:, 0] + f[:, 1]
        begin[:, 3] = 1 << _FLAG
        self.to2, self.to1 = begin[:, 1].copy(), begin[:, 2].copy()
        self.begin = begin.reshape(-1)
        self.wide = np.diff(self.begin, append=np.uint64(0))

    def _counts(self) -> None:
        for x in self.fresh:
            self.count += np.bincount(x, minlength=len(self.count))
        self.fresh = []
        v, total = len(self.count), int(self.count.sum())
        # An eighth of the scale, or one unit an id, for ids not seen yet; the rest by counts.
        floor = max(1, (1 << _ID) // 8 // max(v, 1)) if total else (1 << _ID) // v
        rest = (1 << _ID) - floor * v
        f = np.zeros(v + 1, np.int64)  # the last place is of lanes that code no id in a step
        f[:v] = floor + (self.count * rest // total if total else 0)
        self.id_wide = f.view(np.uint64)
        cum = np.cumsum(f[:v]) - f[:v]
        self.id_begin = np.append(cum, 0).view(np.uint64)
        if self.decodes:
            self.cum = np.append(cum, cum[-1] + f[v - 1]).view(np.uint64)
            self.near = np.searchsorted(self.cum, np.arange(0, 1 << _ID, 1 << _COARSE, dtype=np.uint64), "right").astype(np.int32) - 1

    def find(self, x: np.ndarray) -> np.ndarray:
        """The id in whose interval each number lies."""
        most = len(self.count) - 1
        out = np.minimum(self.near[(x >> _U(_COARSE)).astype(np.int64)], most)
        todo = np.flatnonzero((self.cum[out + 1] <= x) & (out < most))
        for _ in range(3):
            if not len(todo):
                return out
            out[todo] += 1
            todo = todo[(self.cum[out[todo] + 1] <= x[todo]) & (out[todo] < most)]
        out[todo] = np.minimum(np.searchsorted(self.cum, x[todo], "right") - 1, most)
        return out

    def look(self) -> None:
        self.key = ((self.before * np.int32(-1640531535) + self.last * np.int32(-2048144777)).view(np.uint32) >> np.uint32(32 - _HASH)).view(np.int32)
        self.m1, self.m2 = self.order1[self.last], self.order2[self.key]
        self.s1, self.s2 = self.m1 & 7, self.m2 & 7
        self.p1, self.p2 = self.m1 >> 3, self.m2 >> 3
        self.ctx = (self.s2 << 3) | self.s1

    def learn(self, ids: np.ndarray, right1: np.ndarray, right2: np.ndarray, which: np.ndarray, literals: np.ndarray) -> None:
        """which: 0, 1 or 2, for order 2, order 1, order 0."""
        self.share += 24 * np.bincount(self.ctx * np.int32(3) + which, minlength=192).reshape(64, 3)
        new = ids << np.int32(3)
        for order, at, hit, m, s in ((self.order1, self.last, right1, self.m1, self.s1), (self.order2, self.key, right2, self.m2, self.s2)):
            # Right: more sure. Wrong: half as sure, or, if not sure, the id that came.
            order[at] = np.where(hit, m + (s < 7), np.where(s < 2, new, m - ((s + 1) >> 1)))
        if len(literals):
            self.fresh.append(literals)
            self.seen += len(literals)
        self.before, self.last = self.last, ids
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self._tables()
        if self.seen >= self.due:
            self._counts()
            self.due = self.seen + max(1 << 13, self.seen // 12)


def encode(ids: np.ndarray) -> bytes:
    """One block. ids: integers from 0 to 2**32 - 1, 2**21 different ones at most."""
    ids = np.asarray(ids)
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be from 0 to 2**32 - 1")
    if n and ids.max() < 1 << 20:
        alphabet = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(ids.max()) + 1, np.int32)
        place[alphabet] = np.arange(len(alphabet))
        inner = place[ids]
    else:
        alphabet, inner = np.unique(ids, return_inverse=True)
    if len(alphabet) > 1 << 21:
        raise ValueError("a block holds 2**21 different ids at most")
    lanes = max(1, min(LANES, -(-n // 64)))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = inner
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, max(1, len(alphabet)), False)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    words = np.zeros((steps * 3 + 4, lanes), np.uint32)  # a word may hold a carry until the end
    used = np.zeros(lanes, np.int64)

    def emit(at: np.ndarray) -> None:
        x = low[at]
        words[used[at], at] = x >> _U(32)
        used[at] += 1
        low[at] = (x & _LOW32) << _U(16)
        width[at] <<= _U(16)

    none = np.int32(max(1, len(alphabet)))
    for step in range(steps):
        now = grid[step]
        model.look()
        right2, right1 = model.p2 == now, model.p1 == now
        some = right1 | right2
        which = np.int8(2) - some.view(np.int8) - right2.view(np.int8)
        place = (model.ctx << 2) + which
        unit = width >> _U(_FLAG)
        low += model.begin[place] * unit
        width = model.wide[place] * unit
        if len(at := np.flatnonzero(width <= _MIN)):
            emit(at)
        x = np.where(some, none, now)
        unit = width >> _U(_ID)
        low += model.id_begin[x] * unit
        width = np.where(some, width, model.id_wide[x] * unit)
        if len(at := np.flatnonzero(width <= _MIN)):
            emit(at)
            if len(at := at[width[at] <= _MIN]):
                emit(at)
        model.learn(now, right1, right2, which, now[~some])
    if steps:
        # A number in each lane's interval whose next 2**32, or else 2**16, numbers are in it too, so that what a decoder reads after the
        # lane's words does not matter.
        short = ((low + _LOW32) >> _U(32)) << _U(32)
        one = short + _MIN <= low + width
        low = np.where(one, short, ((low + _U(0xFFFF)) >> _U(16)) << _U(16))
        emit(np.arange(lanes))
        emit(np.flatnonzero(~one))
    carry = np.zeros(lanes, np.uint32)
    for i in range(int(used.max(initial=0)) - 1, -1, -1):
        w = words[i] + carry
        words[i] = w & np.uint32(0xFFFF)
        carry = w >> np.uint32(16)
    kind = "<u2" if steps <= 16384 else "<u4"
    table = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes(), 6)
    body = table + used.astype(kind).tobytes() + words.T[np.arange(words.shape[0])[None, :] < used[:, None]].astype("<u2").tobytes()
    head = _HEAD.pack(MAGIC, n, lanes, len(alphabet), len(table), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + _CRC.pack(zlib.crc32(body, zlib.crc32(head))) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block, as unsigned 32-bit integers."""
    if len(block) < _HEAD.size + _CRC.size:
        raise CorruptBlock("the block is shorter than its header")
    magic, n, lanes, size, packed, crc_ids = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size + _CRC.size :]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[: _HEAD.size])) != _CRC.unpack_from(block, _HEAD.size)[0]:
        raise CorruptBlock("the block's header or checksum is wrong")
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(body[:packed]), "<u4"), dtype=np.uint32)
    if len(alphabet) != size:
        raise CorruptBlock("the alphabet has not the size that the header tells")
    body = body[packed:]
    steps = -(-n // lanes)
    kind = "<u2" if steps <= 16384 else "<u4"
    first = np.dtype(kind).itemsize * lanes
    used = np.frombuffer(body[:first], kind).astype(np.int64)
    words = np.append(np.frombuffer(body[first:], "<u2"), np.zeros(4 + 3 * lanes, "<u2"))
    at = np.cumsum(used) - used
    model = _Model(lanes, max(1, size), True)
    width = np.full(lanes, 1 << 48, np.uint64)
    rest = np.zeros(lanes, np.uint64)
    for _ in range(3 if steps else 0):
        rest = (rest << _U(16)) | words[at].astype(np.uint64)
        at += 1
    out = np.zeros((steps, lanes), np.int32)

    def take(x: np.ndarray) -> None:
        k = at[x]
        rest[x] = (rest[x] << _U(16)) | words[k].astype(np.uint64)
        at[x] = k + 1
        width[x] <<= _U(16)

    none = np.int32(max(1, size))
    for step in range(steps):
        model.look()
        unit = width >> _U(_FLAG)
        is2, some = rest < model.to2[model.ctx] * unit, rest < model.to1[model.ctx] * unit  # some: order 1 or 2
        which = np.int8(2) - some.view(np.int8) - is2.view(np.int8)
        place = (model.ctx << 2) + which
        rest -= model.begin[place] * unit
        width = model.wide[place] * unit
        if len(at_ := np.flatnonzero(width <= _MIN)):
            take(at_)
        lit = np.flatnonzero(~some)
        unit = width >> _U(_ID)
        x = np.full(lanes, none)
        x[lit] = model.find(np.minimum(rest[lit] // unit[lit], _U((1 << _ID) - 1)))
        rest -= model.id_begin[x] * unit
        width = np.where(some, width, model.id_wide[x] * unit)
        if len(at_ := np.flatnonzero(width <= _MIN)):
            take(at_)
            if len(at_ := at_[width[at_] <= _MIN]):
                take(at_)
        now = np.where(is2, model.p2, np.where(some, model.p1, x))
        model.learn(now, model.p1 == now, model.p2 == now, which, x[lit])
        out[step] = now
    ids = alphabet[out.T.reshape(-1)[:n]].astype("<u4") if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise CorruptBlock("the decoded ids don't have the block's checksum")
    return ids
