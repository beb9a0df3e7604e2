"""Many lossless WebP files at a time.

Reading: a lane an image. Each step decodes one symbol of every image that is not done: a literal, a place of the colour cache, or a
back-reference, whose run is copied at once; numpy handles a step for all lanes. Heads, which hold the codes and the transforms, are
read one by one, and so are images with several groups of codes.

Writing: rows of bytes as the green of images with a palette of the bytes that they have, back-references to the last place where the
next four bytes came, and prefix codes of each image's own.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

from . import webp
from .webp import LENGTH_ORDER, NEAR, PALETTE, BadWebp, _begun, _finished, _lengths, _opened, _Out, _prefix, _read_body, _read_head, _reversed, _wrapped, _write_code, words_of

#: By prefix: extra bits of a length or distance, and its least value.
_WIDE = np.array([max(0, (p - 2) >> 1) for p in range(40)], np.int64)
_LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(40)], np.int64)
_NEAR = np.array(NEAR, np.int64)
_HASH = np.uint64(0x1E35A7BD)
#: Least and most bytes of a back-reference, and bits of a code's words.
LEAST, MOST, DEEP = 4, 4096, 12
#: Bytes up to which references are compared all at once.
SURE = 20


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file, as webp.decode gives them."""
    opened = [_opened(f) for f in files]
    heads = [_read_head(bits, w, height, True) for bits, _, height, _, w in opened]
    many = [i for i, h in enumerate(heads) if h[2] is None]
    argb = dict(zip(many, _lanes([(opened[i][0], opened[i][4], opened[i][2], heads[i]) for i in many]), strict=True)) if many else {}
    out = []
    for i, (bits, _, height, transforms, w) in enumerate(opened):
        main = argb[i] if i in argb else _read_body(bits, w, height, *heads[i])
        out.append(_unindexed(main, height, transforms[0]) if [t[0] for t in transforms] == [PALETTE] else _finished(main, w, transforms))
    return out


def _unindexed(argb: np.ndarray, height: int, palette: tuple) -> np.ndarray:
    """The pixels of an image whose only transform is a palette."""
    _, width, tile, table = palette
    index = (argb.view(np.uint8)[1::4]).reshape(height, -1)
    if tile:
        each, x = 8 >> tile, np.arange(width)
        index = (index[:, x >> tile] >> (each * (x & ((1 << tile) - 1))).astype(np.uint8)) & np.uint8((1 << each) - 1)
    full = np.zeros((256, 4), np.uint8)  # an index past the palette is transparent black
    full[: len(table)] = table
    return full.view(np.uint32)[:, 0][np.ascontiguousarray(index)].view(np.uint8).reshape(height, width, 4)


# Rows of the state of lanes: place in bits; next pixel, first and end; first place and mask of the five codes' tables; what literals
# add; whether red, blue and alpha need no bits; the cache's first place and shift; the width.
_AT, _NEXT, _FIRST, _END, _CODES, _ADD, _PLAIN, _CACHE, _SHIFT, _WIDTH = 0, 1, 2, 3, 4, 14, 15, 16, 17, 18


def _lanes(images: list[tuple]) -> list[np.ndarray]:
    """The main images (bits, width, height, head), one group of codes each, as flat arrays of 0xAARRGGBB."""
    chunks, tables, lanes = [], [], []
    bytes_, places, total, slots, stops = 0, 0, 0, 0, []
    for bits, width, height, (cache_bits, _, _, (codes,)) in images:
        state = [8 * bytes_ + bits.at, total, total, total + width * height]
        for c in codes:
            state += [places, (1 << c.bits) - 1]
            tables.append(c.table)
            places += len(c.table)
        only = [c.only for c in codes[1:4]]
        plain = None not in only
        state += [only[2] << 24 | only[0] << 16 | only[1] if plain else 0, plain, slots if cache_bits else -1, 32 - cache_bits, width]
        lanes.append(state)
        slots += 1 << cache_bits if cache_bits else 0
        total += width * height
        chunks.append(bits.data + bytes(8))
        bytes_ += len(bits.data) + 8
        stops.append(8 * (bytes_ - 8))
    data = np.frombuffer(b"".join(chunks) + bytes(8), np.uint8).astype(np.uint32)
    word = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24  # 32 bits from each byte on
    table, cache, out = np.concatenate(tables), np.zeros(slots, np.uint32), np.zeros(total, np.uint32)
    stops, no, last = np.array(stops), np.arange(len(lanes)), 8 * (len(word) - 1)
    s = np.array(lanes, np.int64).T.copy()

    def bits_at(at: np.ndarray) -> np.ndarray:
        return (word[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64)

    def symbol(code: int, at: np.ndarray, which) -> tuple[np.ndarray, np.ndarray]:
        """The next symbols, and the places behind them."""
        e = table[s[_CODES + 2 * code][which] + (bits_at(at) & s[_CODES + 2 * code + 1][which])]
        return (e >> 4).astype(np.int64), at + (e & 15)

    def number(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = _WIDE[prefix]
        return _LEAST[prefix] + (bits_at(at) & ((1 << wide) - 1)), at + wide

    def remember(which: np.ndarray, at: np.ndarray) -> None:
        """Put pixels, in order, into the caches of their lanes."""
        mine = s[_CACHE, which] >= 0
        which, at = which[mine], at[mine]
        slot = ((out[at] * _HASH & np.uint64(0xFFFFFFFF)) >> s[_SHIFT, which].astype(np.uint64)).astype(np.int64)
        cache[s[_CACHE, which] + slot] = out[at]  # of several, the last stays

    cached, colour = bool((s[_CACHE] >= 0).any()), not s[_PLAIN].all()
    near_of = {int(w): np.maximum(1, _NEAR[:, 0] + _NEAR[:, 1] * w) for w in np.unique(s[_WIDTH])}
    one_width = next(iter(near_of.values())) if len(near_of) == 1 else None
    every = slice(None)
    while s.shape[1]:
        at, to = s[_AT], s[_NEXT]
        green, behind = symbol(0, at, every)
        at[:] = behind
        run = np.flatnonzero(green >= 256)
        if colour:
            full = np.flatnonzero((green < 256) & (s[_PLAIN] == 0))
            value = s[_ADD] | green << 8
            for code, shift in ((1, 16), (2, 0), (3, 24)):
                more, at[full] = symbol(code, at[full], full)
                value[full] |= more << shift
            out[to] = value
        else:
            out[to] = s[_ADD] | green << 8  # where another symbol stands, its pixels come over this one
        to += 1
        if len(run):
            hit = run[green[run] >= 280] if cached else run[:0]
            if len(hit):
                out[to[hit] - 1] = cache[s[_CACHE, hit] + green[hit] - 280]
                run = run[green[run] < 280]
            if len(run):
                n, place = number(green[run] - 256, at[run])
                d, place = symbol(4, place, run)
                d, at[run] = number(d, place)
                close = np.flatnonzero(d <= 120)
                far = d[close] - 1
                d -= 120
                if len(close):
                    d[close] = one_width[far] if one_width is not None else np.maximum(1, _NEAR[far, 0] + _NEAR[far, 1] * s[_WIDTH, run[close]])
                first = to[run] - 1
                if (d > first - s[_FIRST][run]).any() or (first + n > s[_END][run]).any():
                    raise BadWebp("a back-reference leaves the image")
                to[run] = first + n
                again = d < n  # the run takes up what it has written itself
                for mine in (np.flatnonzero(~again), np.flatnonzero(again)) if again.any() else (every,):
                    many, back = n[mine], d[mine]
                    before = np.cumsum(many) - many
                    k = np.arange(many.sum())
                    places = np.repeat(first[mine] - before, many) + k
                    if again[mine].any():
                        k -= np.repeat(before, many)
                        out[places] = out[places - k + k % np.repeat(back, many) - np.repeat(back, many)]
                    else:
                        out[places] = out[places - np.repeat(back, many)]
                    if cached:
                        remember(np.repeat(run[mine], many), places)
        if cached:
            one = np.flatnonzero((green < 256) | (green >= 280))
            remember(one, to[one] - 1)
        left = to < s[_END]
        if not left.all():
            if (at > stops[no]).any():
                raise BadWebp("the image ends too early")
            s, no = s[:, left], no[left]
        elif at[0] > stops[no[0]]:  # the others are looked at when some lane is done
            raise BadWebp("the image ends too early")
        np.minimum(s[_AT], last, out=s[_AT])
    ends = np.cumsum([w * h for _, w, h, _ in images])
    return [out[e - w * h : e] for e, (_, w, h, _) in zip(ends, images, strict=True)]


# --- encoder


def _prefixes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits' value, their number) of each number below n; that of 0 is not used."""
    x = np.array([_prefix(max(1, i)) for i in range(n)], np.int64)
    return x[:, 0], x[:, 1], x[:, 2]


@functools.cache
def _tables(width: int, most: int) -> tuple:
    """Prefixes of lengths, and of distances up to most in an image of a width."""
    near = {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
    codes = np.arange(most + 1) + 120
    for d, i in near.items():
        if d <= most:
            codes[d] = i
    return _prefixes(MOST + 1), tuple(x[codes] for x in _prefixes(most + 121))


#: Lengths of the words of a palette's steps: those of 1 and of 2 to 5 are short, the others have nine bits or ten.
_STEPS = [10, 1, 4, 4, 4, 4, 9, 9, 9, 9, 9] + [10] * 245


@functools.cache
def _steps() -> tuple[int, int, list[int], list[int]]:
    """What stands before a palette's pixels, as a number, and how many bits that is; each step's word, with the word of the alpha of
    all but the first, and its length."""
    out = _Out()
    out.write(0, 1)
    for lengths in (_STEPS + [0] * 24, [0] * 256, [0] * 256, [int(x in (0, 255)) for x in range(256)], [0] * 40):
        _write_code(out, lengths)
    words = words_of(_STEPS)
    return int.from_bytes(out.bytes(), "little"), 8 * sum(map(len, out.done)) + out.n, [words[x] for x in range(256)], [n + 1 for n in _STEPS]


@functools.lru_cache(4096)
def _palette(colours: bytes) -> tuple[int, int]:
    """The bits of a palette of greens, as a number, and how many they are."""
    head, at, words, sizes = _steps()
    value = 1 | PALETTE << 1 | (len(colours) - 1) << 3 | head << 11
    at += 11
    value |= (words[colours[0]] | 1 << (sizes[colours[0]] - 1)) << at  # of the alphas 0 and 255, the words 0 and 1
    at += sizes[colours[0]]
    for a, b in itertools.pairwise(colours):
        value |= words[b - a] << at
        at += sizes[b - a]
    return value, at


def _matches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first places, lengths, distances) of back-references inside images, from left to right, as long as what follows agrees."""
    n = len(data) - LEAST + 1
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    tail = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray(len(data) + 8, np.uint64, tail.data, strides=(1,)).copy()  # eight bytes from each place on
    # The next four bytes above a place's number: sorted, places with the same four follow one another.
    key = np.sort(eight[:n] << np.uint64(32) | np.arange(n, dtype=np.uint64))
    order = key.astype(np.uint32).astype(np.int32)
    same = np.flatnonzero((key[1:] ^ key[:-1]) >> np.uint64(32) == 0)
    before = np.full(n, -1, np.int32)
    before[order[same + 1]] = order[same]
    sizes = np.diff(ends, prepend=0)
    begin, stops = (np.repeat(x.astype(np.int32), sizes)[:n] for x in (ends - sizes, ends))
    at = np.flatnonzero((before >= begin) & (np.arange(n, dtype=np.int32) + LEAST <= stops))
    # Lengths, up to SURE, of all places where a reference can begin; a longer one is looked at again once it is taken.
    from_, end = before[at].astype(np.int64), stops[at].astype(np.int64)
    size, going = np.full(len(at), LEAST), np.arange(len(at))
    for m in range(LEAST, SURE, 8):
        i = at[going] + m
        going, i = (x[i <= len(data)] for x in (going, i))
        other = eight[i] ^ eight[from_[going] + m]
        # The bits below the lowest that differs, in whole bytes: all 64 where none does.
        size[going] += np.bitwise_count(~other & (other - np.uint64(1))) >> np.uint8(3)
        going = going[other == 0]
    np.minimum(size, np.minimum(end - at, SURE), out=size)
    reach = np.cumsum(np.bincount(at, minlength=len(data) + 1))  # the place in `at` of what begins behind a byte
    jump = np.where(size == SURE, -1, reach[at + size - 1])
    raw, parts = data.tobytes(), []
    # From left to right in all images at once: each step takes the next reference of every image that has one.
    now, stop = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
    now, stop = now[now < stop], stop[now < stop]
    while len(now):
        parts.append(now)
        now = jump[now]
        for x in np.flatnonzero(now < 0).tolist() if now.min() < 0 else ():
            k = int(parts[-1][x])
            i, j, m = int(at[k]), int(from_[k]), SURE
            most = min(MOST, int(end[k]) - i)
            while m + 64 <= most and raw[j + m : j + m + 64] == raw[i + m : i + m + 64]:
                m += 64
            while m < most and raw[j + m] == raw[i + m]:
                m += 1
            size[k] = m
            now[x] = reach[i + m - 1]
        on = now < stop
        if not on.all():
            now, stop = now[on], stop[on]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    taken = np.sort(np.concatenate(parts))
    return at[taken], size[taken], (at - from_)[taken]


#: Lengths of the words of the code in which an image's code lengths are written: 0 to 12 have four bits, the others five.
_OUTER = [4] * 13 + [5] * 6
_OUTER_WORDS = words_of(_OUTER)


def _write_lengths(out: _Out, lengths: list[int]) -> None:
    """A code of three symbols or more, by its lengths."""
    value = at = 0
    for n, same in itertools.groupby(lengths):
        run = len(list(same))
        while run:
            s, extra, more, k = n, 0, 0, 1
            if n == 0 and run >= 11:
                k = min(run, 138)
                s, extra, more = 18, k - 11, 7
            elif n == 0 and run >= 3:
                s, extra, more, k = 17, run - 3, 3, run
            value |= (extra << _OUTER[s] | _OUTER_WORDS[s]) << at
            at += _OUTER[s] + more
            run -= k
    out.write(0, 1)
    out.write(15, 4)
    for s in LENGTH_ORDER:
        out.write(_OUTER[s], 3)
    out.write(0, 1)
    out.write(value, at)


def _lengths_of(counts: np.ndarray) -> np.ndarray:
    """Lengths of the words of many codes, from the counts of their symbols."""
    out = np.zeros(counts.shape, np.int64)
    for own, c in zip(out, counts, strict=True):
        used = np.flatnonzero(c)
        if len(used):
            own[:] = _lengths(dict(zip(used.tolist(), c[used].tolist(), strict=True)), len(c), DEEP)
    return out


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """The words, first bit lowest, of many codes (code, symbol), as webp.words_of gives them for one."""
    out = np.zeros(lengths.shape, np.int64)
    first = np.zeros(len(lengths), np.int64)
    for n in range(1, DEEP + 1):
        mine = lengths == n
        word = first[:, None] + np.cumsum(mine, 1) - 1
        out[mine] = _reversed(n)[word[mine]]
        first = (first + mine.sum(1)) << 1
    return out


def encode_rows(images: list[bytes], width: int) -> list[bytes]:
    """A lossless WebP file of each image: its bytes are the green of opaque pixels, in rows of a width; red and blue are 0."""
    sizes = np.array([len(x) for x in images], np.int64)
    data = np.frombuffer(b"".join(images), np.uint8)
    image = np.repeat(np.arange(len(images)), sizes)
    has = np.bincount(image * 256 + data, minlength=256 * len(images)).reshape(-1, 256) > 0
    few = has.sum(1) <= 16  # several pixels share a byte there
    out: list[bytes] = [b""] * len(images)
    for i in np.flatnonzero(few):
        pixels = np.zeros((len(images[i]) // width, width, 4), np.uint8)
        pixels[:, :, 1], pixels[:, :, 3] = np.frombuffer(images[i], np.uint8).reshape(-1, width), 255
        out[i] = webp.encode(pixels, [(PALETTE,)], references=True)
    rest = np.flatnonzero(~few)
    if not len(rest):
        return out
    mine = ~few[image]
    data, image = data[mine], np.repeat(np.arange(len(rest)), sizes[rest])
    ends = np.cumsum(sizes[rest])
    index = (np.cumsum(has[rest], 1) - 1)[image, data]
    starts, runs, back = _matches(data, ends)
    inside = np.zeros(len(data) + 1, np.int8)  # what references cover, besides their first
    inside[starts + 1] += 1
    inside[starts + runs] -= 1  # of references that follow one another, the next begins at the end of the one before
    first = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)  # where each symbol begins
    of = image[first]
    lengths, distances = _tables(width, int(sizes.max()))
    green = index[first]
    place = np.searchsorted(first, starts)
    green[place] = 256 + lengths[0][runs]
    far = distances[0][back]
    counts = np.bincount(of * 280 + green, minlength=280 * len(rest)).reshape(-1, 280)
    far_counts = np.bincount(of[place] * 40 + far, minlength=40 * len(rest)).reshape(-1, 40)
    # Words of both codes, by image and symbol, and all that stands before the pixels.
    deep, far_deep = (_lengths_of(c) for c in (counts, far_counts))
    word, far_word = (_canonical(d).astype(np.uint64) for d in (deep, far_deep))
    heads = []
    for k, i in enumerate(rest.tolist()):
        head = _begun(width, len(images[i]) // width)
        head.write(*_palette(np.flatnonzero(has[i]).astype(np.uint8).tobytes()))
        head.write(0, 3)  # no more transforms, no colour cache, one group of codes
        _write_lengths(head, deep[k].tolist())
        head.write(0b000100010001, 12)  # red, blue and alpha: one symbol, 0
        far_bits = far_deep[k].tolist()
        (_write_code if 40 - far_bits.count(0) <= 2 else _write_lengths)(head, far_bits)
        heads.append(head)
    single = far_deep.sum(1) == 1  # a word of no bits
    far_deep[single] = 0
    value, n = word[of, green], deep[of, green]
    more, bits = np.zeros(len(place), np.uint64), np.zeros(len(place), np.int64)
    o = of[place]
    for v, b in ((lengths[1][runs], lengths[2][runs]), (far_word[o, far], far_deep[o, far]), (distances[1][back], distances[2][back])):
        more |= np.asarray(v).astype(np.uint64) << bits.astype(np.uint64)
        bits += b
    value[place] |= more << n[place].astype(np.uint64)
    n[place] += bits
    edge = np.append(np.searchsorted(of, np.arange(len(rest))), len(of))
    for k, i in enumerate(rest.tolist()):
        head = heads[k]
        head.extend(*_joined(value[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]]))
        out[i] = _wrapped(head.bytes())
    return out


def _joined(value: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """Numbers of under 64 bits one behind the other, the lowest bit first, and the number of all bits."""
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    words = np.zeros((total >> 6) + 2, np.uint64)
    shift = (at & 63).astype(np.uint64)
    place = at >> 6
    first = np.flatnonzero(np.diff(place, prepend=-1))  # the first number of each word
    if len(first):
        words[place[first]] = np.bitwise_or.reduceat(value << shift, first)
        words[place[first] + 1] |= np.bitwise_or.reduceat((value >> np.uint64(1)) >> (np.uint64(63) - shift), first)
    return words.tobytes()[: (total + 7) // 8], total
